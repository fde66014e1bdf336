"""Seeds of sequences: a few windows such that long common stretches have one in common."""

from __future__ import annotations

import numpy as np


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of ``length`` numbers: shorter ones are put together, doubling, as the binary digits of the length say."""
    have, done = codes.astype(np.uint64) + np.uint64(0x7F4A7C15), 1
    mix = lambda a, b: ((a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) + (b ^ (b >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
    single = have
    for bit in bin(length)[3:]:
        n = len(have) - done
        have, done = mix(have[: max(n, 0)], have[done:]), 2 * done
        if bit == "1":
            n = len(have) - 1
            have, done = mix(have[: max(n, 0)], single[done : done + max(n, 0)]), done + 1
    return mix(have, have)


def seeds(texts: list[str], stretch: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash): of every stretch of ``stretch`` letters the window of ``window`` letters with the least hash.

    Two texts that have a stretch in common have its seed in common. Texts shorter than a stretch have none.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    width = stretch - window + 1
    lengths = np.array([len(c) for c in codes], np.int64)
    if not (lengths >= stretch).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(np.concatenate(codes), window).view(np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
    many = np.maximum(lengths - stretch + 1, 0)
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins, many)
    both = np.unique(np.stack([text, least[place]]), axis=1)
    return both[0], both[1]
