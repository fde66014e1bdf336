"""Merging paired reads by their best overlap, as an Arrow kernel over many pairs of one shape at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.functions.iupac import revcomp
from siltflow.functions.numbers import log_factorial as _log_factorial

SIGNIFICANT = 0.01
_CORRECT = 1.0 - 10.0 ** (-np.arange(94) / 10.0)


@dataclass(frozen=True)
class Composition:
    """Shares of A, C, G and T in the first reads and the longest read."""

    share: tuple[float, float, float, float]
    max_length: int


def composition(r1: DataFrame, batch_size: int = 1_000_000) -> Composition:
    """Base composition of the R1 reads with rec_no below ``batch_size``; of no reads it is even."""
    seq = F.upper("seq")
    n = lambda c: F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))))
    row = r1.where(F.col("rec_no") < batch_size).agg(*[n(c).alias(c) for c in "ACGT"], F.sum(F.length(seq)).alias("all"), F.max(F.length(seq)).alias("longest")).first()
    if not row["all"]:
        return Composition((0.25,) * 4, 0)
    return Composition(tuple(row[c] / row["all"] for c in "ACGT"), row["longest"])


# Results where the distribution below has no meaning, by the first condition that holds.
EDGES = (
    ("overlap longer than the longest read", 0.0),
    ("no base ever agrees by chance", 1.0),
    ("every base agrees by chance", 0.0),
    ("equal and unequal bases score alike", 1.0),
)


def overlap_chances(q: float, overlap: np.ndarray, score: np.ndarray, alpha: float, beta: float, longest: int) -> np.ndarray:
    """Chance that two unrelated reads reach each of these scores with an overlap of at least this length.

    Of i random positions k agree with the binomial probability of (i, q), which scores alpha * k + beta * (i - k). The
    scores of all overlaps from the given one to the longest read stay below, on both ends, with the product of the squared distribution
    functions; the result is what is left of 1. Logarithms of the distribution functions are summed for all
    pairs at once, a block of lengths after another.
    """
    overlap, score = np.asarray(overlap, np.int64), np.asarray(score, float)
    for holds, (_, value) in zip((overlap.min(initial=longest + 1) > longest, q <= 0, q >= 1, alpha == beta), EDGES):
        if holds:
            return np.full(len(overlap), value)
    kept = np.zeros(len(overlap))
    height = max(1, 1_000_000 // (longest + 1))
    for low in range(int(overlap.min()), longest + 1, height):
        size = np.arange(low, min(low + height, longest + 1))
        hit = np.arange(size[-1] + 1)
        miss = size[:, None] - hit
        log_p = _log_factorial(size)[:, None] - _log_factorial(hit) - _log_factorial(np.maximum(miss, 0)) + hit * math.log(q) + miss * math.log1p(-q)
        with np.errstate(divide="ignore"):
            below = np.log(np.minimum(np.cumsum(np.where(miss >= 0, np.exp(log_p), 0.0), axis=1), 1.0))
        for n in range(0, len(score), 4096):
            part = slice(n, n + 4096)
            most = np.ceil((score[part, None] - beta * size) / (alpha - beta)).astype(np.int64) - 1  # agreements that stay below the score
            log = below[np.arange(len(size)), np.clip(most, 0, size)]
            log = np.where((most >= size) | (size < overlap[part, None]), 0.0, np.where(most < 0, -np.inf, log))
            kept[part] += log.sum(axis=1)
    return np.where(overlap > longest, EDGES[0][1], np.maximum(-np.expm1(2 * kept), 0.0))


def _tables(share: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """Per base: the factor for equal calls by chance, the share, and the chance that two bases agree. Index 4 is N, 5 any other letter."""
    p = np.array([*share, 0.0, 0.0])
    rest = np.array([sum(share) - x for x in share] + [1.0, 1.0])
    return np.where(np.arange(6) < 4, p**2 / rest**2, 0.0), p, float((p[:4] ** 2).sum())


def best_overlaps(x: np.ndarray, qx: np.ndarray, y: np.ndarray, qy: np.ndarray, comp: Composition, min_overlap: int, alpha: float, beta: float) -> dict[str, np.ndarray]:
    """Best offset of many pairs of one shape: x is (pairs, n1) letters, y the turned second reads, qx and qy qualities.

    All offsets advance together, one column of the first read at a time.
    """
    (pairs, n1), n2 = x.shape, y.shape[1]
    offsets = np.arange(min_overlap - n2, n1 - min_overlap + 1)
    length = np.minimum(n1, offsets + n2) - np.maximum(0, offsets)
    offsets, length = offsets[length >= min_overlap], length[length >= min_overlap]
    square, p, q = _tables(comp.share)
    score, oes = np.zeros((2, pairs, len(offsets)))
    wrong = np.zeros((pairs, len(offsets)), int)
    for i in range(n1):
        j = i - offsets
        at = np.nonzero((j >= 0) & (j < n2))[0]
        if not len(at):
            continue
        a, b = x[:, i][:, None], y[:, j[at]]
        cx, cy = _CORRECT[qx[:, i]][:, None], _CORRECT[qy[:, j[at]]]
        ex, ey = 1 - cx, 1 - cy
        code_a, code_b = _CODE[a], _CODE[b]
        equal = a == b
        some_n = (code_a == 4) | (code_b == 4)
        pa, pb = p[code_a], p[code_b]
        sq = np.square(p[:4]).sum() - pa**2 - pb**2
        with np.errstate(divide="ignore", invalid="ignore"):
            differ = cy * ex * (pb / (1 - pa)) + cx * ey * (pa / (1 - pb)) + ex * ey * (sq / (1 - pa - pb) ** 2)
        chance = np.where(some_n, np.where(equal, q, 1 - q), np.where(equal, cx * cy + ex * ey * square[code_a], differ))
        oes[:, at] += chance * alpha + (1 - chance) * beta
        score[:, at] += np.where(equal, chance * alpha, (1 - chance) * beta)
        wrong[:, at] += ~equal
    order = np.lexsort((np.broadcast_to(offsets, score.shape), wrong, -np.broadcast_to(length, score.shape), -score), axis=1) if len(offsets) else np.zeros((pairs, 0), int)
    if not len(offsets):
        return {"offset": np.zeros(pairs, int), "overlap": np.zeros(pairs, int), "mismatch": np.zeros(pairs, int), "score": np.zeros(pairs), "oes": np.zeros(pairs)}
    k, r = order[:, 0], np.arange(pairs)
    return {"offset": offsets[k], "overlap": length[k], "mismatch": wrong[r, k], "score": score[r, k], "oes": oes[r, k]}


_CODE = np.full(256, 5, np.uint8)
for _n, _c in enumerate("ACGTN"):
    _CODE[ord(_c)] = _n


def _join(s1: str, q1: str, s2: str, q2: str, offset: int, overlap: int, comp: Composition) -> tuple[str, str]:
    """Merged text and qualities of two reads in one orientation."""
    a, b = max(0, offset), max(0, -offset)
    share = dict(zip("ACGT", comp.share))
    seq, qual = [], []
    for x, u, y, v in zip(s1[a : a + overlap], q1[a : a + overlap], s2[b : b + overlap], q2[b : b + overlap]):
        if x == y:
            first = (u > v) if x == "N" else (u >= v)
            x, u = x, (min(u, v) if x == "N" else u if first else v)
        elif "N" in (x, y):
            x, u = (y, v) if x == "N" else (x, u)
        elif u < v or (u == v and share.get(x, 0.25) < share.get(y, 0.25)):
            x, u = y, v
        seq.append(x)
        qual.append(u)
    left = (s1[:a], q1[:a]) if offset >= 0 else (s2[:b], q2[:b])
    right = (s1[a + overlap :], q1[a + overlap :]) if len(s1) >= offset + len(s2) else (s2[b + overlap :], q2[b + overlap :])
    return left[0] + "".join(seq) + right[0], left[1] + "".join(qual) + right[1]


def merge_pair_batch(b: pd.DataFrame, comp: Composition, min_overlap: int, alpha: float, beta: float) -> pd.DataFrame:
    """Adds seq, qual, mismatch, overlap, ovl_score and p_value to rows with r1_seq, r1_qual, r2_seq, r2_qual."""
    b = b.reset_index(drop=True)
    s1 = [(s or "").upper() for s in b.r1_seq]
    s2 = [revcomp((s or "").upper()) for s in b.r2_seq]
    q1 = [(q or "")[: len(s)].ljust(len(s), "!") for q, s in zip(b.r1_qual, s1)]
    q2 = [(q or "")[: len(s)].ljust(len(s), "!")[::-1] for q, s in zip(b.r2_qual, s2)]
    q = sum(p * p for p in comp.share)
    out: list = [None] * len(b)
    shapes: dict[tuple[int, int], list[int]] = {}
    for n, (x, y) in enumerate(zip(s1, s2)):
        shapes.setdefault((len(x), len(y)), []).append(n)
    letters = lambda texts, w: np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), w)
    for (n1, n2), rows in shapes.items():
        step = max(1, 2_000_000 // max(1, n1 + n2))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            level = lambda texts, w: np.clip(letters(texts, w).astype(int) - 33, 0, 93)
            best = best_overlaps(letters([s1[k] for k in part], n1), level([q1[k] for k in part], n1), letters([s2[k] for k in part], n2), level([q2[k] for k in part], n2), comp, min_overlap, alpha, beta)
            chances = np.ones(len(part))
            met = np.nonzero(best["overlap"])[0]
            chances[met] = overlap_chances(q, best["overlap"][met], best["oes"][met], alpha, beta, comp.max_length)
            for m, k in enumerate(part):
                overlap, p = int(best["overlap"][m]), float(chances[m])
                if p >= SIGNIFICANT:
                    out[k] = (s1[k] + s2[k], q1[k] + q2[k], 0, 0, 0.0, p)
                else:
                    out[k] = (*_join(s1[k], q1[k], s2[k], q2[k], int(best["offset"][m]), overlap, comp), int(best["mismatch"][m]), overlap, float(best["score"][m]), p)
    return b.join(pd.DataFrame(out, columns=["seq", "qual", "mismatch", "overlap", "ovl_score", "p_value"]))


def pairend(r1: DataFrame, r2: DataFrame, min_overlap: int = 10, max_mismatches: int = 5, enable_oes_test: bool = True, alpha: float = 1.0, beta: float = -1.0, comp: Composition | None = None, keep_all: bool = False) -> DataFrame:
    """(rec_no, id, seq, qual, mismatch, overlap, ovl_score, p_value) of the merged pairs.

    Both frames have rec_no, id, seq, qual and are paired by rec_no, the place in their files; unpaired records are
    left out. Kept are pairs with few mismatches, enough overlap and a significant score; ``keep_all`` returns all, those
    without significant overlap simply joined end to end. Null sequences count as empty.
    """
    comp = comp or composition(r1)
    right = r2.select("rec_no", F.col("seq").alias("r2_seq"), F.col("qual").alias("r2_qual"))
    pairs = r1.select("rec_no", "id", F.col("seq").alias("r1_seq"), F.col("qual").alias("r1_qual")).join(right, "rec_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield merge_pair_batch(b, comp, min_overlap, alpha, beta)[["rec_no", "id", "seq", "qual", "mismatch", "overlap", "ovl_score", "p_value"]]

    done = pairs.mapInPandas(run, "rec_no long, id string, seq string, qual string, mismatch int, overlap int, ovl_score double, p_value double")
    if keep_all:
        return done
    kept = done.where((F.col("mismatch") <= max_mismatches) & (F.col("overlap") >= min_overlap))
    return kept.where(F.col("p_value") < SIGNIFICANT) if enable_oes_test else kept
