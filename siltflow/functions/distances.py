"""Edit distances of two short texts, for pairs that a search has found; each is bounded by Levenshtein's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

FAR = 1 << 20  # of texts that a distance does not compare


def hamming(a: str, b: str) -> int:
    """Places that differ; texts of different lengths are far."""
    return sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else FAR


def lcs(a: str, b: str) -> int:
    """Letters left out or put in: both lengths less twice the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def osa(a: str, b: str) -> int:
    """Edits, where two neighbours changing places are one, and no part is edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [*rows[-1:], row]
    return rows[-1][-1]


def damerau(a: str, b: str) -> int:
    """Edits, where two letters changing places are one even if others come between them."""
    table = {(-1, j): FAR for j in range(-1, len(b) + 1)} | {(i, -1): FAR for i in range(len(a) + 1)}
    table |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), at
            if x == y:
                at = j
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (x != y), table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return table[len(a), len(b)]


#: Method -> the distance, and how many of Levenshtein's edits one of its own can be.
METHODS: dict[str, tuple[Callable[[str, str], int], int]] = {"hamming": (hamming, 1), "lcs": (lcs, 1), "osa": (osa, 2), "dl": (damerau, 2)}


def of_series(method: str) -> Callable[[pd.Series, pd.Series], pd.Series]:
    f = METHODS[method][0]

    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype="int32")

    return apart
