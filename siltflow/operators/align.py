"""Local alignments with gaps of the pairs that a search has found."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.plans.spread import spread

# Scores of equal and unequal letters and of a letter in a gap, and the statistics of such scores.
MATCH, MISMATCH, GAP = 1.0, -2.0, -2.5
LAMBDA, KAPPA = 1.28, 0.46
COLUMNS = "pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qcovs double"
CELLS = 16_000_000  # of the tables of a batch


def _padded(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.uint32)
    for n, t in enumerate(texts):
        out[n, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def best_paths(queries: list[str], subjects: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, cells of the best local alignment from its end to its beginning) of each pair.

    All pairs advance together along the diagonals of their tables; a cell is reached from the one before in both texts, in the query or
    in the subject. Of equal ways the first of these is taken, of equal ends the first in the order of diagonals and query letters.
    """
    many, n, m = len(queries), max(map(len, queries), default=0), max(map(len, subjects), default=0)
    if not many or not n or not m:
        return [(0.0, []) for _ in queries]
    q, s = _padded(queries, n, 1 << 30), _padded(subjects, m, (1 << 30) + 1)
    way = np.zeros((n + m + 1, many, n + 1), np.uint8)  # by diagonal i + j, pair and i; 0 begins anew
    last = np.zeros((many, n + 1))
    before = np.zeros((many, n + 1))
    best, end = np.zeros(many), np.zeros((many, 2), np.int64)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        fits = np.where(q[:, i - 1] == s[:, j - 1], MATCH, MISMATCH)
        ways = np.stack([np.zeros(fits.shape), before[:, i - 1] + fits, last[:, i - 1] + GAP, last[:, i] + GAP])
        choice = ways.argmax(axis=0)
        now = np.zeros((many, n + 1))
        now[:, i] = np.take_along_axis(ways, choice[None], axis=0)[0]
        way[d][:, i] = choice
        top = now.argmax(axis=1)
        value = now[np.arange(many), top]
        better = value > best
        best[better] = value[better]
        end[better] = np.stack([top, d - top], axis=1)[better]
        before, last = last, now
    out = []
    for k in range(many):
        i, j = end[k].tolist()
        cells = []
        while i > 0 and j > 0 and (c := way[i + j, k, i]):
            cells.append((i, j))
            i, j = i - (c != 3), j - (c != 2)
        out.append((float(best[k]), cells))
    return out


def describe(query: str, subject: str, score: float, cells: list[tuple[int, int]], db_letters: int) -> tuple | None:
    """The values of COLUMNS for a path; None for one without any letter."""
    if not cells:
        return None
    steps = cells[::-1]
    equal = gaps = opened = 0
    at, gap = (steps[0][0] - 1, steps[0][1] - 1), 0
    for i, j in steps:
        kind = 0 if (i > at[0] and j > at[1]) else 1 if i > at[0] else 2
        equal += kind == 0 and query[i - 1] == subject[j - 1]
        gaps += kind > 0
        opened += kind > 0 and kind != gap
        at, gap = (i, j), kind
    bits = (LAMBDA * score - math.log(KAPPA)) / math.log(2)
    length, (q0, s0), (q1, s1) = len(steps), steps[0], steps[-1]
    return (
        round(100 * equal / length, 3), length, length - equal - gaps, opened, q0, q1, s0, s1,
        len(query) * db_letters * 2.0**-bits, round(bits, 1), round(100 * (q1 - q0 + 1) / len(query), 3),
    )


def align_hits(hits: DataFrame, queries: DataFrame, db: DataFrame) -> DataFrame:
    """(qseqid, sseqid, and COLUMNS): the best local alignment of every hit; ``hits`` has qseqid and sseqid, the others id and seq.

    Scores are those of a search for nearly equal sequences with gaps by the letter; e-values are by all letters of ``db``, without
    correction for the ends. A task holds a byte for every (query + subject letter, query letter) of a pair. Hits whose texts have no letter in common have no row. Texts are upper-cased; null texts have no rows.
    """
    letters = int(db.agg(F.sum(F.length("seq"))).first()[0] or 0)
    text = lambda df, i, c: df.where("seq is not null").select(F.col("id").alias(i), F.upper("seq").alias(c))
    pairs = hits.select("qseqid", "sseqid").distinct().join(text(queries, "qseqid", "q"), "qseqid").join(text(db, "sseqid", "s"), "sseqid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.iloc[(b.q.str.len() + b.s.str.len()).argsort(kind="stable")].reset_index(drop=True)  # tables of one size together
            at, rows = 0, []
            while at < len(b):
                n, m = len(b.q[at]), len(b.s[at])
                step = max(1, CELLS // max(1, (n + m + 60) * (n + 30)))
                part = b.iloc[at : at + step]
                for (q, s), (score, cells) in zip(zip(part.q, part.s), best_paths(part.q.tolist(), part.s.tolist())):
                    rows.append(describe(q, s, score, cells, letters))
                at += step
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            keep = [r is not None for r in rows]
            found = pd.DataFrame([r for r in rows if r is not None], columns=names)
            yield pd.concat([b.loc[keep, ["qseqid", "sseqid"]].reset_index(drop=True), found], axis=1)

    types = dict(pairs.dtypes)
    return spread(pairs, "qseqid", "sseqid").mapInPandas(run, f"qseqid {types['qseqid']}, sseqid {types['sseqid']}, {COLUMNS}")
