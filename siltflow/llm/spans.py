"""Long spans that occur verbatim in more than one record, by Rabin-Karp window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.plans.lineage import cut, store
from siltflow.plans.skew import salted_lookup
from siltflow.plans.spread import spread

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Rabin-Karp hashes of all windows of a text, modulo 2**64, for one odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 4096)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        if n < length:
            return np.zeros(0, np.uint64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(0x51ED270B)) * self.powers[:n], out=sums[1:])
        return _mixed((sums[length:] - sums[:-length]) * self.inverses[: n - length + 1])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def picked_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of every run of ``width`` windows (the first of equals)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= width:
        return np.array([int(hashes.argmin())])
    out = []
    for i in range(0, len(hashes) - width + 1, 1 << 16):
        part = hashes[i : i + (1 << 16) + width - 1]
        out.append(np.unique(np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1) + np.arange(len(part) - width + 1)) + i)
    return np.unique(np.concatenate(out))


def covered(starts: np.ndarray, length: int) -> tuple[int, list[tuple[int, int]]]:
    """Characters in at least one window, and the maximal intervals (begin, end) that the windows make up."""
    starts = np.unique(np.asarray(starts, np.int64))
    if not len(starts):
        return 0, []
    gap = np.nonzero(np.diff(starts) > length)[0]
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return int((last - first).sum()), list(zip(first.tolist(), last.tolist()))


HOT = 200  # a hash in more than 1/HOT of all rows is hot; there are fewer than HOT of them


def repeated(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """The rows whose hashes occur in two classes (``cls``), without the hashes.

    Counting keeps least and greatest class per hash. A hash of boilerplate in a large part of all texts would send all
    their rows to one task when rows are matched with the repeated hashes: such hashes are told by their counts, and salted.
    """
    counts = store(rows.groupBy(*hashes).agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n"))).df
    least = (counts.agg(F.sum("n")).first()[0] or 0) // HOT
    twice = counts.where("a <> b").select(*[F.col(h).alias(f"{h}_") for h in hashes], "n")
    hot = [r[0] for r in twice.where(F.col("n") > least).select(f"{hashes[0]}_").distinct().collect()]  # fewer than HOT
    also = None
    for h in hashes[1:]:
        also = F.col(h) == F.col(f"{h}_")
    return salted_lookup(rows, hashes[0], twice.drop("n"), f"{hashes[0]}_", hot, "left_semi" if not hot else "inner", also=also).select("cls", "pos")


def shared_spans(docs: DataFrame, id_col: str, text_col: str, span: int = 150) -> DataFrame:
    """(doc_id, shared_chars, intervals): documents that share a span of ``span`` code points with another document.

    Steps: texts are classed, copies count once in all that follows. All windows of 2/3 of the
    span are hashed, and of each run of span/3 the least hash is sent; every shared span holds
    such a window, in every text the same one, so only windows of ``span`` around picked windows
    that occur in two texts need to be hashed and counted in full. Windows that are counted in two
    texts are merged into maximal intervals of each text. A text with several ids is shared whole.
    No task gathers the texts of a hash, see ``repeated``.
    Null texts and texts shorter than the span share nothing; rows without id are left out; rows of
    one id with the same text count once, and an id with several texts has them counted separately and summed.
    """
    part = 2 * span // 3
    width = span - part + 1
    one = (
        docs.where(F.col(id_col).isNotNull() & (F.char_length(text_col) >= span))
        .select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.substring(F.sha2(text_col, 256), 1, 32)).alias("cls"))
    )
    classes = one.groupBy("cls").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("text").alias("text")).select("cls", "text", (F.col("lo") != F.col("hi")).alias("copied"))
    classes = cut(spread(classes, "cls"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = Roller(BASES[0])
        for b in batches:
            cls, hs, at = [], [], []
            for c, t in zip(b.cls, b.text):
                h = roller.windows(code_points(t), part)
                p = picked_windows(h, width)
                cls.extend([c] * len(p))
                hs.append(h[p].view(np.int64))
                at.append(p)
            yield pd.DataFrame({"h": np.concatenate([*hs, np.zeros(0, np.int64)]), "cls": cls, "pos": np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32)})

    picks = store(classes.select("cls", "text").mapInPandas(sketch, "h long, cls binary, pos int")).df
    hits = repeated(picks, ["h"]).groupBy("cls").agg(F.collect_set("pos").alias("hits"))  # positions in one text
    near = cut(classes.join(hits, "cls").select("cls", "text", "hits"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rollers = [Roller(b) for b in BASES]
        for b in batches:
            for i in range(0, len(b), 500):
                cls, cols = [], []
                for c, t, hit in zip(b.cls[i : i + 500], b.text[i : i + 500], b.hits[i : i + 500]):
                    codes = code_points(t)
                    n = len(codes) - span + 1
                    mark = np.zeros(n + 1, np.int32)
                    hit = np.asarray(hit, np.int64)
                    np.add.at(mark, np.maximum(hit + part - span, 0), 1)
                    np.add.at(mark, np.minimum(hit + 1, n), -1)
                    at = np.nonzero(np.cumsum(mark[:-1]) > 0)[0]
                    cls.extend([c] * len(at))
                    cols.append((rollers[0].windows(codes, span)[at].view(np.int64), rollers[1].windows(codes, span)[at].view(np.int64), at.astype(np.int32)))
                if cols:
                    h1, h2, at = (np.concatenate(x) for x in zip(*cols))
                    yield pd.DataFrame({"h1": h1, "h2": h2, "cls": cls, "pos": at})

    windows = store(near.mapInPandas(count, "h1 long, h2 long, cls binary, pos int")).df
    starts = repeated(windows, ["h1", "h2"]).groupBy("cls").agg(F.collect_set("pos").alias("starts"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [covered(s, span) for s in b.starts]
            yield pd.DataFrame({"cls": b.cls, "chars": [n for n, _ in done], "intervals": [[{"begin": x, "end": y} for x, y in v] for _, v in done]})

    shape = "array<struct<begin: bigint, end: bigint>>"
    merged = starts.mapInPandas(merge, f"cls binary, chars long, intervals {shape}")
    size = F.char_length("text").cast("long")
    result = classes.select("cls", "copied", size.alias("n")).join(merged, "cls", "left").where(F.col("copied") | F.col("chars").isNotNull())
    result = result.select(
        F.col("cls"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.col("chars")).alias("chars"),
        F.when(F.col("copied"), F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))).otherwise(F.col("intervals")).alias("intervals"),
    )
    return one.select("doc_id", "cls").distinct().join(result, "cls").groupBy("doc_id").agg(F.sum("chars").alias("shared_chars"), F.flatten(F.collect_list("intervals")).alias("intervals"))
