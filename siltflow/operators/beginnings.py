"""Longest beginnings that texts have in common with a reference, found in sorted order."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.plans.lineage import store


def common(a: str, b: str) -> int:
    """Letters of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Greatest:
    """Greatest number of any run of a list: of runs of 1, 2, 4 and so on, every one is kept."""

    def __init__(self, numbers: list[int]) -> None:
        self.levels = [np.array(numbers, np.int64)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.maximum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, low: int, high: int) -> int:
        k = (high - low).bit_length() - 1
        return int(max(self.levels[k][low], self.levels[k][high - (1 << k)]))


def _steps(texts: list[str], numbers: list[int], least: int) -> list[tuple[int, int]]:
    """(length, greatest number) of those that share so long a beginning with the first text, by falling length."""
    steps: list[tuple[int, int]] = []
    top = -1
    for text, number in zip(texts, numbers):
        if (n := common(texts[0], text)) < least:
            break
        top = max(top, number)
        if steps and steps[-1][0] == n:
            steps.pop()
        steps.append((n, top))
    return steps


def _of_steps(steps: list[tuple[int, int]], n: int) -> int:
    return max((top for length, top in steps if length >= n), default=-1)


def longest_beginnings(rows: DataFrame, least: int, whole: bool) -> DataFrame:
    """``rows`` with ``n``, the length of the longest beginning, of ``least`` letters or more, that an asked text shares with one of the reference, and
    ``top``, the greatest number of those that have it; 0 and -1 where there is none.

    ``rows`` has text, asked (else it is of the reference, where texts are unique) and, but for a first call, ``no``; if absent, ``no`` is made in the order of the texts.
    Texts are sorted over ranges, so a beginning that many have lies in several. In sorted order the longest beginning is that of
    a neighbour, and those that have it stand together. Where this run reaches the edge of a range, what the other ranges hold of it is told by one row of each: their
    first and last text and the greatest numbers by length. Without ``whole`` only asked rows come back, and not their texts.
    """
    spark = rows.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(ranges, "text", "asked").sortWithinPartitions("text", "asked")
    if "no" not in rows.columns:
        ranged = ranged.withColumn("no", F.monotonically_increasing_id())
    ranged = ranged.withColumn("part", F.spark_partition_id())
    extra = {"n": "int", "top": "bigint", "open": "boolean", "edge": "string"}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ranged.schema] + [T.StructField(k, T.StructType.fromDDL(f"x {v}")[0].dataType) for k, v in extra.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        texts, asked, no = (table[c].to_pylist() for c in ("text", "asked", "no"))
        own = [(t, k) for t, a, k in zip(texts, asked, no) if not a and t is not None]
        refs, numbers = [t for t, _ in own], [k for _, k in own]
        greatest, m, at = Greatest(numbers), len(own), 0
        n, top, open_ = [], [], []
        for text, a in zip(texts, asked):
            if text is None or not a or len(text) < least:
                at += not a and text is not None
                n.append(0), top.append(-1), open_.append(False)
                continue
            best = max(common(text, refs[at - 1]) if at else 0, common(text, refs[at]) if at < m else 0)
            low = high = at
            if best >= least:
                begin = text[:best]
                low = bisect_left(refs, begin, 0, at)
                high = bisect_right(refs, begin, at, m, key=lambda r: r[:best])
            n.append(best if high > low else 0), top.append(greatest.of(low, high) if high > low else -1)
            open_.append(low == 0 or high == m)
        done = table.append_column("n", pa.array(n, pa.int32())).append_column("top", pa.array(top, pa.int64())).append_column("open", pa.array(open_, pa.bool_())).append_column("edge", pa.nulls(len(n), pa.string()))
        if not whole:
            done = done.filter(pa.array(asked))
            done = done.set_column(done.schema.get_field_index("text"), "text", pa.array([t if o else None for t, o in zip(done["text"].to_pylist(), done["open"].to_pylist())], pa.string()))
        done = pa.Table.from_arrays(done.columns, schema=pa.schema([pa.field(f.name, f.type) for f in done.schema]))
        if m:
            edge = json.dumps([refs[0], refs[-1], _steps(refs, numbers, least), _steps(refs[::-1], numbers[::-1], least)])
            last = {"part": pa.array([table["part"][0].as_py()], pa.int32()), "edge": pa.array([edge], pa.string())}
            done = pa.concat_tables([done, pa.Table.from_arrays([last.get(f.name, pa.nulls(1, f.type)) for f in done.schema], schema=done.schema)])
        yield from done.to_batches(max_chunksize=10_000)

    held = store(ranged.mapInArrow(run, schema)).df
    # One row of each range that has texts of the reference.
    edges = sorted((r.part, *json.loads(r.edge)) for r in held.where("edge is not null").select("part", "edge").collect())
    parts = [e[0] for e in edges]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, str], int] = {}

        def outside(before: int, after: int, begin: str) -> int:
            """Greatest number in the ranges up to ``before`` and from ``after``."""
            if (key := (before, after, begin)) not in known:
                best = -1
                while before >= 0 and edges[before][2].startswith(begin):
                    best = max(best, _of_steps(edges[before][4], len(begin)))
                    before = before - 1 if edges[before][1].startswith(begin) else -1
                while after < len(edges) and edges[after][1].startswith(begin):
                    best = max(best, _of_steps(edges[after][3], len(begin)))
                    after = after + 1 if edges[after][2].startswith(begin) else len(edges)
                known[key] = best
            return known[key]

        for b in batches:
            n, top = b["n"].to_pylist(), b["top"].to_pylist()
            for i, (text, part) in enumerate(zip(b["text"].to_pylist(), b["part"].to_pylist())):
                before, after = bisect_left(parts, part) - 1, bisect_right(parts, part)
                best = max(n[i], common(text, edges[before][2]) if before >= 0 else 0, common(text, edges[after][1]) if after < len(edges) else 0)
                if best >= least:
                    begin = text[:best]
                    top[i] = max(top[i] if n[i] == best else -1, outside(before, after, begin))
                    n[i] = best
            new = {"n": pa.array(n, pa.int32()), "top": pa.array(top, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, b[f.name]) for f in b.schema], names=b.schema.names)

    plain = held.where("edge is null")
    out = plain.where("not open").union(plain.where("open").mapInArrow(close, schema)).drop("part", "open", "edge")
    return out if whole else out.drop("text", "asked")
