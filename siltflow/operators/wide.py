"""Attribute-value rows into wide, typed rows by combineByKey over slot registers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = re.compile(r"\+?(\d+|\d{1,3}(?:,\d{3})+)(?:\.0*)?")
_POWER = re.compile(r"\+?\d+(?:\.\d*)?[eE][+-]?\d{1,2}")
MOST = 2**63 - 1
#: Registers are Python objects: a partition is sized by rows (counted from the file footers) to fit a worker.
ROWS_A_PARTITION = 400_000
MOST_TAGS = 10_000  # each makes two columns


def whole_number(text: str | None) -> int | None:
    """A count as written by people and programs: blanks around, a plus sign, leading zeros, thousands
    commas, ``12.0`` and ``1.2e+01`` are read; anything else, a negative number or a part of one is not."""
    if text is None:
        return None
    text = text.strip()
    if m := _WHOLE.fullmatch(text):
        n = int(m[1].replace(",", ""))
    elif _POWER.fullmatch(text):
        x = float(text)
        if x != int(x):
            return None
        n = int(x)
    else:
        return None
    return n if n <= MOST else None


def tag_of(sample: str | None) -> str | None:
    """The tidy form of a sample tag: no blanks around, no ``count_`` before it, upper case; blank is no tag."""
    if sample is None:
        return None
    tag = sample.strip()
    if tag[:6].lower() == "count_":
        tag = tag[6:].strip()
    return tag.upper() or None


def tags_of(df: DataFrame, sample: str = "sample") -> list[str]:
    """All tags of a table in order, read from its distinct sample texts by the rule that also reads the cells."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"tag": [t for t in map(tag_of, b.s) if t is not None]}, dtype=object)

    found = df.select(F.col(sample).alias("s")).distinct().mapInPandas(read, "tag string").distinct().limit(MOST_TAGS + 1).collect()
    if len(found) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags: name the columns that are wanted")
    return sorted(r[0] for r in found)


Register = dict[str, tuple[Any, Any, Any]]


def _later(a: tuple, b: tuple) -> tuple:
    """The deciding one of two cells: later version, then greater tie-breaker, then greater value; associative and commutative."""
    return a if a >= b else b


def slot_registers(df: DataFrame, entity: Sequence[str], attribute: str, version: str, tie: str, values: Sequence[str], read_attribute: Callable[[Any], str | None], partitions: int | None = None):
    """RDD of (entity key, {attribute: (order, values)}), the deciding cell of every slot.

    Cells of one slot are merged on the map side, so what is shuffled is at most one cell per
    entity, attribute and map task, and a register never holds more than the attributes of one
    entity. A null version is older than any other. Rows without a readable attribute make their
    entity appear but fill no slot; null parts of the entity key are keys like others. Empty
    input gives an empty RDD; further columns of ``df`` are never read.
    """
    n = len(entity)
    when = F.col(version)
    if dict(df.dtypes)[version].startswith("timestamp"):
        when = F.unix_micros(when.cast("timestamp"))  # a number is read faster than a point in time
    rdd = df.select(*entity, attribute, when, tie, *values).rdd

    def cell(row: Any) -> tuple:
        slot = read_attribute(row[n])
        order = (row[n + 1] is not None, row[n + 1] or 0, row[n + 2] is not None, row[n + 2] or 0)
        return tuple(row[:n]), (slot, (order, tuple("" if v is None else "v" + v for v in row[n + 3 :])))

    def create(c: tuple) -> dict:
        return {} if c[0] is None else {c[0]: c[1]}

    def add(reg: dict, c: tuple) -> dict:
        if c[0] is not None:
            reg[c[0]] = _later(reg[c[0]], c[1]) if c[0] in reg else c[1]
        return reg

    def merge(a: dict, b: dict) -> dict:
        for slot, c in b.items():
            a[slot] = _later(a[slot], c) if slot in a else c
        return a

    spark = df.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, df.count() // ROWS_A_PARTITION)
    return rdd.map(cell).combineByKey(create, add, merge, parts)


def _value(v: str) -> str | None:
    return v[1:] if v else None


def typed_cells(register: dict) -> dict[str, tuple[int | None, str | None]]:
    """{tag: (count, status)} with the count as a number and the status in lower case without blanks around."""
    out = {}
    for tag, (_, (count, status)) in register.items():
        s = _value(status)
        out[tag] = (whole_number(_value(count)), s.strip().lower() or None if s is not None else None)
    return out


def wide_table(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per (experiment, id): n_samples, total_count, n_head, then count_<tag> and status_<tag> for each of ``tags``.

    A slot without cell is null in both columns; an unreadable count is null beside its status.
    ``tags`` fixes the columns and leaves the first five untouched: those cover every tag.
    """
    schema = T.StructType(
        [T.StructField("experiment", T.StringType()), T.StructField("id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_samples", "total_count", "n_head"))]
        + [f for t in tags for f in (T.StructField(f"count_{t}", T.LongType()), T.StructField(f"status_{t}", T.StringType()))]
    )
    wanted = list(tags)

    def encode(item: tuple) -> tuple:
        cells = typed_cells(item[1])
        read = [(c, s) for c, s in cells.values() if c is not None]
        row = [*item[0], len(read), sum(c for c, _ in read), sum(s == "head" for _, s in read)]
        for t in wanted:
            row.extend(cells.get(t, (None, None)))
        return tuple(row)

    reg = slot_registers(df, ["experiment", "id"], "sample", "loaded_at", "row_no", ["count", "status"], tag_of)
    return df.sparkSession.createDataFrame(reg.map(encode), schema, verifySchema=False)
