"""Nested records into related flat tables by shared inlining.

The schema graph is read off the data in one pass. Singleton descendants become columns of the
table above them; repeated elements, elements shared by several parents and recursive elements
get tables of their own, whose rows carry the record id, the row of the parent and the keys of all
rows above, so that a table can be used without joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.functions.loosejson import BROKEN, loose_json
from siltflow.plans.spread import spread

ROOT = ""
MOST_EDGES = 100_000  # of a schema; more means that data are taken for labels
LONGEST_ROW_ID = 200  # a row id is the way from the root while it is no longer than this, then a number
ROWS = "rec_id string, relation string, row_id string, parent_relation string, parent_id string, pos long, key string, above array<string>, blocks array<string>, cols map<string,string>"


@lru_cache(maxsize=100_000)
def _child(path: str, label: str) -> str:
    """Path of a member; a label that already occurs above is recursion and leads back to it."""
    parts = path.split("/") if path else []
    if label in parts and label != "*":
        return "/".join(parts[: parts.index(label) + 1])
    return "/".join([*parts, label])


def _text(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else str(v)


@dataclass(frozen=True)
class Graph:
    """Element paths with tables of their own, besides the root, and why."""

    repeated: frozenset[str]
    shared: frozenset[str]
    recursive: frozenset[str]

    def has_table(self, path: str) -> bool:
        return path in self.repeated or path in self.shared or path in self.recursive


def _edges(value: Any, keyed: Mapping[str, int]) -> set[tuple[str, str, str]]:
    """(parent path, path, kind) of a value; kind is object, repeated, recursive or scalar."""
    out: set[tuple[str, str, str]] = set()
    todo: list[tuple[Any, str, int]] = [(value, ROOT, 0)]
    while todo:
        v, path, levels = todo.pop()
        if isinstance(v, list):
            out.add((path, path, "repeated"))
            todo.extend((x, path, 0) for x in v)
        elif isinstance(v, dict):
            if levels:
                entry = path if levels == keyed.get(path) else _child(path, "*")
                out.add((path, entry, "repeated"))
                todo.extend((x, entry, levels - 1) for x in v.values())
                continue
            for label, x in v.items():
                to = _child(path, label)
                if not isinstance(x, (dict, list)):
                    continue
                out.add((path, to, "recursive" if len(to) <= len(path) else "object"))
                todo.append((x, to, keyed.get(to, 0) if isinstance(x, dict) else 0))
    return out


def schema_graph(df: DataFrame, id_col: str, json_col: str, keyed: Mapping[str, int], parse: Callable[[str | None], Any] = loose_json) -> Graph:
    """Read the schema graph off all records.

    Distinct edges are gathered per partition and again in Spark, so what reaches the driver is
    the schema, which does not grow with the records: members of the objects named in ``keyed``
    (path -> levels of keys) are entries, not labels.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for b in batches:
            for text in b.t:
                if (v := parse(text)) is not BROKEN:
                    seen |= _edges(v, keyed)
        yield pd.DataFrame(sorted(seen), columns=["a", "b", "kind"])

    found = df.select(F.col(json_col).alias("t")).mapInPandas(edges, "a string, b string, kind string").distinct().limit(MOST_EDGES + 1).collect()
    if len(found) > MOST_EDGES:
        raise ValueError("labels grow with the data: name the objects whose members are entries in keyed")
    by_label: dict[str, set[str]] = {}
    for a, b, kind in found:
        if kind == "object" and b:
            by_label.setdefault(b.rpartition("/")[2], set()).add(b)
    repeated = frozenset(b for _, b, kind in found if kind == "repeated")
    shared = frozenset(p for paths in by_label.values() if len(paths) > 1 for p in paths if p not in repeated)
    return Graph(repeated, shared, frozenset(b for _, b, kind in found if kind == "recursive"))


def _shred(rec: str, value: Any, graph: Graph, keyed: Mapping[str, int], names: Mapping[str, str]) -> list[tuple]:
    """Rows of one record, made from a list of open tasks, so that depth is no limit.

    The parent row is named by relation and row id. ``keys`` holds (path, key) of the rows above that lie on the way to a row's
    path in the schema graph; a recursive element leads back to its path, so keys are bounded by the graph and not by the record.
    """
    blocks = list(value) if isinstance(value, dict) else []
    out: list[tuple] = []
    number = count(1)

    def row_id(above: str, label: str, n: int) -> str:
        way = f"{above}.{label}{n}"
        return way if len(way) <= LONGEST_ROW_ID else f"#{next(number)}"

    def on_way(keys: tuple, path: str) -> tuple:
        while keys and not path.startswith(keys[-1][0] + "/"):
            keys = keys[:-1]
        return keys

    # (value, path, row, parent row, position, key, keys above, levels of keys below)
    todo: list[tuple] = []
    tops = value if isinstance(value, list) else [value]
    todo.extend((v, ROOT, f"{n}" if isinstance(value, list) else "", (ROOT, ""), n, None, (), 0) for n, v in enumerate(tops, 1))
    todo.reverse()
    while todo:
        v, path, row, parent, pos, key, keys, levels = todo.pop()
        keys = on_way(keys, path)
        cols: dict[str, str | None] = {}
        if key is None and isinstance(v, dict) and path in names:
            key = _text(v.get(names[path]))
        out.append((rec, path, row, *parent, pos, key, [k for _, k in keys], blocks, cols))
        here = (path, row)
        if path != ROOT:
            keys = (*keys, (path, key if key is not None else ""))
        if levels and isinstance(v, dict):
            todo.extend((x, _child(path, "*"), row_id(row, "*", n), here, n, k, keys, levels - 1) for n, (k, x) in enumerate(v.items(), 1))
        elif isinstance(v, dict):
            inner = [(v, path, "")]
            while inner:
                members, at, prefix = inner.pop()
                for label, x in members.items():
                    to = _child(at, label)
                    if isinstance(x, dict) and keyed.get(to):
                        todo.extend((y, to, row_id(row, label, n), here, n, k, keys, keyed[to] - 1) for n, (k, y) in enumerate(x.items(), 1))
                    elif isinstance(x, list) or (isinstance(x, dict) and graph.has_table(to)):
                        todo.extend((y, to, row_id(row, label, n), here, n, None, keys, 0) for n, y in enumerate(x if isinstance(x, list) else [x], 1))
                    elif isinstance(x, dict):
                        inner.append((x, to, f"{prefix}{label}."))
                    else:
                        cols[prefix + label] = _text(x)
        elif isinstance(v, list):
            todo.extend((y, path, row_id(row, "", n), here, n, None, keys, 0) for n, y in enumerate(v, 1))
        else:
            cols["value"] = _text(v)
    return out


def shred(df: DataFrame, id_col: str, json_col: str, keyed: Mapping[str, int], names: Mapping[str, str], parse: Callable[[str | None], Any] = loose_json) -> DataFrame:
    """All rows of all tables (``relation`` tells which; ROOT is the record itself), see ROWS.

    ``names`` gives, by path, the member that names a row of a list layout. Repeated rows of an
    id count once (of differing texts the least). Records with null id are left out; null, blank
    or broken JSON gives no rows. ``above`` holds the keys of the rows above, '' where a row has none.
    """
    one = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("rec_id"), F.col(json_col).alias("t")), "rec_id").groupBy("rec_id").agg(F.min("t").alias("t"))
    graph = schema_graph(df, id_col, json_col, keyed, parse)
    keyed, names = dict(keyed), dict(names)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = [c.split()[0] for c in ROWS.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for rec, text in zip(b.rec_id, b.t):
                if (v := parse(text)) is BROKEN:
                    continue
                out.extend(_shred(rec, v, graph, keyed, names))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=head)
                    out = []
            yield pd.DataFrame(out, columns=head)

    return one.mapInPandas(rows, ROWS)


def reading_report(df: DataFrame, id_col: str, json_col: str, parse: Callable[[str | None], Any] = loose_json) -> DataFrame:
    """(records, blank, broken, read): how many records have no text, text that cannot be read, and rows. Repeated rows of an id count once."""
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("rec_id")).agg(F.min(json_col).alias("t"))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blank = [t is None or not t.strip() for t in b.t]
            broken = sum(not e and parse(t) is BROKEN for e, t in zip(blank, b.t))
            yield pd.DataFrame({"records": [len(b)], "blank": [sum(blank)], "broken": [broken]})

    each = one.select("t").mapInPandas(tell, "records long, blank long, broken long")
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "blank", "broken")])
    return total.withColumn("read", F.col("records") - F.col("blank") - F.col("broken"))


def table(rows: DataFrame, relation: str, columns: Mapping[str, str]) -> DataFrame:
    """One flat table with typed columns; a value that does not fit its type is null.

    A clash with the link columns (rec_id, row_id, parent_id, pos, key) is resolved by a trailing underscore.
    """
    links = ["rec_id", "row_id", "parent_relation", "parent_id", "pos", "key", "above"]
    return rows.where(F.col("relation") == relation).select(*links, *[F.expr(f"try_cast(cols['{c}'] as {t})").alias(f"{c}_" if c in links else c) for c, t in columns.items()])


#: The layouts of the header and pairend blocks.
HEADER_KEYED = {"stat/exp": 1, "stat/exp/samples": 1, "denoise/by_sample": 2}
HEADER_NAMES = {"stat/exp": "name", "stat/exp/samples": "sample", "denoise/by_sample": "exp", "denoise/by_sample/samples": "sample"}
PAIREND_NAMES = {"pairend/lanes": "lane"}


def header_json(text: str | None) -> Any:
    """JSON of a sequence header: what follows ``;size=K;``, else what follows the first brace."""
    if text is None:
        return BROKEN
    at = text.find(";size=")
    rest = text.find(";", at + 1) if at >= 0 else -1
    value = loose_json(text[rest + 1 :] if rest >= 0 else text[max(text.find("{"), 0) :])
    return value if isinstance(value, dict) else BROKEN


def pairend_json(text: str | None) -> Any:
    """A pairend block, brought under ``pairend`` where it comes without that name."""
    value = loose_json(text)
    if isinstance(value, dict) and "pairend" not in value and ("overlap" in value or "lanes" in value):
        return {"pairend": value}
    if isinstance(value, list):
        blocks = [x.get("pairend", x) if isinstance(x, dict) else x for x in value]
        return {"pairend": [y for x in blocks for y in (x if isinstance(x, list) else [x])]}
    return value if isinstance(value, dict) else BROKEN
