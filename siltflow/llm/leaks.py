"""Evaluation texts inside training texts: a BM25 index of the test items searched by block-max WAND."""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.plans.lineage import cut
from siltflow.plans.spread import spread

_WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


class ItemIndex:
    """Inverted index with impacts scaled by item, so that one threshold, 1, serves all items.

    The scale of an item is the least score that any run of ``run`` of its words gives. A passage
    with such a run holds all its words, so its score is at least 1: nothing is lost by the search.
    Items of fewer than ``run`` words cannot match and are not indexed.
    """

    def __init__(self, items: list[tuple[int, str | None]], run: int, block: int = 16):
        self.run = run
        docs = [(i, w) for i, t in items if len(w := words(t)) >= run]
        self.items = [i for i, _ in docs]
        self.runs = [sorted({" " + " ".join(w[j : j + run]) + " " for j in range(len(w) - run + 1)}) for _, w in docs]
        df = Counter(t for _, w in docs for t in set(w))
        mean = sum(len(w) for _, w in docs) / len(docs) if docs else 1
        lists: dict[str, list[tuple[int, float]]] = {}
        for n, (_, w) in enumerate(docs):
            tf = Counter(w)
            impact = {t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            least = min(sum(impact[t] for t in set(w[j : j + run])) for j in range(len(w) - run + 1))
            for t, x in impact.items():
                lists.setdefault(t, []).append((n, x / least))
        self.lists = {}
        for t, posts in lists.items():
            ids, xs = [n for n, _ in posts], [x for _, x in posts]
            blocks = range(0, len(ids), block)
            self.lists[t] = (ids, xs, max(xs), [ids[min(i + block, len(ids)) - 1] for i in blocks], [max(xs[i : i + block]) for i in blocks])

    def search(self, terms: set[str], threshold: float = 1 - 1e-9) -> list[int]:
        """Numbers of all items that score at least ``threshold`` for a passage with these terms."""
        lists = [self.lists[t] for t in terms if t in self.lists]
        if sum(x[2] for x in lists) < threshold:
            return []
        out: list[int] = []
        at = [0] * len(lists)
        live = [(x[0][0], k) for k, x in enumerate(lists)]
        while True:
            live.sort()
            total, p = 0.0, -1
            for p, (_, k) in enumerate(live):
                total += lists[k][2]
                if total >= threshold:
                    break
            if total < threshold:
                return out
            d = live[p][0]
            while p + 1 < len(live) and live[p + 1][0] == d:
                p += 1
            bound, upto = 0.0, live[p + 1][0] if p + 1 < len(live) else math.inf
            for _, k in live[: p + 1]:
                x = lists[k]
                b = bisect_left(x[3], d)
                if b < len(x[3]):
                    bound += x[4][b]
                    upto = min(upto, x[3][b] + 1)
            if bound >= threshold:
                score = 0.0
                for _, k in live[: p + 1]:
                    x = lists[k]
                    at[k] = j = bisect_left(x[0], d, at[k])
                    if j < len(x[0]) and x[0][j] == d:
                        score += x[1][j]
                if score >= threshold:
                    out.append(d)
                upto = d + 1
            else:
                upto = max(upto, d + 1)
            moved = []
            for n, (doc, k) in enumerate(live):
                if n <= p:
                    x = lists[k]
                    at[k] = j = bisect_left(x[0], upto, at[k])
                    if j < len(x[0]):
                        moved.append((x[0][j], k))
                else:
                    moved.append((doc, k))
            live = moved

    def leaked(self, text: str | None, passage: int = 256) -> list[tuple[int, int]]:
        """(item id, distinct runs found) for every item of which ``text`` holds a run of words.

        A long text is searched passage by passage; passages overlap by a run less one word, so
        every run lies whole in one of them.
        """
        w = words(text)
        found: dict[int, set[str]] = {}
        for i in range(0, max(len(w) - self.run + 1, 0), passage - self.run + 1):
            part = w[i : i + passage]
            line = ""
            for n in self.search(set(part)):
                line = line or " " + " ".join(part) + " "
                if hits := [r for r in self.runs[n] if r in line]:
                    found.setdefault(self.items[n], set()).update(hits)
        return sorted((i, len(r)) for i, r in found.items())


_INDEXES: dict[str, ItemIndex] = {}  # of a Python worker: it keeps the last index for its next tasks


def _index(number: str, items: list[tuple[int, str | None]], run: int) -> ItemIndex:
    if number not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[number] = ItemIndex(items, run)
    return _INDEXES[number]


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, run: int = 10, most_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, runs): documents with at least ``run`` consecutive words of an item.

    The index is split so that no part holds more than about ``most_chars`` characters of items;
    a part is what a task keeps in memory. Null and empty texts match nothing; rows without id are left out; repeated rows
    give one row. Documents are only read and never shuffled by content.
    """
    one = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).distinct()
    parts = max(1, -(-(one.agg(F.sum(F.length("t"))).first()[0] or 0) // most_chars))
    texts = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.col(text_col).alias("t")), "d")
    if parts > 1:
        texts = cut(texts)  # read and spread once for all parts
    out = None
    for p in range(parts):
        rows = [tuple(r) for r in one.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect()]
        shared, number = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex  # bounded by most_chars

        def run_batches(batches: Iterator[pd.DataFrame], shared=shared, number=number) -> Iterator[pd.DataFrame]:
            index = _index(number, shared.value, run)
            for b in batches:
                yield pd.DataFrame([(d, i, n) for d, t in zip(b.d, b.t) for i, n in index.leaked(t)], columns=["doc_id", "item_id", "runs"])

        part = texts.mapInPandas(run_batches, f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(items.dtypes)[item_col]}, runs int")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("runs").alias("runs"))
