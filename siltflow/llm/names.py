"""Freely typed names to the entries of a canonical list: a trie searched by a Levenshtein automaton."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltflow.llm.lookalikes import consistent
from siltflow.plans.lineage import cut
from siltflow.plans.spread import spread

# Words that qualify a name and are not part of it.
QUALIFIERS = frozenset("cf aff nr sp spp ssp subsp var forma indet juv adult larva voucher isolate strain specimen sample".split())
_WORD = re.compile(r"[^\W\d_]+")
FEW = 16  # states of so few keys are followed one by one, of more as arrays
WORD = 63  # letters of a key whose states fit into a machine word


def budget(length: int) -> int:
    """Wrong characters allowed in a key of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 10 else 3


class NameTrie:
    """Trie over all alias paths of the entries.

    Paths of an entry: ``genus epithet``, ``epithet genus``, ``genusepithet`` and ``g epithet``.
    A node is [children, {(entry, alias)}]. Paths that begin with an initial have a trie of their own
    by initial, as only keys with an initial can mean them.
    """

    def __init__(self, entries: Iterable[tuple[int, str, str]]):
        self.root: list = [{}, set()]
        self.by_initial: dict[str, list] = {}
        self.lengths: dict[str, set[int]] = {"joined": set(), "full": set()}
        for ref, genus, epithet in entries:
            if not genus or not epithet:
                continue
            g, e = genus.lower(), epithet.lower()
            self.lengths["joined"].add(len(g + e))
            self.lengths["full"].add(len(g + e) + 1)
            start = self.by_initial.setdefault(g[0], [{}, set()])
            for alias, node, path in (("full", self.root, f"{g} {e}"), ("swapped", self.root, f"{e} {g}"), ("joined", self.root, g + e), ("initial", start, e)):
                for c in path:
                    node = node[0].setdefault(c, [{}, set()])
                node[1].add((ref, alias))
        self.search = lru_cache(maxsize=100_000)(self._search)

    def _fits(self, length: int, alias: str) -> bool:
        """Whether a path of this kind is at most three letters longer or shorter."""
        return any(n in self.lengths[alias] for n in range(length - 3, length + 4))

    def _begin(self, key: str) -> tuple[list, str]:
        if key[1:2] == " ":
            return self.by_initial.get(key[0], [{}, set()]), key[2:]
        return self.root, key

    def _search(self, key: str, most: int) -> list[tuple[int, int, str]]:
        """(entry, distance, alias) of all paths at most ``most`` edits from ``key``.

        The automaton is the bit-parallel form: bit i of state d says that the path so far can be
        read as the first i letters of the key with d edits. A branch is left when no bit is set.
        A key that starts with an initial keeps it: without its genus an entry cannot be told otherwise.
        """
        top, key = self._begin(key)
        at: dict[str, int] = {}
        for i, c in enumerate(key):
            at[c] = at.get(c, 0) | 1 << i
        found: dict[int, tuple[int, str]] = {}
        self._follow(top, _start(len(key), most), at, len(key), found)
        return sorted((ref, d, alias) for ref, (d, alias) in found.items())

    @staticmethod
    def _follow(top: list, start: tuple[int, ...], at: dict[str, int], m: int, found: dict[int, tuple[int, str]]) -> None:
        """Walk on from a node with the states of one key."""
        full, end = (1 << (m + 1)) - 1, 1 << m
        todo = [(top, start)]
        while todo:
            node, state = todo.pop()
            for ref, alias in node[1]:
                d = next((d for d, bits in enumerate(state) if bits & end), None)
                if d is not None and (ref not in found or (d, alias) < found[ref]):
                    found[ref] = (d, alias)
            for c, child in node[0].items():
                mask = at.get(c, 0)
                bits = (state[0] & mask) << 1
                new, any_bits = [bits], bits
                for d in range(1, len(state)):
                    old = state[d - 1]
                    bits = (((state[d] & mask) << 1) | old | (old << 1) | (new[d - 1] << 1)) & full
                    new.append(bits)
                    any_bits |= bits
                if any_bits:
                    todo.append((child, tuple(new)))

    def search_all(self, keys: Iterable[str], most: int) -> dict[str, list[tuple[int, int, str]]]:
        """``search`` of many keys in one walk: at each node the states of all keys that can still match are arrays."""
        out: dict[str, list[tuple[int, int, str]]] = {}
        groups: dict[int, tuple[list, list[tuple[str, str]]]] = {}
        for key in keys:
            top, rest = self._begin(key)
            if len(rest) < WORD:
                groups.setdefault(id(top), (top, []))[1].append((key, rest))
            else:
                out[key] = self.search(key, most)
        for top, pairs in groups.values():
            rests = [r for _, r in pairs]
            found: list[dict[int, tuple[int, str]]] = [{} for _ in rests]
            at: list[dict[str, int]] = [{} for _ in rests]
            for n, r in enumerate(rests):
                for i, c in enumerate(r):
                    at[n][c] = at[n].get(c, 0) | 1 << i
            masks = {c: np.array([a.get(c, 0) for a in at], np.uint64) for c in {c for a in at for c in a}}
            none = np.zeros(len(rests), np.uint64)
            lengths = np.array([len(r) for r in rests], np.uint64)
            one = np.uint64(1)
            end, full = one << lengths, (one << (lengths + one)) - one
            start = np.array([[((1 << (d + 1)) - 1) for _ in rests] for d in range(most + 1)], np.uint64) & full
            todo = [(top, np.arange(len(rests)), start)]
            while todo:
                node, who, state = todo.pop()
                if len(who) <= FEW:
                    for n, bits in zip(who.tolist(), state.T.tolist()):
                        self._follow(node, tuple(bits), at[n], len(rests[n]), found[n])
                    continue
                if node[1]:
                    ended = (state & end[who]) != 0
                    for k in np.nonzero(ended.any(axis=0))[0].tolist():
                        d, mine = int(ended[:, k].argmax()), found[who[k]]
                        for ref, alias in node[1]:
                            if ref not in mine or (d, alias) < mine[ref]:
                                mine[ref] = (d, alias)
                for c, child in node[0].items():
                    mask = masks.get(c, none)[who]
                    new = (state & mask) << one
                    for d in range(1, most + 1):
                        new[d] |= state[d - 1] | (state[d - 1] << one) | (new[d - 1] << one)
                    new &= full[who]
                    live = np.nonzero(np.bitwise_or.reduce(new, axis=0))[0]
                    if len(live):
                        todo.append((child, who[live], new[:, live]))
            for (key, _), mine in zip(pairs, found):
                out[key] = sorted((ref, d, alias) for ref, (d, alias) in mine.items())
        return out

    def keys_of(self, name: str | None) -> dict[str, int]:
        """Readings of a name as keys of the trie, with the budget of each."""
        words = [w for w in _WORD.findall((name or "").lower()) if w not in QUALIFIERS]
        keys = [f"{a} {b}" for i, a in enumerate(words) for b in words[i + 1 : i + 3] if len(b) > 1]
        keys = [k for k in keys if k[1:2] == " " or self._fits(len(k), "full")]
        keys += [w for w in words if len(w) > 9 and self._fits(len(w), "joined")]
        return {k: budget(len(k.replace(" ", ""))) for k in keys}

    def match_all(self, names: Iterable[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each name all entries within the budget of some reading of it, nearest first; each key is searched once."""
        asked = [self.keys_of(n) for n in names]
        by_budget: dict[int, set[str]] = {}
        for keys in asked:
            for k, most in keys.items():
                by_budget.setdefault(most, set()).add(k)
        hits = {k: h for most, keys in by_budget.items() for k, h in self.search_all(sorted(keys), most).items()}
        out = []
        for keys in asked:
            best: dict[int, tuple[int, str]] = {}
            for k in keys:
                for ref, d, alias in hits[k]:
                    best[ref] = min(best.get(ref, (d, alias)), (d, alias))
            out.append(sorted(((ref, d, alias) for ref, (d, alias) in best.items()), key=lambda x: (x[1], x[0])))
        return out


def _start(length: int, most: int) -> tuple[int, ...]:
    full = (1 << (length + 1)) - 1
    return tuple(((1 << (d + 1)) - 1) & full for d in range(most + 1))


_TRIES: dict[str, NameTrie] = {}  # of a Python worker: it keeps the last trie for its next tasks


def _trie(number: str, entries: list[tuple[int, str, str]]) -> NameTrie:
    if number not in _TRIES:
        _TRIES.clear()
        _TRIES[number] = NameTrie(entries)
    return _TRIES[number]


def match_names(df: DataFrame, id_col: str, name_col: str, reference: DataFrame, most_entries: int = 200_000) -> DataFrame:
    """(id, matches): for every row with an id all entries within the length-dependent distance of a reading of its name, nearest first, empty where none.

    ``reference`` has ref_id, genus and epithet; its size is checked, and a list above ``most_entries`` is matched part by part, so that what a task
    holds stays bounded; names are spread once for all parts, and what is found does not depend on the parts. Null and blank names have no matches. Rows are not deduplicated.
    """
    entries = reference.select("ref_id", *[consistent(F.col(c)).alias(c) for c in ("genus", "epithet")]).where("ref_id is not null")
    parts = max(1, -(-entries.count() // most_entries))
    names = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), consistent(F.col(name_col)).alias("name")), "id", per_core=2)
    if parts > 1:
        names = cut(names)
    found = []
    for p in range(parts):
        part = [tuple(r) for r in entries.where(F.pmod("ref_id", F.lit(parts)) == p).collect()]
        shared, number = df.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex  # at most about most_entries short names

        def run(batches: Iterator[pd.DataFrame], shared=shared, number=number) -> Iterator[pd.DataFrame]:
            trie = _trie(number, shared.value)
            for b in batches:
                yield pd.DataFrame({"id": b.id, "matches": trie.match_all(b.name)})

        schema = f"id {dict(df.dtypes)[id_col]}, matches array<struct<ref_id: bigint, distance: int, alias: string>>"
        found.append(names.mapInPandas(run, schema))
    if parts == 1:
        return found[0]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    by_distance = lambda a, b: F.when(a["distance"] < b["distance"], -1).when(a["distance"] > b["distance"], 1).otherwise(0)
    return out.groupBy("id").agg(F.array_sort(F.flatten(F.collect_set("matches")), by_distance).alias("matches"))


def decided() -> Column:
    """The entry meant, -1 without one: the only nearest match. Several at one distance are no answer."""
    m = F.col("matches")
    clear = (F.size(m) == 1) | ((F.size(m) > 1) & (F.get(m, F.lit(0))["distance"] < F.get(m, F.lit(1))["distance"]))
    return F.when(clear, F.get(m, F.lit(0))["ref_id"]).otherwise(F.lit(-1).cast("long"))
