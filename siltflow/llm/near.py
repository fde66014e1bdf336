"""Near-duplicate sequences: BK-trees over the Hamming distance of presence vectors, in shards made by shared anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.plans.lineage import cut, store
from siltflow.plans.spread import spread

GRAM = 8
BOUNDS = (1, 8, 28, 56)  # the least numbers of distinct substrings of the classes of texts
COMMON = 64  # an anchor in more texts than this is common: its texts are compared block by block, without a tree
SHARD = 2048  # texts in a block of a common anchor; anchors in more texts are hot
MOST_HOT = 1_000_000  # hot anchors that are broadcast; if there are more, only those of more texts are hot
BUCKET = 50_000  # rows that a task holds at once, about
BITS = 1024  # of a folded presence vector, where nothing is said


@dataclass(frozen=True)
class Scheme:
    """Anchors of the texts with ``low`` to ``high`` - 1 distinct substrings, and of those that such a text can be similar to.

    An anchor is the least hash of ``run`` neighbouring windows of ``anchor`` letters, so every common stretch of
    ``grams`` substrings (anchor + run - 1 letters) gives both texts the same anchor.
    """

    number: int
    low: int
    high: int
    grams: int
    anchor: int
    run: int


def apart(similarity: float) -> float:
    """Of the a + b distinct substrings of two texts of this similarity at most this share is in one text only."""
    return (1 - similarity) / (1 + similarity)


def schemes(similarity: float) -> list[Scheme]:
    """The stretches that two texts of this similarity must have in common.

    Of the smaller text's n distinct substrings at most ``apart`` * n are not in the other one. A change inside a text (letters
    replaced, put in, left out or moved) breaks at least GRAM - 1 substrings in a row, so there are at most apart * n / (GRAM - 1)
    of them, and the longest of the parts between has its share of all common substrings at least. Only texts in which broken substrings
    happen to be found elsewhere can have a shorter one.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    a, out = apart(similarity), []
    for number, (low, high) in enumerate(zip(BOUNDS, (*BOUNDS[1:], 1 << 40))):
        least = min(math.ceil((1 - a) * n / (int(a * n / (GRAM - 1) + 1e-9) + 1) - 1e-9) for n in range(low, min(high, 4000)))
        letters = GRAM - 1 + max(1, least)
        anchor = max(GRAM, min(14, letters - letters // 8))
        out.append(Scheme(number, low, high, letters - GRAM + 1, anchor, letters - anchor + 1))
    return out


def hot_allowed(size, scheme: Scheme, similarity: float):
    """Substrings of a text that may lie in stretches with a hot anchor, while one of its common stretches has another anchor for certain.

    A similar text of m substrings shares s * (n + m) / (1 + s) with it and leaves room for (m - s * n) / (1 + s) / (GRAM - 1) changes; parts too short for an
    anchor take ``grams`` - 1 each. What is left is least where m is n or s * n.
    """
    a, short = apart(similarity), scheme.grams - 1
    return F.greatest(F.least((1 - a) * size - (a * size / (GRAM - 1) + 1) * short, similarity * size - short), F.lit(0.0))


def grams(seq: str) -> frozenset[str]:
    """The distinct substrings of GRAM letters: the ones of the presence vector."""
    return frozenset(seq[i : i + GRAM] for i in range(len(seq) - GRAM + 1))


def _codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after one another, and where each begins (with the end last)."""
    parts = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in seqs]
    begins = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.uint64), begins


def _window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(max(len(codes) - length + 1, 0), np.uint64)
    for j in range(length):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(h)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(seqs: list[str], sizes: Sequence[int], similarity: float) -> dict[str, np.ndarray]:
    """Anchors of texts with these numbers of distinct substrings: scheme, text (number), anchor, and the substrings
    (begin, end) of the stretches that have it."""
    sizes = np.asarray(sizes, np.int64)
    parts = []
    for s in schemes(similarity):
        mine = np.nonzero((sizes >= s.low) & (sizes * similarity < s.high))[0]
        codes, begins = _codes([seqs[i] for i in mine])
        h = _window_hashes(codes, s.anchor) ^ np.uint64((s.number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        if len(h) < s.run:
            continue
        least = np.lib.stride_tricks.sliding_window_view(h.view(np.int64), s.run).min(axis=1)
        runs = np.maximum(np.diff(begins) - s.anchor - s.run + 2, 0)
        text = np.repeat(mine, runs)
        place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        x = least[np.repeat(begins[:-1], runs) + place]
        new = np.ones(len(x), bool)  # neighbours mostly share their least hash
        new[1:] = (text[1:] != text[:-1]) | (x[1:] != x[:-1])
        at = np.nonzero(new)[0]
        last = np.append(at[1:], len(x)) - 1
        parts.append((np.full(len(at), s.number), text[at], x[at], place[at], place[last] + s.grams))
    names = ("scheme", "text", "anchor", "begin", "end")
    return {n: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k, n in enumerate(names)}


def folded_vectors(seqs: list[str], width: int = BITS) -> tuple[list[bytes], np.ndarray]:
    """Presence vectors folded to ``width`` bits, and the numbers of distinct substrings.

    Folding joins some places of the vectors, so the Hamming distance of folded vectors is at
    most that of the whole ones: a search within a radius misses nothing.
    """
    codes, begins = _codes(seqs)
    h = _window_hashes(codes, GRAM)
    places = np.maximum(np.diff(begins) - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(seqs)), places)
    at = np.repeat(begins[:-1], places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
    mine = h[at]
    bits = np.zeros((len(seqs), width), bool)
    bits[owner, (mine % np.uint64(width)).astype(np.int64)] = True
    order = np.lexsort((mine, owner))
    o, m = owner[order], mine[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (m[1:] != m[:-1])
    return [x.tobytes() for x in np.packbits(bits, axis=1)], np.bincount(o[new], minlength=len(seqs))


class BKTree:
    """Metric tree: a node's children are keyed by their integer distance to it.

    The distance is the Hamming distance of folded presence vectors, held as integers.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int, dict[int, int]]] = []
        self.largest = 0

    def add(self, key: int, vector: int, size: int) -> None:
        if size > self.largest:
            self.largest = size
        at, nodes = 0, self.nodes
        while nodes:
            children = nodes[at][3]
            d = (vector ^ nodes[at][1]).bit_count()
            if d not in children:
                children[d] = len(nodes)
                break
            at = children[d]
        nodes.append((key, vector, size, {}))

    def within(self, vector: int, size: int, similarity: float) -> list[int]:
        """Keys of all texts that may have this similarity (shared by distinct substrings of both).

        Texts with a and b substrings that have it are at a distance of at most (a + b) * (1 - s) / (1 + s);
        the radius is taken for the largest text of the tree, and only edges within it are followed.
        """
        part, found = apart(similarity), []
        radius = (size + self.largest) * part + 1e-9
        todo, nodes = [0] if self.nodes else [], self.nodes
        while todo:
            key, other, n, children = nodes[todo.pop()]
            d = (vector ^ other).bit_count()
            if d <= (size + n) * part + 1e-9:
                found.append(key)
            for e, child in children.items():
                if d - radius <= e <= d + radius:
                    todo.append(child)
        return found


def scan(keys: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of keys whose folded vectors (rows of 64-bit words) allow this similarity: those between side 0 and 1, or
    all if no text is on side 1. The bound is the one of ``BKTree.within``; sizes too far apart are not compared."""
    part, found = apart(similarity), [np.zeros((2, 0), np.int64)]
    order = np.argsort(sizes, kind="stable")
    keys, vectors, sizes, side = keys[order], vectors[order], sizes[order], side[order]
    first = np.nonzero(side == 0)[0]
    second = np.nonzero(side == 1)[0] if side.any() else first
    for i in range(0, len(first), 64):
        x = first[i : i + 64]
        low = i if second is first else np.searchsorted(sizes[second], sizes[x[0]] * similarity - 1e-9)
        y = second[low : np.searchsorted(sizes[second], sizes[x[-1]] / similarity + 1e-9, side="right")]
        d = np.zeros((len(x), len(y)), np.uint16)
        for w in range(vectors.shape[1]):
            d += np.bitwise_count(vectors[x, w][:, None] ^ vectors[y, w][None, :])
        p, q = np.nonzero(d <= (sizes[x][:, None] + sizes[y][None, :]) * part + 1e-9)
        pair = np.sort(np.stack([keys[x[p]], keys[y[q]]]), axis=0)
        found.append(pair[:, pair[0] < pair[1]])
    return tuple(np.concatenate(found, axis=1))


def _hot_posts(picks: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """(anchor, key): hot anchors of the texts that could have all their common stretches in hot ones. ``hot`` has at most MOST_HOT rows, as counted."""
    in_hot = picks.join(F.broadcast(hot), "anchor", "left_semi")
    allowed = F.lit(0.0)
    for s in schemes(similarity):
        allowed = F.when(F.col("scheme") == s.number, hot_allowed(F.col("size"), s, similarity)).otherwise(allowed)
    # Substrings in the stretches of a text's hot anchors, stretches in order and overlaps counted once.
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("begin", "end"))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["upto"], x["begin"]), F.lit(0))).alias("n")),
    )["n"]
    mostly = in_hot.groupBy("key", "scheme", "size").agg(covered.alias("covered")).where(F.col("covered") > allowed).select("key", "scheme")
    return in_hot.join(mostly, ["key", "scheme"], "left_semi").select("anchor", "key")


def similar_classes(texts: DataFrame, similarity: float = 0.6) -> DataFrame:
    """(a, b), a < b: pairs of keys of distinct texts of at least ``similarity``; ``texts`` has key (long) and seq.

    Shards are the texts of one anchor; which stretches give anchors follows from the similarity, see ``schemes``. An anchor in more than SHARD texts is hot,
    and only compared between texts that could have all their common stretches in hot ones, see ``hot_allowed``: any other text shares an
    anchor that is not hot with every similar text, hot or not. So a primer in all texts costs nothing, and no pair is lost. A shard of at most COMMON texts has a tree; a larger one
    is cut into blocks of SHARD, and each pair of blocks is compared whole, so that no task has more than two blocks and no group goes to one task.
    Texts with fewer than GRAM letters are similar to none. The folded vectors find candidates without loss; each distinct pair is then checked
    once on the whole texts.
    """
    usable = texts.where(F.length("seq") >= GRAM).select("key", "seq")
    mean = usable.agg(F.avg(F.length("seq"))).first()[0] or GRAM
    width = min(1 << 13, max(256, 1 << math.ceil(math.log2(4 * mean))))  # about four bits for each substring of a text

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                vectors, sizes = folded_vectors(part.seq.tolist(), width)
                yield pd.DataFrame({"key": part.key.to_numpy(), "seq": part.seq.to_numpy(), "vector": vectors, "size": sizes})

    seqs = cut(spread(usable, "key").mapInPandas(fold, "key long, seq string, vector binary, size int"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                found = pd.DataFrame(anchors(part.seq.tolist(), part["size"], similarity))
                yield found.assign(key=part.key.to_numpy()[found.text], size=part["size"].to_numpy()[found.text]).drop(columns="text")

    picks = store(seqs.select("key", "seq", "size").mapInPandas(sketch, "scheme int, anchor long, begin int, end int, key long, size int")).df
    counts = store(picks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")).df
    many = SHARD
    while (n_hot := counts.where(F.col("n") > many).count()) > MOST_HOT:
        many *= 2
    met = picks.select("anchor", "key").join(counts.where(F.col("n") <= many), "anchor")
    none = picks.select("anchor", "key").limit(0)
    still = store(_hot_posts(picks, counts.where(F.col("n") > many).select("anchor"), similarity)).df if n_hot else none
    again = still.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    size_of = lambda c: F.when(F.col(c) > COMMON, F.ceil(F.col(c) / SHARD)).otherwise(1).cast("int")
    total = counts.where(F.col("n") <= many).select("n").union(again.select("n")).agg(F.sum(F.col("n") * size_of("n"))).first()[0] or 0
    posts = met.union(still.join(F.broadcast(again), "anchor").select("anchor", "key", "n"))  # again: hot anchors only
    posts = posts.withColumn("blocks", size_of("n")).withColumn("own", F.pmod(F.xxhash64("key", "anchor"), F.col("blocks")).cast("int"))
    # Each text goes to the pairs of its own block with every block, so that a pair of texts meets once.
    sent = posts.select("anchor", "key", "own", (F.col("n") > COMMON).alias("common"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("anchor", "key", "common", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    sent = sent.join(seqs.select("key", "vector", "size"), "key")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        few = group[~group.common]
        order = np.lexsort((few.key, few.anchor))
        shard, tree = None, BKTree()
        for anchor, key, vector, size in zip(*(few[c].to_numpy()[order].tolist() for c in ("anchor", "key", "vector", "size"))):
            if anchor != shard:
                shard, tree = anchor, BKTree()
            bits = int.from_bytes(vector, "big")
            out.update((min(key, k), max(key, k)) for k in tree.within(bits, size, similarity) if k != key)
            tree.add(key, bits, size)
        found = [pd.DataFrame(list(out), columns=["a", "b"])]
        for _, g in group[group.common].groupby(["anchor", "low", "high"]):
            vectors = np.frombuffer(b"".join(g.vector), np.uint64).reshape(len(g), width // 64)
            a, b = scan(g.key.to_numpy(), vectors, g["size"].to_numpy().astype(np.int64), g.side.to_numpy(), similarity)
            found.append(pd.DataFrame({"a": a, "b": b}))
        return pd.concat(found).drop_duplicates()

    spark = texts.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism * 4, total // BUCKET)
    near = sent.withColumn("bucket", F.pmod(F.xxhash64("anchor", "low", "high"), F.lit(buckets))).groupBy("bucket").applyInPandas(search, "a long, b long").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b.sa, b.sb):
                p, q = grams(x), grams(y)
                both = len(p & q)
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    text = seqs.select("key", "seq")
    pairs = near.join(text.select(F.col("key").alias("a"), F.col("seq").alias("sa")), "a").join(text.select(F.col("key").alias("b"), F.col("seq").alias("sb")), "b")
    return pairs.mapInPandas(verify, "a long, b long")


def similar_texts(df: DataFrame, id_col: str, seq_col: str, map_col: str, similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each record, and the pairs of classes of similar upper-cased texts.

    ``members`` has id, keys (hashes of its (exp, sample) keys), key (its class, the least id of its text) and n (records of the class); ``links`` has a and b. Copies are
    not expanded into pairs. Repeated rows of an id count once, of differing ones the least text and the map of greatest hash decide.
    Null ids, null or short texts and null or empty maps have no class.
    """
    keys = F.array_distinct(F.flatten(F.transform(F.map_entries("m"), lambda e: F.transform(F.map_keys(e["value"]), lambda s: F.xxhash64(e["key"], s)))))
    one = (
        df.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.upper(F.min(seq_col)).alias("seq"), F.max_by(map_col, F.when(F.col(map_col).isNotNull(), F.xxhash64(F.to_json(map_col)))).alias("m"))
        .where(F.length("seq") >= GRAM)
        .select("id", "seq", keys.alias("keys"))
        .where(F.size("keys") > 0)
    )
    one = store(one).df
    classes = one.groupBy("seq").agg(F.min("id").alias("key"), F.count("*").alias("n"))
    members = store(one.join(classes, "seq").select("id", "keys", "key", "n")).df
    return members, similar_classes(classes.select("key", "seq"), similarity)


def similar_records(df: DataFrame, id_col: str, seq_col: str, map_col: str, similarity: float = 0.6) -> DataFrame:
    """(node_a, node_b), node_a < node_b: all pairs of records with similar texts and an (exp, sample) key in common.

    ``similar_texts`` expanded: records of one text are joined through their class, and are similar to one another.
    """
    members, pairs = similar_texts(df, id_col, seq_col, map_col, similarity)
    left = members.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("keys").alias("ka"))
    right = members.select(F.col("key").alias("b"), F.col("id").alias("ib"), F.col("keys").alias("kb"))
    across = pairs.join(left, "a").join(right, "b")
    same = members.where("n > 1")
    inside = same.select("key", F.col("id").alias("ia"), F.col("keys").alias("ka")).join(same.select("key", F.col("id").alias("ib"), F.col("keys").alias("kb")), "key").where("ia < ib")
    both = across.select("ia", "ib", "ka", "kb").union(inside.select("ia", "ib", "ka", "kb"))
    return both.where(F.arrays_overlap("ka", "kb")).select(F.least("ia", "ib").alias("node_a"), F.greatest("ia", "ib").alias("node_b")).distinct()
