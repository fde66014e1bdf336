"""Greedy clustering, two-parent chimeras and seed-and-verify search: native forms of tasks otherwise left to external programs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltflow.functions.seeds import seeds
from siltflow.operators.beginnings import longest_beginnings
from siltflow.plans.lineage import read_all, store
from siltflow.plans.order import numbered
from siltflow.plans.spread import spread


def similar_pairs(seqs: DataFrame, identity: float = 0.97, max_edits: int | None = None) -> DataFrame:
    """(a, b, edits) of sequences with edits <= (1 - identity) * longer length, ``a`` no longer than ``b``.

    Of a text cut into d + 1 pieces one survives d edits, moved by no more than the edits on either side of it allow: pieces of the shorter text are
    joined by equality with the substrings of the longer one that can hold them, then verified.
    ``seqs`` has seq, unique. The length of the longer text of a pair fixes its d, which ``max_edits`` may lower.
    """
    own = seqs.where(F.length("seq") > 0).select("seq", F.length("seq").alias("len"))
    limit = lambda n: F.floor(F.lit(1 - identity) * n + 1e-9).cast("int")
    d = limit(F.col("lb")) if max_edits is None else F.least(limit(F.col("lb")), F.lit(max_edits))
    lens = own.select("len").distinct()
    # Lengths that are there, each with those it can be the shorter one of.
    shorter = F.explode(F.sequence(F.greatest(F.col("lb") - F.col("d"), F.lit(1)), F.col("lb")))
    meet = store(lens.select(F.col("len").alias("lb")).withColumn("d", d).withColumn("la", shorter).join(lens.select(F.col("len").alias("la")), "la", "left_semi")).df
    begin = lambda i: F.floor(F.col("la") * i / (F.col("d") + 1)).cast("int") + 1
    no = F.explode(F.sequence(F.lit(0), F.col("d")))
    start, size = begin(F.col("no")), begin(F.col("no") + 1) - begin(F.col("no"))
    pieces = own.withColumnRenamed("len", "la").join(meet.select("la", "d").distinct(), "la").withColumn("no", no).select(F.col("seq").alias("a"), "la", "d", F.xxhash64("d", "la", "no", F.substring("seq", start, size)).alias("piece"))
    other = own.withColumnRenamed("len", "lb").join(meet, "lb").withColumn("no", no)
    # Of the pieces that survive, one has at most as many edits before it as there are pieces before, and so many after it as after.
    more, after = F.col("lb") - F.col("la"), F.col("d") - F.col("no")
    low, high = F.greatest(-F.col("no"), more - after), F.least(F.col("no"), more + after)
    other = other.where(low <= high).withColumn("shift", F.explode(F.sequence(low, high))).where((start + F.col("shift") >= 1) & (start + F.col("shift") + size - 1 <= F.col("lb")))
    # Hashes stand for pieces and longer texts: equal ones only make more candidates, which are verified.
    other = other.select(F.xxhash64("seq").alias("hb"), F.xxhash64("d", "la", "no", F.substring("seq", start + F.col("shift"), size)).alias("piece")).distinct()
    met = pieces.join(other, "piece").select("a", "la", "d", "hb").distinct()
    met = met.join(own.select(F.col("seq").alias("b"), F.col("len").alias("lb"), F.xxhash64("seq").alias("hb")), "hb").where((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))).where(F.col("d") == d)
    return met.withColumn("edits", F.expr("levenshtein(a, b, d)")).where("edits >= 0").select("a", "b", "edits")


def greedy_clusters(seqs: DataFrame, identity: float = 0.97, order: str = "length") -> DataFrame:
    """(seq, centroid, edits): greedy centroid clustering in order of ``length`` (longest first) or ``size`` (greatest first).

    A sequence becomes a centroid unless an earlier centroid is similar enough, else it joins the nearest, of equals the
    earliest. The order is settled in rounds: a sequence is decided once all its earlier neighbours are, so each
    round decides all sequences at one time whose fate is known. Identity is by edits over the longer length. ``seqs`` has seq (unique) and size.
    """
    key = F.struct((-F.col("size") if order == "size" else -F.length("seq")).alias("o"), F.col("seq").alias("s"))
    ranked = store(seqs.select("seq", key.alias("rank"))).df
    p = similar_pairs(seqs.select("seq"), identity)
    both = p.select(F.col("a").alias("seq"), F.col("b").alias("near"), "edits").union(p.select(F.col("b"), F.col("a"), "edits"))
    r = ranked.select(F.col("seq").alias("near"), F.col("rank").alias("near_rank"))
    earlier = store(both.join(ranked, "seq").join(r, "near").where(F.col("near_rank") < F.col("rank")).select("seq", "near", "edits", "near_rank")).df
    settled = [store(ranked.select("seq").join(earlier.select("seq").distinct(), "seq", "left_anti").select("seq", F.lit(None).cast("string").alias("centroid"), F.lit(0).alias("edits")))]
    open_ = store(ranked.select("seq").join(settled[0].df, "seq", "left_anti"))
    while open_.df.head(1):
        known = read_all(settled).select(F.col("seq").alias("near"), F.col("centroid").isNull().alias("is_centroid"))
        seen = earlier.join(open_.df, "seq", "left_semi").join(known, "near", "left")
        best = F.min(F.when(F.col("is_centroid"), F.struct("edits", "near_rank", "near")))
        now = seen.groupBy("seq").agg(F.max(F.col("is_centroid").isNull()).alias("waits"), best.alias("c")).where("not waits")
        settled.append(store(now.select("seq", F.col("c.near").alias("centroid"), F.coalesce("c.edits", F.lit(0)).alias("edits"))))
        left = store(open_.df.join(settled[-1].df, "seq", "left_anti"))
        open_.drop()
        open_ = left
    return read_all(settled).select("seq", F.coalesce("centroid", "seq").alias("centroid"), "edits")


def cluster_table(long: DataFrame, clusters: DataFrame) -> DataFrame:
    """(experiment, SEQ, sample, count): counts of a long table summed over the members of each cluster."""
    return long.join(clusters.select(F.col("seq").alias("SEQ"), "centroid"), "SEQ").groupBy("experiment", F.col("centroid").alias("SEQ"), "sample").agg(F.sum("count").alias("count"))


def _crossed() -> Column:
    """A beginning and an end of two parents, neither of which holds the sequence whole, cover it."""
    n, m, size = F.col("left_n"), F.col("right_n"), F.col("len")
    return F.coalesce((n < size) & (m < size) & (n + m >= size) & (F.col("left_no") != F.col("right_no")), F.lit(False)).alias("chimeric")


def _reference_chimeras(seqs: DataFrame, reference: DataFrame, min_part: int, named: bool) -> DataFrame:
    """``chimeras`` with a reference: both are sorted together, once as they are and once from the end, so nothing is made for each beginning and end."""
    kinds = dict(seqs.dtypes)
    both = seqs.select(F.col("seq").alias("text"), F.lit(True).alias("asked"), "size")
    both = both.union(reference.select("seq", F.lit(False), F.lit(None).cast(kinds["size"])))
    # Numbers in the order of the sequences stand for them; of parents the last one counts.
    left = store(longest_beginnings(both, min_part, True)).df
    right = store(longest_beginnings(left.select(F.reverse("text").alias("text"), "asked", "no"), min_part, False)).df
    some = lambda name: F.when(F.col("n") > 0, F.col(name))
    ends = right.select("no", some("n").alias("right_n"), some("top").alias("right_no"))
    mine = left.where("asked").select(F.col("text").alias("seq"), "size", "no", F.length("text").alias("len"), some("n").alias("left_n"), some("top").alias("left_no"))
    found = mine.join(ends, "no", "left")
    if not named:
        return found.select("seq", "size", _crossed())
    parent = lambda side: left.where("not asked").select(F.col("no").alias(f"{side}_no"), F.col("text").alias(side))
    return found.join(parent("left"), "left_no", "left").join(parent("right"), "right_no", "left").select("seq", "size", "left", "right", _crossed())


def chimeras(seqs: DataFrame, fold: float = 2.0, min_part: int = 24, reference: DataFrame | None = None, named: bool = True) -> DataFrame:
    """(seq, size, left, right, chimeric): sequences that are a beginning of one parent and an end of another.

    Approximate next to alignment-based detection: the parts are exact. For each length the most
    frequent holder of a beginning is found by aggregation, no pairs are made. A sequence is chimeric when the longest
    beginning and the longest end found in parents, each of ``min_part`` letters or more, cover it and no parent holds it from its beginning or to its end whole.
    Parents are sequences at least ``fold`` times as frequent, or those of ``reference`` (seq, unique), where one is given; then ends are found in sorted order.
    What is shuffled for each beginning and end is two hashes and a number, not the sequence. ``seqs`` has seq, unique, and size.
    Without ``named`` the parents' sequences, left and right, are not looked up.
    """
    if reference is not None:
        return _reference_chimeras(seqs, reference, min_part, named)
    # Numbers in the order of the sequences stand for them: of equally frequent parents the last one counts.
    sized = store(numbered(seqs.select("seq", "size", F.length("seq").alias("len")), ["seq"], "no")).df

    def parts(side: str) -> DataFrame:
        part = F.substring("seq", F.lit(1), F.col("n")) if side == "left" else F.substring("seq", F.col("len") - F.col("n") + 1, F.col("n"))
        cuts = sized.where(F.col("len") > min_part).withColumn("n", F.explode(F.sequence(F.lit(min_part), F.col("len") - 1)))
        return cuts.select("no", "size", "n", F.xxhash64(part).alias("h"), F.xxhash64(part, F.lit(7)).alias("h2"))

    def ends(side: str) -> DataFrame:
        top = parts(side).groupBy("n", "h", "h2").agg(F.max(F.struct("size", "no")).alias("top"), F.count("*").alias("k")).where("k > 1")
        found = parts(side).join(top.select("n", "h", "h2", "top"), ["n", "h", "h2"]).where(F.col("top.size") >= fold * F.col("size"))
        found = found.groupBy("no").agg(F.max(F.struct("n", F.col("top.no").alias("parent"))).alias("e"))
        return found.select("no", F.col("e.n").alias(f"{side}_n"), F.col("e.parent").alias(f"{side}_no"))

    def parent(side: str) -> DataFrame:
        return sized.select(F.col("no").alias(f"{side}_no"), F.col("seq").alias(side))

    both = sized.join(ends("left"), "no", "left").join(ends("right"), "no", "left")
    if not named:
        return both.select("seq", "size", _crossed())
    return both.join(parent("left"), "left_no", "left").join(parent("right"), "right_no", "left").select("seq", "size", "left", "right", _crossed())


def search(queries: DataFrame, db: DataFrame, seed: int = 28, max_target_seqs: int = 10, perc_identity: float = 90.0, qcov: float = 90.0) -> DataFrame:
    """(qseqid, sseqid, pident, qcovs): seed-and-verify search, approximate next to gapped local alignment.

    A hit shares an exact seed; identity is 100 * (1 - edits / longer length), coverage the shorter over the query's length.
    Of every stretch of ``seed`` letters one shorter window is sent, see ``seeds``, and that a whole stretch is shared is tested on what is left at the end.
    Every seed is followed, however many entries hold it: numbers and lengths alone are joined, so that Spark can split a hot
    partition, and sequences are fetched once for each pair. Both frames have id and seq.
    """
    def seeded(df: DataFrame, name: str, size: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                text, k = seeds(b.seq.tolist(), seed, seed - seed // 4)
                yield pd.DataFrame({name: b.id.to_numpy()[text], size: b["size"].to_numpy()[text], "k": k})

        rows = spread(df.where(F.length("seq") >= seed).select("id", "seq", F.length("seq").alias("size")), "id")
        return rows.mapInPandas(run, f"{name} {dict(df.dtypes)['id']}, {size} int, k long")

    longer = F.greatest("ql", "sl")
    met = seeded(queries, "qseqid", "ql").join(seeded(db, "sseqid", "sl"), "k").withColumn("qcovs", F.round(100 * F.least("ql", "sl") / F.col("ql"), 3)).where(F.col("qcovs") >= qcov)
    met = met.where(F.round(100 * (1 - F.abs(F.col("ql") - F.col("sl")) / longer), 3) >= perc_identity)  # the difference of the lengths is the least number of edits
    near = met.select("qseqid", "sseqid", "ql", "sl", "qcovs").distinct()
    near = near.join(queries.select(F.col("id").alias("qseqid"), F.col("seq").alias("q")), "qseqid").join(db.select(F.col("id").alias("sseqid"), F.col("seq").alias("s")), "sseqid")
    near = near.where((F.length("q") == F.col("ql")) & (F.length("s") == F.col("sl")))
    near = near.withColumn("most", F.ceil(longer * (1 - perc_identity / 100)).cast("int") + 1)  # edits that the identity allows
    near = near.select("qseqid", "sseqid", "q", "s", "qcovs", longer.alias("longer"), F.explode(F.array(F.expr("levenshtein(q, s, most)"))).alias("edits")).where("edits >= 0")
    hit = near.withColumn("pident", F.round(100 * (1 - F.col("edits") / F.col("longer")), 3)).where(F.col("pident") >= perc_identity)
    mers = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - seed + 1), lambda i: F.xxhash64(F.substring(c, i, F.lit(seed))))
    # So few edits leave a whole stretch between two of them; otherwise it is looked for.
    sure = F.floor((F.col("longer") - F.col("edits")) / (F.col("edits") + 1)) >= seed
    hit = hit.where(F.when(sure, F.lit(True)).otherwise(F.arrays_overlap(mers("q"), mers("s"))))
    top = Window.partitionBy("qseqid").orderBy(F.desc("pident"), F.desc("qcovs"), "sseqid")
    return hit.withColumn("k", F.row_number().over(top)).where(F.col("k") <= max_target_seqs).select("qseqid", "sseqid", "pident", "qcovs")
