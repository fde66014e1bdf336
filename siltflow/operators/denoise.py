"""Denoising within each (exp, sample): errors are close to a far more frequent sequence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltflow.plans.lineage import release, store


def _unique(obs: DataFrame, min_count: int | None = None, min_len: int = 0, max_len: int | None = None) -> DataFrame:
    """(no, seq, cells): one stored row per sequence, with its counts by exp and sample, summed.

    Sequences are long next to their counts, so counts are summed under two hashes of them.
    """
    h = [F.xxhash64("seq").alias("h"), F.xxhash64(F.lit(7), "seq").alias("h2")]  # the first argument is the seed of the next
    rows = obs.where(F.col("seq").isNotNull()).select(*h, "seq", "exp", "sample", "cnt")
    summed = rows.groupBy("h", "h2", "exp", "sample").agg(F.sum("cnt").alias("cnt"))
    cells = summed.groupBy("h", "h2").agg(F.collect_list(F.struct("exp", "sample", "cnt")).alias("cells"), F.sum("cnt").alias("total"))
    texts = rows.groupBy("h", "h2").agg(F.min("seq").alias("seq"))
    if min_count is not None:
        cells = cells.where(F.col("total") >= min_count)
    if max_len is not None:
        texts = texts.where(F.length("seq").between(min_len, max_len))
    return store(texts.join(cells, ["h", "h2"]).select(F.monotonically_increasing_id().alias("no"), "seq", "cells")).df


def _keys(max_diff: int, max_indel: int) -> list[Column]:
    """Arrays of hashes of seq, of which s is the folded form and len the length; neighbours have one in common."""
    pieces = {0: 1, 1: 4, 2: 5}.get(max_diff, max_diff + 2)
    piece = [F.expr(f"substring(s, int(len * {i} / {pieces}) + 1, int(len * {i + 1} / {pieces}) - int(len * {i} / {pieces}))") for i in range(pieces)]
    keys = [F.array(*[F.xxhash64(F.lit(n), "len", *[piece[i] for i in kept]) for n, kept in enumerate(combinations(range(pieces), pieces - max_diff))])]
    if max_indel == 1:
        # The letter more lies in one of four pieces of the shorter text; what is before it and what is after it, one later, is in both.
        def less(more: int) -> Column:
            begin = lambda no: F.floor((F.col("len") - more) * F.lit(no) / 4).cast("int")
            rest = [F.xxhash64(F.lit(-1 - no), F.col("len") - more, F.substring("seq", F.lit(1), begin(no)), F.substring("seq", begin(no + 1) + 1 + more, F.col("len"))) for no in range(4)]
            return F.array(*rest)

        keys += [less(0), F.when(F.col("len") > 0, less(1))]
    elif max_indel > 1:
        # Of max_indel + 1 pieces of the shorter text one stands whole in the longer one, at most as much later as that is longer.
        def at(size: Column, no: Column, shift: Column) -> Column:
            begin = lambda i: F.floor(size * i / (max_indel + 1)).cast("int")
            return F.xxhash64(F.lit(-1), size, no, F.substring("seq", begin(no) + 1 + shift, begin(no + 1) - begin(no)))

        nos = F.sequence(F.lit(0), F.lit(max_indel))
        sizes = F.sequence(F.greatest(F.col("len") - max_indel, F.lit(1)), F.col("len") - 1)
        longer = F.transform(sizes, lambda size: F.flatten(F.transform(nos, lambda no: F.transform(F.sequence(F.lit(0), F.col("len") - size), lambda shift: at(size, no, shift)))))
        keys += [F.transform(nos, lambda no: at(F.col("len"), no, F.lit(0))), F.when(F.col("len") > 1, F.flatten(longer))]
    return keys


def _near(unique: DataFrame, max_diff: int, max_indel: int, threshold: float | None = None) -> DataFrame:
    """(exp, sample, no_a, no_b, cnt_a, cnt_b, a_less): neighbours by number, each pair once; a_less where the first is the less sequence.

    Keys are made once per sequence. Only those that several have are given the counts of their sequences, and only
    within one (exp, sample) they make pairs, so that what is in different samples is not compared. Each pair of sequences is verified once.
    """
    text = unique.select("no", "seq", F.regexp_replace(F.upper("seq"), "[^ACGT]", "N").alias("s"), F.length("seq").alias("len"))
    all_keys = F.array_distinct(F.concat(*[F.coalesce(k, F.array().cast("array<bigint>")) for k in _keys(max_diff, max_indel)]))
    shared = lambda df, *by: df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n > 1").drop("_n")
    keyed = shared(text.select("no", F.explode(all_keys).alias("k")), "k")
    held = keyed.join(unique.select("no", "cells"), "no").select("k", "no", F.explode("cells").alias("c")).select("k", "no", "c.exp", "c.sample", "c.cnt").where("cnt > 0")
    names = ["k", "exp", "sample"]
    side = lambda x: held.select(*names, F.col("no").alias(f"no_{x}"), F.col("cnt").alias(f"cnt_{x}"))
    met = side("a").join(side("b"), names).where(F.col("no_a") < F.col("no_b"))
    if threshold is not None:
        met = met.where(F.least("cnt_a", "cnt_b") / F.greatest("cnt_a", "cnt_b") <= threshold)
    met = store(met.select("exp", "sample", "no_a", "no_b", "cnt_a", "cnt_b").distinct()).df
    release(met.sparkSession)
    named = lambda x: text.select(F.col("no").alias(f"no_{x}"), F.col("seq").alias(x), F.col("s").alias(f"s{x}"), F.col("len").alias(f"l{x}"))
    both = met.select("no_a", "no_b").distinct().join(named("a"), "no_a").join(named("b"), "no_b")
    differ = F.aggregate(F.sequence(F.lit(1), F.col("la")), F.lit(0), lambda n, i: n + (F.substring("sa", i, F.lit(1)) != F.substring("sb", i, F.lit(1))).cast("int"))
    close = F.when(F.expr(f"levenshtein(sa, sb, {max_diff}) >= 0"), differ <= max_diff).otherwise(False)
    apart = F.abs(F.col("la") - F.col("lb"))
    indel = F.when(apart.between(1, max_indel), F.expr(f"levenshtein(a, b, {max_indel}) = abs(la - lb)")).otherwise(False)
    both = both.where(F.when(apart == 0, close).otherwise(indel)).select("no_a", "no_b", (F.col("a") < F.col("b")).alias("a_less"))
    return met.join(both, ["no_a", "no_b"])


def neighbour_pairs(obs: DataFrame, max_diff: int = 1, max_indel: int = 0) -> DataFrame:
    """(exp, sample, a, b, cnt_a, cnt_b) with a < b: sequences of one (exp, sample) within the allowed differences.

    Substitutions: of texts of one length that differ in at most ``max_diff`` places, cut into more pieces than that, all but ``max_diff`` pieces are equal,
    so every choice of that many pieces is joined by equality and the pairs verified. One choice is most of the text (for one
    difference three quarters), so that conserved parts alone bring no texts together; letters other than ACGT are one letter, case is ignored. Indels: the longer text less a few letters is the
    shorter; one indel joins by all but the piece that it is in, more by pieces of the shorter text. ``obs`` has seq, exp, sample, cnt.
    """
    unique = _unique(obs)
    near = _near(unique, max_diff, max_indel)
    near = near.join(unique.select(F.col("no").alias("no_a"), F.col("seq").alias("x")), "no_a").join(unique.select(F.col("no").alias("no_b"), F.col("seq").alias("y")), "no_b")
    pick = lambda p, q: F.when(F.col("a_less"), F.col(p)).otherwise(F.col(q))
    return near.select("exp", "sample", pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("cnt_a", "cnt_b").alias("cnt_a"), pick("cnt_b", "cnt_a").alias("cnt_b"))


def denoise(obs: DataFrame, threshold: float = 0.05, max_diff: int = 1, max_indel: int = 0, min_len: int = 1, max_len: int = 1000, min_count: int = 1, keep_internal: bool = True, min_retained: int = 10) -> DataFrame:
    """(seq, exp, sample, cnt, status, size) of the sequences kept; ``obs`` is long: seq, exp, sample, cnt.

    An edge leads from the rarer to the more frequent of two neighbours whose counts have a ratio
    of at most ``threshold`` (of equal counts from the greater sequence to the less). No edge makes a singleton, only incoming ones a head, any outgoing one internal.
    Sequences that keep fewer than ``min_retained`` reads are dropped. Null sequences are left out; rows of one (seq, exp, sample) are summed.
    Sequences have numbers until the end, when the counts kept fetch theirs.
    """
    unique = _unique(obs, min_count, min_len, max_len)
    release(unique.sparkSession)
    near = _near(unique, max_diff, max_indel, threshold)
    a_child = (F.col("cnt_a") < F.col("cnt_b")) | ((F.col("cnt_a") == F.col("cnt_b")) & ~F.col("a_less"))
    ends = near.select("exp", "sample", F.explode(F.array(F.struct(F.col("no_a").alias("no"), a_child.alias("out")), F.struct(F.col("no_b").alias("no"), (~a_child).alias("out")))).alias("e"))
    ends = ends.groupBy("e.no", "exp", "sample").agg(F.max("e.out").alias("out"))
    cells = unique.select("no", F.explode("cells").alias("c")).select("no", "c.exp", "c.sample", "c.cnt", F.lit(None).cast("boolean").alias("out"))
    # Counts and ends meet in one aggregation, and the sizes in the same partitions.
    joined = cells.unionByName(ends.withColumn("cnt", F.lit(None).cast(dict(cells.dtypes)["cnt"]))).repartition("no")
    status = F.when(F.col("out"), "internal").when(~F.col("out"), "head").otherwise("singleton")
    done = joined.groupBy("no", "exp", "sample").agg(F.max("cnt").alias("cnt"), F.max("out").alias("out")).select("no", "exp", "sample", "cnt", status.alias("status"))
    if not keep_internal:
        done = done.where("status <> 'internal'")
    done = done.withColumn("size", F.sum("cnt").over(Window.partitionBy("no"))).where(F.col("size") >= min_retained)
    return done.join(unique.select("no", "seq"), "no").select("seq", "exp", "sample", "cnt", "status", "size")


def denoised_headers(done: DataFrame, obs: DataFrame, prefix: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(id, seq): one record per sequence kept, its header with the size kept and the denoise block as JSON.

    ``done`` is the result of ``denoise``, ``obs`` its input, whose counts make total_count; ``prefix`` has seq and prefix.
    """
    total = obs.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.sum("cnt").alias("total_count"))
    many = lambda s: F.count_if(F.col("status") == s)
    summary = done.groupBy("seq").agg(F.first("size").alias("size"), *[many(s).alias(s) for s in ("head", "internal", "singleton")])
    cell = F.struct("sample", F.struct(F.col("cnt").alias("count"), "status").alias("v"))
    per_exp = done.groupBy("seq", "exp").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("m"))
    by = per_exp.groupBy("seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exp", F.struct(F.map_entries("m").alias("e")).alias("v"))))).alias("x"))
    by = by.select("seq", F.transform_values("x", lambda _, v: F.map_from_entries(v["e"])).alias("by_sample"))
    block = F.struct(F.lit(round(threshold, 3)).alias("threshold"), "total_count", F.struct("head", "internal", "singleton").alias("summary"), "by_sample")
    full = summary.join(total, "seq").join(by, "seq").join(prefix, "seq")
    return full.select(F.concat(F.col("prefix"), F.lit(";size="), F.col("size").cast("string"), F.lit(";"), F.to_json(F.struct(block.alias("denoise")))).alias("id"), "seq")
