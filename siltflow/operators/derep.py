"""Unique sequences of reads, their headers, and record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dereplicate(reads: DataFrame, weighted: bool = False) -> DataFrame:
    """Long table (seq, exp, sample, cnt) of reads with seq, exp, sample and, when ``weighted``, size.

    The key is the exact, case-sensitive sequence; missing exp and sample read ``none`` and
    ``no_sample``. Reads without sequence are left out. Counting is partial before the shuffle, so a sequence that holds a third of all reads costs one row a task.
    """
    n = F.sum(F.coalesce("size", F.lit(1))) if weighted else F.count("*")
    return (
        reads.where(F.col("seq").isNotNull())
        .groupBy("seq", F.coalesce("exp", F.lit("none")).alias("exp"), F.coalesce("sample", F.lit("no_sample")).alias("sample"))
        .agg(n.cast("long").alias("cnt"))
    )


def unique_sequences(reads: DataFrame, order: str, carry: list[str]) -> DataFrame:
    """One row per sequence: total_count, the columns ``carry`` of its first read by ``order``, and exp_samples as map of maps."""
    first = reads.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.min_by(F.struct(*carry), F.col(order)).alias("f"))
    per_exp = dereplicate(reads).groupBy("seq", "exp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "cnt")))).alias("m"), F.sum("cnt").alias("n"))
    maps = per_exp.groupBy("seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exp", F.struct(F.map_entries("m").alias("e")).alias("m"))))).alias("x"), F.sum("n").alias("total_count"))
    maps = maps.select("seq", "total_count", F.transform_values("x", lambda _, v: F.map_from_entries(v["e"])).alias("exp_samples"))
    return maps.join(first, "seq").select("seq", *[F.col(f"f.{c}").alias(c) for c in carry], "total_count", F.length("seq").alias("seq_length"), "exp_samples")


def stat_header(prefix: Column, total: Column, length: Column, exp_samples: Column, pairend: Column | None = None) -> Column:
    """Header of a unique sequence: ``>prefix;size=N;`` and the stat block as valid JSON."""
    exp = F.transform_values(exp_samples, lambda _, m: F.struct(m.alias("samples")))
    parts = ([pairend.alias("pairend")] if pairend is not None else []) + [F.struct(exp.alias("exp"), total.alias("total_count"), length.alias("seq_length")).alias("stat")]
    return F.concat(F.lit(">"), prefix, F.lit(";size="), total.cast("string"), F.lit(";"), F.to_json(F.struct(*parts)))


def count_records(headers: DataFrame, col: str) -> DataFrame:
    """(records, size_sum): number of records and the sum of every ``size=`` in their headers; null headers count as records."""
    sizes = F.aggregate(F.transform(F.regexp_extract_all(F.col(col), F.lit("size=([0-9]+)"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return headers.agg(F.count("*").alias("records"), F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("size_sum"))
