"""Numbers in sorted order without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltflow.plans.lineage import store


def numbered(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with its place, from 1, in ``order`` among the rows of the same ``keys``; nulls are keys and values like others.

    Rows are sorted over ranges of (keys, order), so a key that holds a large part of all rows lies in several ranges. Places within a range are
    counted there, and what lies before comes from a table of one row per range and key. ``order`` should be unique within the keys.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *order]
    group = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_group": group})
    rows = store(ranged).df
    counts = rows.groupBy("_range", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    offsets = counts.select("_range", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_range", "_group").orderBy(*order)
    return rows.withColumn("_here", F.row_number().over(here)).join(offsets, ["_range", "_group"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_range", "_group", "_before", "_here")
