"""Spreading rows over tasks for work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Hash rows over at least ``per_core`` tasks a core; ``keys`` should be nearly unique."""
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(spark.sparkContext.defaultParallelism * per_core, usual)
    # An exchange of the usual number by the same keys would be taken for this one, and its partitions joined by their bytes.
    return df.repartition(n + (n == usual), *keys)
