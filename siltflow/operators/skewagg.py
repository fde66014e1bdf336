"""Per-key results over map columns of which a few keys fill most entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.plans.skew import salted_aggregate


def map_entries(df: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """(rec_id, exp, sample, cnt): one row per entry of a map of maps, repeated rows of an id counting once.

    Of repeated rows one with a map is kept, of differing maps the one whose text has the greatest hash. Null maps, null inner maps and empty maps give no rows; rows without id are left out.
    """
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("rec_id")).agg(F.max_by(map_col, F.when(F.col(map_col).isNotNull(), F.xxhash64(F.to_json(map_col)))).alias("m"))
    return one.select("rec_id", F.explode("m").alias("exp", "inner")).select("rec_id", "exp", F.explode("inner").alias("sample", "cnt"))


def key_totals(entries: DataFrame, salts: int = 32) -> DataFrame:
    """(exp, sample, n_entries, total_count, max_count) by two-stage salted aggregation."""
    return salted_aggregate(
        entries,
        ["exp", "sample"],
        {"n": F.count("*"), "t": F.sum("cnt"), "m": F.max("cnt")},
        {"n_entries": F.sum("n"), "total_count": F.sum("t"), "max_count": F.max("m")},
        F.col("rec_id"),
        salts,
    )
