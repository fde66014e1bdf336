"""Detection and salting of keys that hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """Keys that may hold more than ``share`` of the rows of ``df`` (a superset, at most 1/share keys).

    A frequent-items sketch over all rows: it is mergeable, never misses a key above the
    share, and holds at most 1/share keys whatever the size of the input, so its result may be
    broadcast. Null keys are ordinary keys. An empty input gives no keys.
    """
    spark = df.sparkSession
    key = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    found = df.select(key.alias("k")).freqItems(["k"], share).first()
    rows = [(k,) for k in (found[0] if found and found[0] else [])]
    return spark.createDataFrame(rows, "heavy_key string").distinct()


def hot_values(df: DataFrame, col: str, share: float = 0.01) -> list:
    """Values of ``col`` that may be in more than ``share`` of the rows: at most 1/share, none missed, null not told."""
    found = df.select(col).freqItems([col], share).first()
    return [v for v in (found[0] if found and found[0] else []) if v is not None]


def salted_lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, hot: Sequence, how: str = "inner", salts: int = 32, also: Column | None = None) -> DataFrame:
    """Join ``left.key`` to ``right_key``, and ``also`` where given, in which ``right`` is unique and some keys hold a large part of ``left``.

    Rows of the ``hot`` keys are spread by a hash of themselves, and the few rows of ``right`` that they meet are repeated
    for every salt. Both frames must have different column names.
    """
    on = F.col(key) == F.col(right_key)
    on = on if also is None else on & also
    if not hot:
        return left.join(right, on, how)
    own = F.when(F.col(key).isin(list(hot)), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(F.col(right_key).isin(list(hot)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    many = right.withColumn("_copy", F.explode(copies))
    return left.withColumn("_salt", own.cast("int")).join(many, on & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partials: Mapping[str, Column],
    merges: Mapping[str, Column],
    spread: Column,
    salts: int = 32,
    share: float = 0.01,
) -> DataFrame:
    """Two-stage aggregation in which only heavy keys are salted.

    Stage one groups by (keys, salt) and computes ``partials``; stage two groups by the keys and
    computes ``merges`` over the partial columns. Rows of light keys carry salt 0 and so are
    combined where they arrive. ``spread`` is hashed to give the salt; it has to differ between the rows of a key (a record id), which keeps a
    retried task's output the same, unlike a random number. Null keys form one group of their own.
    """
    heavy = heavy_keys(df, keys, share)
    tagged = (
        df.withColumn("_key", F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}))
        .join(F.broadcast(heavy), F.col("_key") == F.col("heavy_key"), "left")  # at most 1/share rows
        .withColumn("_salt", F.when(F.col("heavy_key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)))
    )
    one = tagged.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return one.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])
