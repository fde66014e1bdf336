"""Mixing sources to target shares of tokens by nested hash thresholds."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltflow.plans.lineage import store
from siltflow.plans.spread import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BITS = 12
LEVELS = 5  # all 60 bits of the hash, which stand in the upper part of 63

_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The id, the columns ``keep`` and n_tokens of the whole text by the named public tokenizer; null text has 0 tokens."""
    types = dict(df.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(tokenizer)
        for b in batches:
            texts = [x or "" for x in b.pop("_text")]
            n = [len(e.ids) for i in range(0, len(texts), 256) for e in t.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield b.assign(n_tokens=n)

    rows = spread(df.select(id_col, *keep, F.col(text_col).alias("_text")), id_col)
    return rows.mapInPandas(count, ", ".join([*(f"`{c}` {types[c]}" for c in (id_col, *keep)), "n_tokens bigint"]))


def _level(h: str, level: int):
    return F.shiftrightunsigned(F.col(h), 63 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix(sized: DataFrame, id_col: str, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(picked, shares) for rows with source and n_tokens; ``targets`` has source, target_share, max_repeats.

    Target shares are scaled to the sources that have tokens. The total is the largest at which no
    source needs more than max_repeats of each of its rows, so every share is met; a source's
    budget is as many whole rounds of all its rows as fit, and for the rest the rows below a hash
    threshold. The threshold is found without sorting: tokens are summed by source and hash
    bucket, and only the bucket in which the budget ends is refined, level by level. Rows of one
    full hash stand or fall together, so a budget is fallen short of by less than its next row (equal hashes apart).
    Repeated rows of an id count once. Rows whose source is null or not a target are not picked; shares lists them not,
    but every target, also those without rows. Negative or null shares count as 0, null max_repeats as 1.
    """
    goal = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats")
    )
    text = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))
    rows = store(
        sized.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min("source").alias("source"), F.min("n_tokens").alias("n_tokens"))
        .withColumn("h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") * 8)
    ).df
    totals = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = goal.join(totals, "source", "left").na.fill(0, ["n_docs", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everyone = Window.partitionBy()  # one row per target
    plan = (
        plan.withColumn("share", F.when(usable, F.col("target_share")).otherwise(F.lit(0.0)))
        .withColumn("share", F.when(F.sum("share").over(everyone) > 0, F.col("share") / F.sum("share").over(everyone)).otherwise(F.lit(0.0)))
        .withColumn("total", F.min(F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(everyone))
        .withColumn("budget", F.least(F.coalesce(F.floor(F.col("share") * F.col("total") + 1e-6), F.lit(0)), F.col("tokens") * F.col("max_repeats")))
        .withColumn("rounds", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("rounds") * F.col("tokens"))
    )
    plan = store(plan).df
    # (source, below, left): all hashes under ``below`` fit; ``left`` tokens may come from the open bucket.
    edge = plan.where("budget > 0").select("source", F.lit(0).cast("long").alias("below"), F.col("rest").alias("left"), F.lit(True).alias("open"))
    for level in range(LEVELS):
        width = 1 << (63 - BITS * (level + 1))
        at = edge.where("open")
        inside = (
            rows.join(F.broadcast(at), "source")  # one row per target
            .where((F.col("h") >= F.col("below")) & (F.col("h") - F.col("below") < F.lit(width << BITS) if level else F.lit(True)))
            .groupBy("source", "below", "left", _level("h", level).alias("bucket"))
            .agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        )
        upto = Window.partitionBy("source").orderBy("bucket")  # at most 2**BITS rows a source
        ends = (
            inside.withColumn("cum", F.sum("t").over(upto))
            .where(F.col("cum") > F.col("left"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "cum", "t", "n", "below", "left")).alias("e"))
            .select("source", (F.col("e.below") + F.col("e.bucket") * width).alias("below"), (F.col("e.left") - F.col("e.cum") + F.col("e.t")).alias("left"), (F.col("e.n") > 1).alias("open"))
        )
        kept = edge.join(F.broadcast(ends.select(F.col("source"), F.lit(1).alias("hit"))), "source", "left").where("not open").drop("hit")
        edge = store(kept.union(ends)).df
        if not edge.where("open").head(1):
            break
    picked = (
        rows.join(F.broadcast(plan.select("source", "rounds")), "source")
        .join(F.broadcast(edge.select("source", "below")), "source", "left")
        .withColumn("copies", (F.col("rounds") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("long"))
        .where("copies > 0")
        .select(id_col, "source", "n_tokens", "copies")
    )
    used = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    shares = (
        plan.join(F.broadcast(used), "source", "left")
        .na.fill(0, ["used_tokens", "most_copies"])
        .select("source", "target_share", "max_repeats", "n_docs", "tokens", F.col("budget").cast("long").alias("budget"), "used_tokens", "most_copies", F.when(F.sum("used_tokens").over(everyone) > 0, F.col("used_tokens") / F.sum("used_tokens").over(everyone)).otherwise(F.lit(0.0)).alias("actual_share"))
    )
    return picked, shares
