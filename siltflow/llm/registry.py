"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.llm import leaks, lookalikes, mixing, names, near, spans
from siltflow.llm.sql import SQL


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    done = lookalikes.unify(_table(spark, d, "col_taxa"), "taxon_id", ["scientific_name", "scientific_name_fuzzy"])
    return done.select(F.col("id").alias("taxon_id"), "col_name", F.col("clean").alias("clean_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.similar_records(_table(spark, d, "node"), "node_id", "seq", "exp_sample_count")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _table(spark, d, "col_taxa").where("rank = 'species' and trim(scientific_name) <> '' and taxon_id is not null")
    one = typed.groupBy("taxon_id").agg(F.min("scientific_name").alias("scientific_name"))
    done = names.match_names(one, "taxon_id", "scientific_name", _table(spark, d, "taxon_reference"))
    return done.select(F.col("id").alias("taxon_id"), names.decided().alias("ref_id"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    done = leaks.find_leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "benchmark"), "item_id", "text")
    return done.select("doc_id", "item_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.token_counts(_table(spark, d, "documents"), "doc_id", "text", ["source"])
    return mixing.mix(sized, "doc_id", _table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _mixed_by_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same mix with characters as sizes, which SQL has as well."""
    sized = _table(spark, d, "documents").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_tokens"))
    return mixing.mix(sized, "doc_id", _table(spark, d, "mix_targets"))


def p9_mix_by_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_by_chars(spark, d)[0]


def p9_shares_by_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_by_chars(spark, d)[1].withColumn("actual_share", F.round("actual_share", 9))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_table(spark, d, "documents"), "doc_id", "text").select("doc_id", "shared_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p4_found, p8_found, p9_mix, p9_shares, p9_mix_by_chars, p9_shares_by_chars, p10_found)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
