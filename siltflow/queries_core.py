"""Queries of the core operators for training-data work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.operators import hierarchy, nested, skewagg, wide


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _forest(spark: SparkSession, d: str) -> DataFrame:
    """Links of both tree tables; the key's first part tells the table."""
    parts = []
    for tbl, i, p in (("nodes", "tax_id", "parent_tax_id"), ("col_taxa", "taxon_id", "parent_id")):
        link = hierarchy.links(_table(spark, d, tbl), i, p)
        parts.append(link.select(F.concat(F.lit(f"{tbl}|"), "id").alias("id"), F.concat(F.lit(f"{tbl}|"), "parent").alias("parent")))
    return parts[0].union(parts[1])


def _tbl(c: str):
    return F.substring_index(c, "|", 1)


def _key(c: str):
    return F.expr(f"substring({c}, locate('|', {c}) + 1)")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    done = hierarchy.resolve(_forest(spark, d))
    return done.select(_tbl("id").alias("tbl"), _key("id").alias("node_key"), F.when(F.col("root") == "", "").otherwise(_key("root")).alias("root_key"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    done = hierarchy.resolve(_forest(spark, d), paths=True)
    names = F.array_join(F.transform("path", lambda x: F.substring_index(x, "|", -1)), "/")
    return done.select(_tbl("id").alias("tbl"), _key("id").alias("node_key"), "depth", names.alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.resolve(_forest(spark, d), paths=True))
    return pairs.select(_tbl("id").alias("tbl"), _key("ancestor").alias("node_key"), _key("id").alias("descendant_key"), "steps")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(_table(spark, d, "fasta_to_table"), [])


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    cells = _table(spark, d, "fasta_to_table")
    return wide.wide_table(cells, wide.tags_of(cells))


def p6_rows_node(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(_table(spark, d, "node"), "node_id", "raw_header", nested.HEADER_KEYED, nested.HEADER_NAMES, nested.header_json)


def p6_rows_unique_info(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(_table(spark, d, "unique_info"), "uniq_id", "pairend_json", {}, nested.PAIREND_NAMES, nested.pairend_json)


def _whole(c: str):
    return F.expr(f"try_cast(try_cast({c} as decimal(38, 6)) as bigint)")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    samples = p6_rows_node(spark, d).where(
        F.col("relation").isin("denoise/by_sample/*", "denoise/by_sample/samples") | ((F.col("relation") == "stat/exp/samples") & ~F.array_contains("blocks", "denoise"))
    )
    node = samples.select(
        F.lit("node").alias("tbl"),
        F.col("rec_id").cast("bigint").alias("rec_id"),
        F.element_at("above", -1).alias("parent_key"),
        F.col("key").alias("child_key"),
        F.coalesce(*[_whole(f"cols['{c}']") for c in ("count", "n", "value")]).alias("val"),
    )
    pairs = p6_rows_unique_info(spark, d).where(F.col("relation").isin("pairend", "pairend/lanes/pairs") & F.expr("cols['overlap'] is not null"))
    info = pairs.select(
        F.lit("unique_info").alias("tbl"),
        F.col("rec_id").cast("bigint").alias("rec_id"),
        F.when(F.col("relation") == "pairend", "").otherwise(F.element_at("above", -1)).alias("parent_key"),
        F.col("pos").cast("string").alias("child_key"),
        _whole("cols['overlap']").alias("val"),
    )
    return node.union(info).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Records without text, with text that cannot be read, and read ones, by table."""
    node = nested.reading_report(_table(spark, d, "node"), "node_id", "raw_header", nested.header_json)
    info = nested.reading_report(_table(spark, d, "unique_info"), "uniq_id", "pairend_json", nested.pairend_json)
    return node.select(F.lit("node").alias("tbl"), "*").union(info.select(F.lit("unique_info").alias("tbl"), "*"))


def _map_totals(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        skewagg.key_totals(skewagg.map_entries(_table(spark, d, t), i, m)).select(F.lit(t).alias("tbl"), "*")
        for t, i, m in (("node", "node_id", "exp_sample_count"), ("unique_info", "uniq_id", "exp_samples"))
    ]


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    a, b = _map_totals(spark, d)
    return a.union(b)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    totals = p7_totals(spark, d)
    per = totals.groupBy(F.col("tbl").alias("of")).agg(F.sum("n_entries").alias("everything"))
    return totals.join(F.broadcast(per), F.col("tbl") == F.col("of")).where("n_entries * 100 > everything * 3").select("tbl", "exp", "sample")  # per: one row a table


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p5_found, p5_wide, p6_found, p6_report, p7_found, p7_totals)}
