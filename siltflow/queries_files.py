"""Queries that write whole tables in a file format and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.functions import iupac
from siltflow.operators import colmatch, denoise, nested
from siltflow.plans.lineage import ensure_checkpoint_dir
from siltflow.queries_ref import _observations, _table
from siltflow.sources import files


def _folder(spark: SparkSession, ending: str = "") -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}{ending}"


def _plain(df: DataFrame, path: str, sep: str = "\t", header: bool = False, null: str = "") -> str:
    """Fields as they are, parted by ``sep``."""
    w = df.write.option("quote", "").option("comment", "\1").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.csv(path, sep=sep, header=header, nullValue=null, emptyValue="")
    return path


def _merged_reads(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where("text is not null").select(
        F.concat(F.lit("@doc "), "doc_id").alias("id"), iupac.dna(F.col("text")).alias("seq"), F.lit("I" * 32).alias("qual"),
        (F.col("doc_id") % 5).cast("int").alias("mismatch"), (F.col("doc_id") % 20 + 10).cast("int").alias("overlap"), ((F.col("doc_id") % 40) / 4 + 1).alias("ovl_score"),
    )


def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_fastq(_merged_reads(spark, d).drop("mismatch", "overlap", "ovl_score"), path)
    return files.read_fastq(spark, path).select("id", "seq", "plus", "qual")


def fastq_merged_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, ".fq.gz")
    files.write_fastq(_merged_reads(spark, d), path)
    return files.read_fastq(spark, path).select("id", "seq", "plus", "qual")


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "node").where("node_id is not null and seq is not null").groupBy(F.concat(F.lit("n"), "node_id").alias("id")).agg(F.min("seq").alias("seq"))


def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, ".FAS.GZ")
    files.write_fasta(_sequences(spark, d), path)
    return files.read_fasta(spark, path)


def fasta_index(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of sequences that were written in lines of 60 letters."""
    path = _folder(spark)
    files.write_fasta(_sequences(spark, d), path, width=60)
    return files.fasta_lengths(files.read_fasta(spark, path))


def sniffed_files(spark: SparkSession, d: str) -> DataFrame:
    """What the bytes of the parts written say of them, by format."""
    a, b = _folder(spark, ".gz"), _folder(spark)
    files.write_fastq(_merged_reads(spark, d), a)
    files.write_fasta(_sequences(spark, d), b)
    return files.sniff_folder(spark, a).union(files.sniff_folder(spark, b)).select("kind", "packed").distinct()


def primer_table_file(spark: SparkSession, d: str) -> DataFrame:
    tag = F.lower(F.concat(F.substring(iupac.dna(F.col("tag")), 1, 8), F.lit(":"), F.substring(iupac.dna(F.reverse("tag")), 1, 8)))
    rows = _table(spark, d, "control_table").where("tag is not null").select(
        F.lit("trnL").alias("#exp"), F.col("tag").alias("sample"), tag.alias("tags"), F.lit("gggcaatcctgagccaa").alias("forward_primer"), F.lit("CCATTGAGTCTCTGCACCTATC").alias("reverse_primer")
    )
    return files.read_primer_table(spark, _plain(rows, _folder(spark), header=True)).drop("row_no")


def control_file(spark: SparkSession, d: str) -> DataFrame:
    return files.read_control_table(spark, _plain(_table(spark, d, "control_table"), _folder(spark), ",", header=True, null="NA"))


def _dump(df: DataFrame, path: str) -> str:
    line = F.concat(F.concat_ws("\t|\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit("\t|"))
    df.select(line.alias("value")).write.text(path)
    return path


def nodes_dump(spark: SparkSession, d: str) -> DataFrame:
    return files.read_nodes(spark, _dump(_table(spark, d, "nodes").select(*files.NODES).distinct(), _folder(spark)))


def names_dump(spark: SparkSession, d: str) -> DataFrame:
    """Scientific names out of a dump that holds a synonym beside each."""
    n = _table(spark, d, "tax_names").distinct()
    kinds = F.explode(F.array(F.lit("scientific name"), F.lit("synonym")))
    return files.read_names(spark, _dump(n.select("tax_id", "name", F.lit("").alias("unique_name"), kinds.alias("name_class")), _folder(spark)))


def accession_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files with other columns in another order, read as one table."""
    o = _table(spark, d, "orders")
    acc, ver = F.concat(F.lit("A"), "o_orderkey").alias("accession"), F.concat(F.lit("A"), "o_orderkey", F.lit(".1")).alias("accession.version")
    one = _plain(o.where("o_orderkey % 2 = 0").select(acc, ver, F.col("o_custkey").alias("taxid"), F.lit(0).alias("gi")), _folder(spark), header=True)
    two = _plain(o.where("o_orderkey % 2 = 1").select(ver, F.col("o_custkey").alias("taxid"), acc), _folder(spark), header=True)
    return files.read_accessions(spark, one, two).select("accession", F.col("`accession.version`").alias("version"), F.col("taxid").cast("bigint").alias("taxid"))


def checklist_file(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "col_taxa").select(
        F.col("taxon_id").alias("col:ID"), F.col("parent_id").alias("col:parentID"), F.regexp_replace("scientific_name", "[\\t\\r\\n]", " ").alias("col:scientificName"), F.col("rank").alias("col:rank"), F.col("status").alias("col:status"), F.regexp_replace("authorship", "[\\t\\r\\n]", " ").alias("col:authorship"), F.lit("x").alias("col:remarks")
    ).distinct()
    return files.read_checklist(spark, _plain(t, _folder(spark), header=True), [])


def checklist_columns(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned names of columns, made of the types of parts."""
    types = _table(spark, d, "part").select(F.concat(F.lit("COL:"), "p_type", F.lit("-"), "p_size").alias("raw")).distinct()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(clean=b.raw.map(colmatch.clean_column))

    return types.mapInPandas(clean, "raw string, clean string")


def blast_file(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    rows = li.select(
        F.col("l_partkey").alias("q"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("s"), (100 - F.col("l_discount") * 100).cast("int").alias("pident"), F.col("l_quantity").cast("int").alias("length"),
        (F.col("l_linenumber") - 1).alias("mismatch"), F.lit(0).alias("gap"), F.lit(1).alias("qs"), F.col("l_quantity").cast("int").alias("qe"), F.lit(5).alias("ss"), (F.col("l_quantity") + 4).cast("int").alias("se"),
        F.lit("1e-30").alias("evalue"), (F.col("l_quantity") * 2).alias("bits"), F.lit(100).alias("cov"), F.concat_ws(";", "l_suppkey", "l_linenumber").alias("tax"),
    )
    return files.read_blast(spark, _plain(rows, _folder(spark)))


def clusters_file(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "node").where("node_id is not null").select("node_id", "total_count").groupBy("node_id").agg(F.min("total_count").alias("k"))
    name = lambda x: F.concat(F.lit("n"), x, F.lit(";size="), F.coalesce("k", F.lit(0)))
    star = F.lit("*")
    rows = n.select(F.lit("H"), (F.col("node_id") % 100).cast("int"), F.lit(120), F.lit("98.5"), F.lit("+"), F.lit(0), F.lit(0), star, name(F.col("node_id").cast("string")), name((F.col("node_id") % 100).cast("string")))
    rows = rows.toDF(*[f"c{i}" for i in range(10)])
    return files.read_uc(spark, _plain(rows, _folder(spark))).select("type", "cluster", "c_length", "similarity", "orientation", "query_ID", "centroid_ID")


def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """Archives of a directory page, written as CSV and read again."""
    name = F.concat(F.lit("nt."), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".tar.gz"), F.when(F.col("p_partkey") % 3 == 0, ".md5").otherwise(""))
    unit = F.when(F.col("p_partkey") % 2 == 0, "G").otherwise("M")
    page = _table(spark, d, "part").select(F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a>   2024-01-02 03:04  "), "p_size", F.lit(".5"), unit).alias("line"))
    path = _folder(spark)
    files.write_listing(files.listing(page, "line"), path)
    return files.read_listing(spark, path).withColumn("size_gb", F.round("size_gb", 6))


def archive_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Databases of a directory page with their parts; the brands stand for databases."""
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(".tar.gz"))
    page = _table(spark, d, "part").select(F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a>   2024-01-02 03:04  "), "p_size", F.lit("G")).alias("line"))
    return files.archives_of(files.listing(page, "line"))


def iupac_matches(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold a pattern with ambiguity codes."""
    return _table(spark, d, "node").where("node_id is not null and seq is not null").select("node_id", F.upper("seq").rlike(iupac.class_regex("ACYGRNTW")).alias("found")).distinct()


def taxonomy_database(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with names and accessions out of a database made of them."""
    out, o = _folder(spark), _table(spark, d, "orders")
    acc = o.select(F.concat(F.lit("A"), "o_orderkey").alias("accession"), (F.col("o_custkey") % 1500).alias("taxid"))
    nodes = _table(spark, d, "nodes").select("tax_id", "parent_tax_id", "rank").distinct()
    files.make_database(out, nodes, _table(spark, d, "tax_names").distinct(), acc)
    n, names, a = (spark.read.parquet(f"{out}/{t}") for t in ("nodes", "names", "accession2taxid"))
    counts = a.groupBy(F.col("taxid").alias("tax_id")).agg(F.count("*").alias("accessions"), F.min("accession").alias("first_accession"))
    return n.join(names, "tax_id", "left").join(counts, "tax_id", "left").select("tax_id", "parent_tax_id", "rank", "name", "accessions", "first_accession")


def denoise_headers(spark: SparkSession, d: str) -> DataFrame:
    """Denoised records as FASTA, read back, and their counts taken out of the headers."""
    obs, path = _observations(spark, d), _folder(spark, ".gz")
    prefix = obs.where("seq is not null").select("seq", F.concat(F.lit("s"), F.substring(F.md5("seq"), 1, 12)).alias("prefix")).distinct()
    files.write_fasta(denoise.denoised_headers(denoise.denoise(obs), obs, prefix), path)
    back = files.read_fasta(spark, path)
    cells = nested.shred(back.withColumn("key", F.xxhash64("id")), "key", "id", nested.HEADER_KEYED, nested.HEADER_NAMES, nested.header_json).where("relation = 'denoise/by_sample/*'")
    cells = cells.select("rec_id", F.element_at("above", -1).alias("exp"), F.col("key").alias("sample"), F.expr("try_cast(cols['count'] as bigint)").alias("cnt"), F.expr("cols['status']").alias("status"))
    size = F.regexp_extract("id", ";size=([0-9]+);", 1).cast("bigint")
    return cells.join(back.select(F.xxhash64("id").cast("string").alias("rec_id"), "seq", size.alias("size")), "rec_id").drop("rec_id")


QUERIES = {
    f.__name__: f
    for f in (
        fastq_records, fastq_merged_records, fasta_records, fasta_index, sniffed_files, primer_table_file, control_file, nodes_dump, names_dump, accession_files, checklist_file, checklist_columns, blast_file, clusters_file,
        archive_listing, archive_sizes, iupac_matches, taxonomy_database, denoise_headers,
    )
}
