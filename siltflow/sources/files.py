"""Readers and writers of the domain's file formats; formats are known here only."""

from __future__ import annotations

import gzip
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltflow.plans.lineage import store

# Columns of the exchange formats.
BLAST = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qcovs double, staxids string"
UC = "type string, cluster int, c_length int, similarity string, orientation string, N1 string, N2 string, N3 string, query_ID string, centroid_ID string"
NODES = "tax_id parent_tax_id rank embl_code division_id inherited_div_flag genetic_code_id inherited_gc_flag mito_genetic_code_id inherited_mgc_flag genbank_hidden_flag subtree_root_flag comments".split()


def sniff(path: str) -> tuple[bool, str]:
    """(gzip?, 'fastq' or 'fasta') of a local file, by its first two bytes and its first line that is not blank."""
    path = os.path.expanduser(path)
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    with (gzip.open if packed else open)(path, "rt", errors="replace") as f:
        first = next((line for line in f if line.strip()), "")
    return packed, "fastq" if first.startswith("@") else "fasta"


def sniff_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, packed, kind) of every file that is not empty at a path. Of local files only the beginning is read, of others the whole."""
    first = spark.read.format("binaryFile").load(os.path.expanduser(path)).where("length > 0").select("path")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *sniff(p.removeprefix("file:"))) for p in b.path], columns=["path", "packed", "kind"])

    if all(r[0].startswith("file:") for r in first.limit(1).collect()):
        return first.mapInPandas(look, "path string, packed boolean, kind string")
    head = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.substring(F.hex("content"), 1, 4).alias("m"))
    line = spark.read.text(path).select("_metadata.file_path", "value").where("trim(value) <> ''").groupBy("file_path").agg(F.first("value").alias("v"))
    return head.join(line, F.col("path") == F.col("file_path")).select("path", (F.col("m") == "1F8B").alias("packed"), F.when(F.col("v").startswith("@"), "fastq").otherwise("fasta").alias("kind"))


MOST_BLOCKS = 100_000  # file blocks whose offsets are broadcast; more are joined


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) in the order of files and lines, from 0.

    Lines are numbered within the blocks that Spark reads, and a table of one row per block tells how many come before. Lines never
    leave the JVM and are not shuffled.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(os.path.expanduser(path)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), in_task.alias("at"))
    blocks = store(lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))).df
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if blocks.count() <= MOST_BLOCKS:
        offsets = F.broadcast(offsets)
    known = lines.join(offsets, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return known.select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, id, seq, plus, qual) of a file of four-line records; an unfinished last record is left out, the id keeps its @."""
    lines = numbered_lines(spark, path)
    at = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("line")))
    recs = lines.groupBy(F.floor(F.col("line_no") / 4).alias("rec_no")).agg(at(0).alias("id"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"), F.count("*").alias("n"))
    return recs.where("n = 4").drop("n")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): records parted at each line that begins with >; lines of a record are joined, records without sequence are left out."""
    recs = spark.read.option("lineSep", "\n>").text(os.path.expanduser(path)).select(F.regexp_replace("value", "^>", "").alias("v"))
    parts = F.split("v", "\n", 2)
    return recs.select(F.regexp_replace(parts[0], "\r", "").alias("id"), F.regexp_replace(F.get(parts, F.lit(1)), "[\r\n]", "").alias("seq")).where("seq <> ''")


def fasta_lengths(fasta: DataFrame) -> DataFrame:
    """Index of a FASTA set: id and length."""
    return fasta.select("id", F.length("seq").alias("seqlength"))


def write_fasta(df: DataFrame, path: str, compress: bool = False, width: int | None = None) -> None:
    """Header and sequence lines, the latter of at most ``width`` letters; ``compress``, or a path that ends in .gz, writes gzip parts."""
    seq = F.col("seq") if width is None else F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    line = F.concat(F.lit(">"), F.regexp_replace("id", "^>", ""), F.lit("\n"), seq)
    df.select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip" if compress or path.lower().endswith(".gz") else "none")


def write_fastq(df: DataFrame, path: str, compress: bool = False) -> None:
    """Merged reads: id with its pairend block, sequence, plus, qualities."""
    head = df["id"]
    if "overlap" in df.columns:
        score = F.expr("rtrim('.', rtrim('0', format_string('%.6f', ovl_score)))")
        head = F.concat(F.replace("id", F.lit(" "), F.lit("_")), F.lit(';{"pairend":{"mismatch":'), F.col("mismatch").cast("string"), F.lit(',"overlap":'), F.col("overlap").cast("string"), F.lit(',"ovl_score":'), score, F.lit("}}"))
    df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value")).write.mode("overwrite").text(path, compression="gzip" if compress or path.lower().endswith(".gz") else "none")


def read_primer_table(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, exp, sample, tags, forward_primer, reverse_primer): comma or tab by the header, which may begin with #."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''").orderBy("line_no")
    header = lines.first()["line"]
    sep = "," if "," in header else "\t"
    names = [c.strip(' \t\r\n"').lstrip('# "') for c in header.split(sep)]
    cells = F.split("line", sep)
    cols = [F.trim(F.replace(F.get(cells, F.lit(names.index(c))), F.lit('"'), F.lit(""))).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("exp", "sample", "tags", "forward_primer", "reverse_primer")]
    table = lines.where(F.col("line") != header).select(F.col("line_no").alias("row_no"), *cols)
    return table.withColumns({c: F.upper(c) for c in ("tags", "forward_primer", "reverse_primer")})


def read_control_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, nullValue="NA")


def read_dmp(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A taxonomy dump: fields parted by tab, bar, tab."""
    cells = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    df = read_dmp(spark, path, NODES)
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("tax_id", "parent_tax_id")})


def read_names(spark: SparkSession, path: str) -> DataFrame:
    df = read_dmp(spark, path, ["tax_id", "name", "unique_name", "name_class"])
    return df.where("name_class = 'scientific name'").select(F.col("tax_id").cast("bigint").alias("tax_id"), "name")


def read_accessions(spark: SparkSession, *paths: str) -> DataFrame:
    """accession, `accession.version`, taxid of one or several accession files."""
    out = None
    for p in paths:
        df = spark.read.csv(p, sep="\t", header=True)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def make_database(out: str, nodes: DataFrame, names: DataFrame, accessions: DataFrame | None = None, overwrite: bool = False) -> None:
    """Taxonomy tables as Parquet; accessions are sorted within files, so that lookups skip row groups."""
    mode = "overwrite" if overwrite else "errorifexists"
    nodes.write.mode(mode).parquet(f"{out}/nodes")
    names.write.mode(mode).parquet(f"{out}/names")
    if accessions is not None:
        accessions.repartitionByRange("accession").sortWithinPartitions("accession").write.mode(mode).parquet(f"{out}/accession2taxid")


def read_checklist(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A checklist TSV, all text, with cleaned column names; the four required columns must be there."""
    from siltflow.operators.colmatch import clean_column

    df = spark.read.csv(path, sep="\t", header=True, quote="")
    df = df.toDF(*[clean_column(c) for c in df.columns])
    if missing := {"id", "parentid", "scientificname", "rank"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df = df.select(*[c for c in df.columns if columns is None or c in columns or c in ("id", "parentid", "scientificname", "rank", "status", "authorship")])
    return df.withColumnsRenamed({"id": "taxon_id", "parentid": "parent_id", "scientificname": "scientific_name"})


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=BLAST)


def read_uc(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema=UC)
    return df.withColumns({c: F.regexp_replace(c, ";size=.*", "") for c in ("query_ID", "centroid_ID")})


def write_listing(files: DataFrame, path: str) -> None:
    """The table of archives as CSV, for a later download."""
    files.write.mode("overwrite").csv(path, header=True)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="file_name string, date string, size_gb double")


def listing(pages: DataFrame, col: str) -> DataFrame:
    """(file_name, date, size_gb) of the archives in an HTML directory listing, one line a row."""
    pat = r'href="([^"]+)">[^<]*</a>\s+(\S+ \S+)\s+([0-9.]+)([KMG]?)'
    scale = F.when(F.col("unit") == "G", 1.0).when(F.col("unit") == "M", 1 / 1024).when(F.col("unit") == "K", 1 / 1024**2).otherwise(1 / 1024**3)
    df = pages.select(*[F.regexp_extract(col, pat, i + 1).alias(c) for i, c in enumerate(("file_name", "date", "size", "unit"))])
    return df.where("file_name like '%tar.gz'").select("file_name", "date", (F.col("size").try_cast("double") * scale).alias("size_gb"))


def archives_of(files: DataFrame) -> DataFrame:
    """(database, archives, size_gb): the parts ``<database>.<number>.tar.gz`` of each database and what they take together."""
    name = F.regexp_extract("file_name", r"^(.*?)(\.[0-9]+)?\.tar\.gz$", 1)
    return files.groupBy(name.alias("database")).agg(F.count("*").alias("archives"), F.sum("size_gb").alias("size_gb"))


def unpack(archive: str, to: str) -> list[str]:
    """Names of the members of a tar archive, unpacked into a folder."""
    with tarfile.open(os.path.expanduser(archive)) as t:
        t.extractall(to, filter="data")
        return t.getnames()
