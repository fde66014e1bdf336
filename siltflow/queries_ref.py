"""Queries of the metabarcoding operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.functions import iupac
from siltflow.operators import colmatch, denoise, derep, tables, taxonomy


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("rec_no"), F.col("doc_id").cast("string").alias("prefix"), iupac.dna(F.col("text")).alias("seq"), F.col("lang").alias("exp"), F.col("source").alias("sample"))


def dereplicate(spark: SparkSession, d: str) -> DataFrame:
    return derep.dereplicate(_reads(spark, d))


def dereplicate_headers(spark: SparkSession, d: str) -> DataFrame:
    u = derep.unique_sequences(_reads(spark, d), "rec_no", ["prefix"])
    back = F.from_json(F.regexp_extract(derep.stat_header(F.col("prefix"), F.col("total_count"), F.col("seq_length"), F.col("exp_samples")), r"(\{.*)", 1), "struct<stat:struct<exp:map<string,struct<samples:map<string,bigint>>>,total_count:bigint>>")
    long = u.select("seq", "prefix", back.alias("j")).select("seq", "prefix", F.col("j.stat.total_count").alias("total_count"), F.explode("j.stat.exp").alias("exp", "v"))
    return long.select("seq", "prefix", "total_count", "exp", F.explode("v.samples").alias("sample", "cnt"))


def count_records(spark: SparkSession, d: str) -> DataFrame:
    return derep.count_records(_table(spark, d, "node"), "raw_header")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators.skewagg import map_entries

    n = _table(spark, d, "node")
    seq = n.where("node_id is not null").groupBy("node_id").agg(F.min("seq").alias("seq"))
    return map_entries(n, "node_id", "exp_sample_count").join(seq, F.col("rec_id") == F.col("node_id")).select("seq", "exp", "sample", "cnt")


def denoise_default(spark: SparkSession, d: str) -> DataFrame:
    return denoise.denoise(_observations(spark, d))


def denoise_loose(spark: SparkSession, d: str) -> DataFrame:
    return denoise.denoise(_observations(spark, d), threshold=0.5, max_diff=3, max_indel=1, keep_internal=False)


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    base = iupac.dna((F.col("user_id") % 5).cast("string"))
    at = (F.floor(F.col("event_id") / 10) % 32).cast("int")
    letter = F.when(F.substring(base, at + 1, F.lit(1)) == "A", "C").otherwise("A")
    seq = F.when(F.col("event_id") % 10 == 0, F.concat(F.substring(base, F.lit(1), at), letter, F.substring(base, at + 2, F.lit(32)))).otherwise(base)
    return derep.dereplicate(e.select(seq.alias("seq"), F.col("event_type").alias("exp"), (F.col("event_id") % 4).cast("string").alias("sample")))


def denoise_events(spark: SparkSession, d: str) -> DataFrame:
    return denoise.denoise(_events(spark, d))


def fasta_to_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.fasta_to_table(_table(spark, d, "node"), "node_id", "seq", "raw_header")


def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.sequence_ids(_table(spark, d, "node").select(F.col("seq").alias("SEQ")).distinct())


def latest_cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest_cells(_table(spark, d, "fasta_to_table"))


def _decontaminated(spark: SparkSession, d: str, method: str) -> DataFrame:
    return tables.decontaminate(latest_cells(spark, d), _table(spark, d, "control_table"), method)


def _merged(spark: SparkSession, d: str, method: str, n: int = 1, pa: bool = False) -> DataFrame:
    out = tables.merge_replicates(latest_cells(spark, d), _table(spark, d, "control_table"), method, n, pa)
    return out.withColumn("value", F.round("value", 9))


def merge_wide(spark: SparkSession, d: str) -> DataFrame:
    long = _merged(spark, d, "mean_rra", pa=True)
    return tables.to_wide(long, ["experiment", "id"], F.concat("grp", F.lit("_"), "sample"), "value", tables.replicate_columns(_table(spark, d, "control_table")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    li, s, n, r = (_table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    tax = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    tax = tax.select(
        "s_suppkey", F.col("r_name").alias("kingdom"), F.col("n_name").alias("phylum"), F.concat(F.lit("C"), F.col("s_suppkey") % 7).alias("class"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("O"), F.col("s_suppkey") % 11)).alias("order"),
        F.concat(F.lit("F"), F.col("s_suppkey") % 20).alias("family"), F.concat(F.lit("G "), F.col("s_suppkey") % 50).alias("genus"), F.col("s_name").alias("species"),
    )
    return li.join(tax, li.l_suppkey == tax.s_suppkey).select(
        F.col("l_partkey").alias("qseqid"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("sseqid"), F.col("l_suppkey").alias("staxids"), "l_orderkey", "l_linenumber",
        (100 - F.floor(F.round(F.col("l_discount") * 100) / 6)).cast("int").alias("pident"), F.floor(F.round(F.col("l_tax") * 100) / 5).cast("int").alias("evalue"), (100 - F.floor(F.col("l_quantity") / 26)).cast("int").alias("qcovs"),
        *taxonomy.RANKS,
    )


def find_lca(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.find_lca(_hits(spark, d), ["l_orderkey", "l_linenumber"])


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    names = _table(spark, d, "tax_names").where("name is not null and tax_id is not null").groupBy("tax_id").agg(F.min("name").alias("name"))
    nodes = _table(spark, d, "nodes").select("tax_id", "parent_tax_id", "rank").distinct().join(names, "tax_id", "left")
    return taxonomy.lineages(nodes, "tax_id", "parent_tax_id", "rank", "name")


def get_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "nodes").select(F.col("tax_id").alias("query_tax_id")).union(_table(spark, d, "nodes").select(F.col("parent_tax_id"))).distinct()
    return taxonomy.get_taxonomy(asked, _lineage(spark, d), "query_tax_id")


def taxids_of_names(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "col_taxa").select(F.col("scientific_name").alias("query")).union(_table(spark, d, "tax_names").select("name")).distinct()
    return taxonomy.taxids_of_names(asked, _table(spark, d, "tax_names"), "query")


def _accessions(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    return o.select(F.concat(F.lit("A"), "o_orderkey").alias("accession"), F.concat(F.lit("A"), "o_orderkey", F.lit("."), F.lit(1)).alias("accession.version"), F.col("o_custkey").alias("taxid"))


def get_taxid(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "lineitem").select(F.concat(F.lit("A"), F.col("l_orderkey") * 2 - F.col("l_linenumber"), F.lit(".1")).alias("query"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("rec"))
    return taxonomy.get_taxid(asked, _accessions(spark, d), "query", versioned=True)


def format_to_dada(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.dada_headers(_lineage(spark, d))


def col_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "col_taxa").where("scientific_name_norm is not null").select("taxon_id", colmatch.normalise(F.col("scientific_name")).alias("norm")).distinct()


def _checklist(spark: SparkSession, d: str) -> DataFrame:
    return colmatch.build(_table(spark, d, "col_taxa"))


def col_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _checklist(spark, d).select("taxon_id", *colmatch.LINEAGE)


def col_match_exact(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "taxon_reference").select("ref_id", F.col("canonical_name").alias("query"), "genus")
    return colmatch.match(asked.drop("genus"), "query", _checklist(spark, d), return_all=True).drop(*colmatch.LINEAGE)


def col_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "taxon_reference").select("ref_id", F.col("canonical_name").alias("query"))
    return colmatch.match(asked, "query", _checklist(spark, d), fuzzy=True, max_dist=2).drop(*colmatch.LINEAGE)


def _match_by(spark: SparkSession, d: str, method: str) -> DataFrame:
    asked = _table(spark, d, "taxon_reference").select("ref_id", F.col("canonical_name").alias("query"))
    return colmatch.match(asked, "query", _checklist(spark, d), fuzzy=True, max_dist=2, method=method).drop(*colmatch.LINEAGE)


_PLAIN = (
    dereplicate, dereplicate_headers, count_records, denoise_default, denoise_loose, denoise_events, fasta_to_table, sequence_ids, latest_cells, merge_wide, find_lca, get_taxonomy, taxids_of_names, get_taxid,
    format_to_dada, col_normalise, col_lineage, col_match_exact, col_match_fuzzy,
)
QUERIES = {f.__name__: f for f in _PLAIN}
QUERIES |= {f"decontamination_{m}": (lambda s, d, m=m: _decontaminated(s, d, m)) for m in tables.METHODS}
QUERIES |= {f"col_match_{m}": (lambda s, d, m=m: _match_by(s, d, m)) for m in ("hamming", "dl")}
QUERIES |= {
    "merge_replicate_mean_rra": lambda s, d: _merged(s, d, "mean_rra"),
    "merge_replicate_max_rra": lambda s, d: _merged(s, d, "max_rra"),
    "merge_replicate_both_occur": lambda s, d: _merged(s, d, "both_occur", 1),
    "merge_replicate_present_absent": lambda s, d: _merged(s, d, "both_occur", 1, True),
}


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "node").where("node_id is not null").groupBy(F.col("node_id").cast("string").alias("name")).agg(F.min("seq").alias("seq"))


FORWARD, REVERSE = "AACTATGGACAG", "GGTCTGTC"


def find_primer_binding_sites(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import primers

    return primers.find_primer_binding_sites(_refs(spark, d), FORWARD, max_mismatch=2)


def in_silico(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import primers

    return primers.in_silico(_refs(spark, d), [(FORWARD, "ACGGT"), ("GAGGCGCTTG", "TAGC")], mis_match=0, max_hits=100_000)


def in_silico_strict(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import primers

    return primers.in_silico_multiprimer(_refs(spark, d), ["AACTAT#GGACRG"], ["ACGGTNA#C"], mis_match=2, try_reverse=True, trim=False)


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _table(spark, d, "documents").select(F.col("doc_id").alias("rec_no"), F.concat(iupac.dna(F.col("text")), iupac.dna(F.reverse("text"))).alias("t"))
    odd = F.when(F.col("rec_no") % 3 == 0, F.concat(F.lit("A"), F.substring("t", 22, 43))).otherwise(F.substring("t", 21, 44))
    one = t.select("rec_no", F.concat(F.lit("@r"), "rec_no").alias("id"), F.substring("t", 1, 44).alias("seq"), F.lit("I" * 44).alias("qual"))
    two = t.select("rec_no", F.concat(F.lit("@r"), "rec_no").alias("id"), iupac.reverse_complement(odd).alias("seq"), F.lit("5" * 44).alias("qual"))
    return one, two


def pairend(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import pairend as p

    return p.pairend(*_pairs(spark, d)).select("rec_no", "seq", "mismatch", "overlap")


def _tagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    table = _table(spark, d, "control_table").where("tag is not null").select(F.expr("cast(substring(tag, 2) as bigint)").alias("row_no"), F.lit("trnL").alias("exp"), F.col("tag").alias("sample"), F.substring(iupac.dna(F.col("tag")), 1, 8).alias("tags"))
    table = table.withColumns({"forward_primer": F.lit("GGGCAATCCTGAGCCAA"), "reverse_primer": F.lit("CCATTGAGTCTCTGCACCTATC")})
    n = _table(spark, d, "documents").select(F.col("doc_id").alias("rec_no"), F.concat(F.lit("F"), F.lpad((F.col("doc_id") % 300).cast("string"), 3, "0")).alias("tag"), iupac.dna(F.col("text")).alias("insert"))
    tag = F.substring(iupac.dna(F.col("tag")), 1, 8)
    fwd = F.when(F.col("rec_no") % 5 == 0, "GGGCTATCCTGAGCGAA").otherwise("GGGCAATCCTGAGCCAA")
    read = F.concat(F.lit("CT"), tag, fwd, "insert", iupac.reverse_complement(F.lit("CCATTGAGTCTCTGCACCTATC")), iupac.reverse_complement(tag), F.lit("A"))
    return n.select("rec_no", F.col("rec_no").cast("string").alias("id"), F.when(F.col("rec_no") % 2 == 0, iupac.reverse_complement(read)).otherwise(read).alias("seq")), table


def demultiplex(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import primers

    reads, table = _tagged(spark, d)
    return primers.demultiplex(reads, table, primer_mismatch=3).select("rec_no", "identified", "sample", F.when(F.col("identified"), F.col("seq")).alias("insert"), "fwd_mismatch", "rev_mismatch")


def _rarefied(spark: SparkSession, d: str, q: int) -> DataFrame:
    from siltflow.operators import diversity

    out = diversity.rarefaction(latest_cells(spark, d), q=q)
    return out.withColumns({"qD": F.round("qD", 6), "SC": F.round("SC", 6)})


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).groupBy("seq").agg(F.sum("cnt").alias("size"))


def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import cluster

    obs = _observations(spark, d)
    clusters = cluster.greedy_clusters(_sized(spark, d), 0.97, "length")
    return cluster.cluster_table(obs.select(F.col("exp").alias("experiment"), F.col("seq").alias("SEQ"), "sample", F.col("cnt").alias("count")), clusters)


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import cluster

    return cluster.similar_pairs(_sized(spark, d).select("seq"), 0.97)


def chimeras(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import cluster

    return cluster.chimeras(_sized(spark, d)).select("seq", "size", "chimeric")


def chimeras_ref(spark: SparkSession, d: str) -> DataFrame:
    """Records with the unique sequences as reference."""
    from siltflow.operators import cluster

    asked = _table(spark, d, "node").where("seq is not null").groupBy(F.upper("seq").alias("seq")).agg(F.max(F.coalesce("total_count", F.lit(0))).alias("size"))
    ref = _table(spark, d, "unique_info").where("seq is not null").select(F.upper("seq").alias("seq")).distinct()
    return cluster.chimeras(asked, reference=ref, named=False).select("seq", "size", "chimeric")


def search(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import cluster

    asked = _table(spark, d, "unique_info").where("uniq_id is not null").groupBy(F.col("uniq_id").alias("id")).agg(F.min("seq").alias("seq"))
    return cluster.search(asked, _refs(spark, d).withColumnRenamed("name", "id"))


def search_aligned(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import align

    asked = _table(spark, d, "unique_info").where("uniq_id is not null").groupBy(F.col("uniq_id").alias("id")).agg(F.min("seq").alias("seq"))
    return align.align_hits(search(spark, d), asked, _refs(spark, d).withColumnRenamed("name", "id"))


def streaming_dereplicate(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from siltflow.plans.lineage import ensure_checkpoint_dir
    from siltflow.streaming import derep as stream

    schema = _table(spark, d, "documents").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    alone = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", "documents.parquet").parquet(d) if alone else reader.parquet(f"{d}/documents.parquet")
    reads = source.select(F.col("doc_id").alias("rec_no"), iupac.dna(F.col("text")).alias("seq"), F.col("lang").alias("exp"), F.col("source").alias("sample"))
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.start(stream.running_counts(reads), f"{folder}/counts", f"{folder}/progress").awaitTermination()
    return stream.latest(spark, f"{folder}/counts", "cnt")


_KERNELS = (find_primer_binding_sites, in_silico, in_silico_strict, pairend, demultiplex, similar_pairs, cluster_table, chimeras, chimeras_ref, search, search_aligned, streaming_dereplicate)
QUERIES |= {f.__name__: f for f in _KERNELS}
QUERIES |= {f"rarefaction_q{q}": (lambda s, d, q=q: _rarefied(s, d, q)) for q in (0, 1, 2)}


def rarefaction_intervals(spark: SparkSession, d: str) -> DataFrame:
    from siltflow.operators import diversity

    return diversity.rarefaction(latest_cells(spark, d), q=0, nboot=20)


QUERIES["rarefaction_intervals"] = rarefaction_intervals
