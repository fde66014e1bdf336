"""Taxonomy: lineages, accessions, names, consensus ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.operators import hierarchy
from siltflow.plans.lineage import store
from siltflow.plans.order import numbered
from siltflow.plans.skew import hot_values, salted_lookup

# The main ranks from the highest down.
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def lineages(nodes: DataFrame, id_col: str, parent_col: str, rank_col: str, name_col: str, ranks: list[str] = RANKS, max_depth: int = 100, roots_named: bool = False) -> DataFrame:
    """(id, one column per rank): the name of the nearest node of that rank at or above each id.

    Lineages come from the hierarchy operator, so there is no loop over levels and depth costs nothing; at most
    ``max_depth`` steps up are looked at. The top of a tree is above all its nodes: lookups of such nodes are salted. A node that is its own parent names no other node unless ``roots_named``. Nodes on or below a loop
    have their own name only.
    """
    link = hierarchy.links(nodes, id_col, parent_col)
    tree = hierarchy.resolve(link, paths=True)
    own = nodes.select(F.col(id_col).cast("string").alias("at"), F.col(rank_col).alias("rank"), F.col(name_col).alias("name"), (F.col(id_col).cast("string") == F.col(parent_col).cast("string")).alias("self")).where("at is not null")
    own = own.groupBy("at").agg(F.min(F.struct(F.col("rank").alias("rank"), F.col("name").alias("name"))).alias("n"), F.coalesce(F.max("self"), F.lit(False)).alias("self")).select("at", "n.rank", "n.name", "self")
    path = F.when(F.col("depth") >= 0, F.reverse(F.slice(F.reverse("path"), 1, max_depth + 1))).otherwise(F.array("id"))
    steps = tree.select("id", F.posexplode(F.reverse(path)).alias("up", "above"))
    named = own.where(F.col("rank").isin(*ranks) & F.col("name").isNotNull())
    found = salted_lookup(steps, "above", named, "at", hot_values(steps, "above")).where((F.col("up") == 0) | ~F.col("self") | F.lit(roots_named))
    wide = found.groupBy("id").agg(*[F.min_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("up"))).alias(r) for r in ranks])
    return link.select("id").join(wide, "id", "left")


def get_taxonomy(queries: DataFrame, lineage: DataFrame, col: str) -> DataFrame:
    """All query rows with the lineage of their id, null where the id is unknown."""
    return queries.join(lineage.withColumnRenamed("id", "_id"), F.col(col).cast("string") == F.col("_id"), "left").drop("_id")


def taxids_of_names(names: DataFrame, tax_names: DataFrame, col: str) -> DataFrame:
    """Query rows with tax_id; unknown names have null, a name of several taxa several rows."""
    known = tax_names.where("name is not null").select("tax_id", F.col("name").alias("_name")).distinct()
    return names.join(known, F.col(col) == F.col("_name"), "left").drop("_name")


def get_taxid(queries: DataFrame, accessions: DataFrame, col: str, versioned: bool) -> DataFrame:
    """Query rows, order column and repeats kept, with taxid; ``accessions`` has accession, `accession.version` and taxid."""
    key = F.col("`accession.version`") if versioned else F.col("accession")
    known = accessions.select(key.alias("_acc"), "taxid").where("_acc is not null").groupBy("_acc").agg(F.min("taxid").alias("taxid"))
    return queries.join(known, F.col(col) == F.col("_acc"), "left").drop("_acc")


def find_lca(hits: DataFrame, order: list[str], query: str = "qseqid", ranks: list[str] = RANKS, taxid: str = "staxids", accession: str = "sseqid", identity: str = "pident", coverage: str = "qcovs", evalue: str = "evalue", keep_unresolved: bool = False) -> DataFrame:
    """Consensus lineage of the best hits of every query.

    Best are the hits that have greatest identity, least evalue and greatest coverage of their query at once;
    a query without such a hit vanishes, or with ``keep_unresolved`` stays with nulls. A rank has a name when the
    best hits agree on it, nulls aside, independently of other ranks. The name is that of the deepest
    such rank, with `` sp. k`` where it is not the last one, k numbering equal lineages in query order.
    """
    best = hits.groupBy(F.col(query).alias("_q")).agg(F.max(identity).alias("_i"), F.min(evalue).alias("_e"), F.max(coverage).alias("_c"))
    kept = hits.join(best, F.col(query) == F.col("_q")).where((F.col(identity) == F.col("_i")) & (F.col(evalue) == F.col("_e")) & (F.col(coverage) == F.col("_c")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(c).cast("string").alias("v")))), lambda x: x["v"]), ";")
    one = kept.groupBy(query).agg(
        *[F.when(F.min(r) == F.max(r), F.max(r)).alias(r) for r in ranks], listed(taxid).alias("taxid"), listed(accession).alias("accession"), F.first(coverage).alias("coverage"), F.first(identity).alias("identity")
    )
    if keep_unresolved:
        one = best.select(F.col("_q").alias(query)).join(one, query, "left")
    deepest = F.coalesce(*[F.when(F.col(r).isNotNull(), F.lit(r)) for r in reversed(ranks)])
    one = one.withColumn("rank", deepest).withColumn("_n", F.coalesce(*[F.col(r) for r in reversed(ranks)]))
    one = store(one).df  # numbering reads it apart
    named = F.coalesce(F.col("rank") == ranks[-1], F.lit(True))
    # A lineage of high rank may be that of a large part of all queries: its numbers are not counted in one task.
    counted = numbered(one.where(~named), [query], "_k", ranks)
    name = F.when(F.col("_k").isNull(), F.col("_n")).otherwise(F.concat("_n", F.lit(" sp. "), F.col("_k").cast("string")))
    return one.where(named).withColumn("_k", F.lit(None).cast("long")).unionByName(counted).withColumn("scientific_name", name).drop("_n", "_k")


def dada_headers(lineage: DataFrame, ranks: list[str] = RANKS) -> DataFrame:
    """(id, header): ranks joined by semicolons, missing ones as NA, blanks as underscores."""
    return lineage.select("id", F.regexp_replace(F.concat_ws(";", *[F.coalesce(r, F.lit("NA")) for r in ranks]), " ", "_").alias("header"))


def accession_of(name, gi: bool = False):
    """Accession of a FASTA name: up to the first blank, in gi style what stands between ``gb|`` and the last ``|``."""
    first = F.substring_index(name, " ", 1)
    return F.regexp_extract(first, r"gb\|(.*)\|", 1) if gi else first
