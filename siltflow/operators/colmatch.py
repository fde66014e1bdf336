"""Matching of typed names against a checklist with synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltflow.functions import distances
from siltflow.operators import taxonomy

LINEAGE = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def normalise(name: Column, confusables: bool = False) -> Column:
    """Lower case, one blank between words, only ``a-z 0-9 . _ -`` and blanks, the former three as blanks; '' is null.
    With ``confusables`` every l reads i."""
    x = F.trim(F.regexp_replace(F.lower(name), r"[\s\p{Z}]+", " "))
    x = F.regexp_replace(x, "[^a-z0-9 ._-]", "")
    x = F.regexp_replace(x, "[._-]+", " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    x = F.translate(x, "l", "i") if confusables else x
    return F.nullif(x, F.lit(""))


def clean_column(name: str) -> str:
    """Column name of a checklist file: no leading ``col:``, only letters, digits and underscore, lower case."""
    import re

    return re.sub("[^A-Za-z0-9_]", "", re.sub("^col:", "", name, flags=re.I)).lower()


def build(taxa: DataFrame, max_depth: int = 40) -> DataFrame:
    """Prepared checklist: one row per taxon_id with norm and fuzzy keys and lineage columns.

    ``taxa`` has taxon_id, parent_id, scientific_name, rank, status, authorship. Ranks are lower case; a
    lineage column holds the own name for the own rank, else the nearest ancestor's. Rows of one id: the least by (name, rank, parent, status, authorship).
    """
    fields = ["scientific_name", "rank", "parent_id", "status", "authorship"]
    one = taxa.where("taxon_id is not null").groupBy("taxon_id").agg(F.min(F.struct(*fields)).alias("r")).select("taxon_id", *[F.col(f"r.{c}").alias(c) for c in fields]).withColumn("rank", F.lower("rank"))
    lineage = taxonomy.lineages(one, "taxon_id", "parent_id", "rank", "scientific_name", LINEAGE, max_depth, roots_named=True)
    keyed = one.withColumn("name_norm", normalise(F.col("scientific_name"))).withColumn("name_fuzzy", normalise(F.col("scientific_name"), True))
    return keyed.join(lineage.withColumnRenamed("id", "taxon_id"), "taxon_id")


def match(inputs: DataFrame, name_col: str, checklist: DataFrame, ranks: tuple[str, ...] = ("species",), constraints: dict[str, str] | None = None, fuzzy: bool = False, max_dist: int = 1, return_all: bool = False, method: str = "lv") -> DataFrame:
    """Inputs with their matches; inputs without match have no row.

    Distinct (name, constraints) are looked up once and joined back. Exact matches are by normalised
    name. Fuzzy candidates, for names without exact match, share the first letter of the fuzzy key and differ by at most ``max_dist`` in its length; they
    match when the fuzzy or the plain keys are within ``max_dist``, and the distance told is that of the plain keys. A synonym with a
    parent takes its accepted record. Of several matches the first by (exact, distance, accepted,
    taxon_id) is kept unless ``return_all``. A blank constraint does not constrain.
    ``method`` is the distance: lv, or hamming, lcs, osa or dl, whose candidates come from Levenshtein's bound on them.
    """
    if method != "lv" and method not in distances.METHODS:
        raise ValueError(f"method must be lv or one of {sorted(distances.METHODS)}")
    constraints = constraints or {}
    on = ["_norm", *[f"_c_{r}" for r in constraints]]
    rows = inputs.withColumn("_norm", normalise(F.col(name_col)))
    for r, c in constraints.items():
        rows = rows.withColumn(f"_c_{r}", normalise(F.col(c)))
    asked = rows.select(*on).where("_norm is not null").distinct()
    asked = asked.withColumn("_ask", F.xxhash64(*on)).withColumn("_fuzzy", F.translate("_norm", "l", "i"))
    pool = checklist.where(F.col("rank").isin(*ranks) & F.col("name_norm").isNotNull())
    fits = F.lit(True)
    for r in constraints:
        fits = fits & (F.col(f"_c_{r}").isNull() | (F.col(f"_c_{r}") == normalise(F.col(r))))
    exact = asked.join(pool, F.col("_norm") == F.col("name_norm")).where(fits).withColumns({"distance": F.lit(0), "match_type": F.lit("exact")})
    found = exact
    if fuzzy:
        # Of d + 1 pieces of a name one survives d edits, at most d letters from its place.
        d = max_dist * (1 if method == "lv" else distances.METHODS[method][1])
        begin = lambda no, n: F.floor(F.col(n) * no / (d + 1)).cast("int") + 1
        no = F.explode(F.sequence(F.lit(0), F.lit(d)))
        rest = asked.join(exact.select("_ask").distinct(), "_ask", "left_anti").withColumn("_len", F.explode(F.sequence(F.greatest(F.length("_fuzzy") - max_dist, F.lit(1)), F.length("_fuzzy") + max_dist)))
        rest = rest.withColumn("_no", no).withColumn("_shift", F.explode(F.sequence(F.lit(-d), F.lit(d))))
        start, size = begin(F.col("_no"), "_len") + F.col("_shift"), begin(F.col("_no") + 1, "_len") - begin(F.col("_no"), "_len")
        rest = rest.where((start >= 1) & (start + size - 1 <= F.length("_fuzzy"))).withColumn("_piece", F.substring("_fuzzy", start, size)).drop("_shift").distinct()
        cut = pool.withColumn("_plen", F.length("name_fuzzy")).withColumn("_pno", no)
        cut = cut.withColumn("_ppiece", F.substring("name_fuzzy", begin(F.col("_pno"), "_plen"), begin(F.col("_pno") + 1, "_plen") - begin(F.col("_pno"), "_plen")))
        met = (F.substring("_fuzzy", 1, 1) == F.substring("name_fuzzy", 1, 1)) & (F.col("_len") == F.col("_plen")) & (F.col("_no") == F.col("_pno")) & (F.col("_piece") == F.col("_ppiece"))
        # The fuzzy keys are never farther apart than the plain ones.
        near = rest.join(cut, met).where(fits & (F.expr(f"levenshtein(_fuzzy, name_fuzzy, {d})") >= 0)).drop("_len", "_no", "_piece", "_plen", "_pno", "_ppiece").dropDuplicates(["_ask", "taxon_id"])
        if method == "lv":
            near = near.withColumn("distance", F.expr("levenshtein(_norm, name_norm)"))
        else:
            apart = F.pandas_udf(distances.of_series(method), "int")
            near = near.where(apart("_fuzzy", "name_fuzzy") <= max_dist).withColumn("distance", apart("_norm", "name_norm"))
        found = exact.unionByName(near.withColumn("match_type", F.lit("fuzzy")))
    accepted = checklist.select(F.col("taxon_id").alias("_aid"), *[F.col(c).alias(f"_a_{c}") for c in ("scientific_name", "authorship", "status", *LINEAGE)])
    link = F.when(F.lower("status").contains("synonym") & (F.trim("parent_id") != ""), F.col("parent_id"))
    full = found.withColumn("_link", link).join(accepted, F.col("_link") == F.col("_aid"), "left")
    hit = F.col("_aid").isNotNull()
    full = full.withColumns(
        {"accepted_id": F.when(hit, F.col("_aid")).otherwise(F.col("taxon_id")), "accepted_name": F.coalesce("_a_scientific_name", "scientific_name"), "status": F.coalesce("_a_status", "status"), "authorship": F.coalesce("_a_authorship", "authorship")}
        | {r: F.when(hit, F.coalesce(f"_a_{r}", F.col("_a_scientific_name") if r == "species" else F.lit(None))).otherwise(F.col(r)) for r in LINEAGE}
    )
    order = [F.col("match_type") != "exact", F.col("distance"), F.coalesce(F.lower("status") != "accepted", F.lit(True)), F.col("taxon_id")]
    full = full.withColumn("_rank", F.row_number().over(Window.partitionBy("_ask").orderBy(*order)))
    if not return_all:
        full = full.where("_rank = 1")
    keep = ["taxon_id", "scientific_name", "match_type", "distance", "accepted_id", "accepted_name", "status", "authorship"]
    answers = full.select("_ask", *[F.col(c).alias(f"match_{c}" if c in inputs.columns else c) for c in [*keep, *LINEAGE]])
    return rows.withColumn("_ask", F.xxhash64(*on)).where("_norm is not null").join(answers, "_ask").drop("_ask", *on)
