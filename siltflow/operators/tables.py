"""Sequence tables in long form: reading headers, decontamination, replicates, wide views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.operators import nested
from siltflow.plans.order import numbered

METHODS = ("maximum", "mean", "threshold", "both_threshold")
MOST_CONTROL = 500_000  # rows of a control table whose parts are broadcast; parts of a longer one are joined


def _small(control: DataFrame):
    """``broadcast`` for frames with no more than a few rows per row of the control table, if that is counted to be small."""
    return F.broadcast if control.count() <= MOST_CONTROL else (lambda df: df)


def whole_number(c):
    """A count as written (see ``wide.whole_number``) as an expression."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    digits = F.regexp_replace(F.regexp_replace(t, "[+,]", ""), r"\.0*$", "").try_cast("bigint")
    power = t.try_cast("double")
    return F.when(t.rlike(r"^\+?(\d+|\d{1,3}(,\d{3})+)(\.0*)?$"), digits).when(t.rlike(r"^\+?\d+(\.\d*)?[eE][+-]?\d{1,2}$") & (power == F.floor(power)), power.try_cast("bigint"))


def latest_cells(df: DataFrame) -> DataFrame:
    """(experiment, id, tag, cnt, status): the deciding, readable cells of a delivered long table, by partial aggregation."""
    tag = F.upper(F.regexp_replace(F.regexp_replace("sample", r"^\s+|\s+$", ""), "(?i)^count_ *", ""))
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", F.col("row_no").isNotNull(), "row_no")
    cell = df.withColumn("tag", tag).where("tag <> ''").groupBy("experiment", "id", "tag").agg(F.max_by(F.struct("count", "status"), order).alias("c"))
    status = F.lower(F.regexp_replace("c.status", r"^\s+|\s+$", ""))
    return cell.select("experiment", "id", "tag", whole_number(F.col("c.count")).alias("cnt"), F.when(status != "", status).alias("status")).where("cnt is not null")


def fasta_to_table(df: DataFrame, key: str, seq: str, header: str) -> DataFrame:
    """Long table (experiment, ID, SEQ, sample, count, status, total_count, SEQ_ID) of sequence records with JSON headers.

    The denoise block counts where there is one, else the stat block (without statuses). total_count is the sum by
    sequence and experiment, SEQ_ID numbers the distinct sequences of the table in order. Records without readable JSON have no rows.
    """
    rows = nested.shred(df, key, header, nested.HEADER_KEYED, nested.HEADER_NAMES, nested.header_json).where(
        F.col("relation").isin("denoise/by_sample/*", "denoise/by_sample/samples") | ((F.col("relation") == "stat/exp/samples") & ~F.array_contains("blocks", "denoise"))
    )
    cells = rows.select(
        "rec_id", F.element_at("above", -1).alias("experiment"), F.col("key").alias("sample"), F.expr("try_cast(coalesce(cols['count'], cols['n'], cols['value']) as bigint)").alias("count"), F.expr("cols['status']").alias("status")
    )
    ident = F.regexp_replace(F.regexp_replace(header, "^>", ""), "(?s);size.*$", "")
    recs = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("rec_id")).agg(F.min(F.struct(ident.alias("ID"), F.col(seq).alias("SEQ"))).alias("r")).select("rec_id", "r.ID", "r.SEQ")
    long = cells.join(recs, "rec_id")
    numbered = sequence_ids(long.select("SEQ").distinct())
    total = long.groupBy("SEQ", "experiment").agg(F.sum("count").alias("total_count"))
    return long.join(total, ["SEQ", "experiment"]).join(numbered, "SEQ").select("experiment", "ID", "SEQ", "sample", "count", "status", "total_count", "SEQ_ID")


def sequence_ids(seqs: DataFrame) -> DataFrame:
    """(SEQ, SEQ_ID): distinct sequences with ordered numbers. Null is left out."""
    ids = numbered(seqs.select("SEQ").where(F.col("SEQ").isNotNull()), ["SEQ"], "n")
    return ids.select("SEQ", F.concat(F.lit("SEQ_"), F.when(F.col("n") < 10_000_000, F.lpad(F.col("n").cast("string"), 7, "0")).otherwise(F.col("n").cast("string"))).alias("SEQ_ID"))


def decontaminate(cells: DataFrame, control: DataFrame, method: str = "maximum", blanks: dict[str, str] | None = None, threshold: float = 10) -> DataFrame:
    """(experiment, id, tag, cnt) after subtraction of, or removal by, the blanks of each tag.

    ``control`` has sample, tag, category and a column per blank type; ``blanks`` maps category ->
    column. A blank's value is taken per row over all its tags that occur in the table, absent cells being 0. Subtractions
    compose and thresholds multiply, so all blanks are applied at once and in any order. Tags of blanks are dropped.
    ``threshold`` and ``both_threshold`` keep a cell when its blanks stay below the threshold.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    small = _small(control)
    blanks = blanks or {"EB": "eb", "FB": "fb", "PB": "pb"}
    links = control.select("sample", "tag", "category", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("blank")) for t, c in blanks.items()])).alias("l")).select("sample", "tag", "category", "l.*")
    named = links.where("blank is not null").select(F.col("blank").alias("sample")).distinct()
    blank_tags = control.where(F.col("category").isin(*blanks)).join(small(named), "sample", "left_semi").select("tag", F.col("sample").alias("blank"), F.col("category").alias("type"))
    present = cells.select("tag").distinct()
    blank_tags = blank_tags.join(present, "tag", "left_semi").distinct()
    width = blank_tags.groupBy("blank", "type").agg(F.count("*").alias("width"))
    value = cells.join(small(blank_tags), "tag").groupBy("experiment", "id", "blank", "type").agg(F.max("cnt").alias("most"), F.sum("cnt").alias("all")).join(small(width), ["blank", "type"])
    level = {"maximum": F.col("most").cast("double"), "mean": F.bround(F.col("all") / F.col("width"), 0)}.get(method, F.when(F.col("most") < threshold, 0.0).otherwise(1.0))
    targets = links.where("category = 'sample' and blank is not null").select(F.col("tag").alias("to"), "type", "blank").distinct()
    dirt = value.withColumn("level", level).join(small(targets), ["type", "blank"]).groupBy("experiment", "id", F.col("to").alias("tag")).agg(F.sum("level").alias("level"))
    kept = cells.join(small(blank_tags.select("tag").distinct()), "tag", "left_anti")
    out = kept.join(dirt, ["experiment", "id", "tag"], "left").withColumn("level", F.coalesce("level", F.lit(0.0)))
    cnt = F.greatest(F.col("cnt") - F.col("level"), F.lit(0.0)) if method in ("maximum", "mean") else F.when(F.col("level") > 0, 0).otherwise(F.col("cnt"))
    return out.select("experiment", "id", "tag", cnt.cast("long").alias("cnt"))


def merge_replicates(cells: DataFrame, control: DataFrame, method: str = "mean_rra", repeat_times: int = 1, present_absent: bool = False) -> DataFrame:
    """(experiment, id, grp, sample, value) over the replicates of each group and sample, zero values left out.

    Relative abundances are by tag over the whole table; tags without reads are no replicates and do not enter means.
    ``both_occur`` gives the mean where at least ``repeat_times`` replicates have reads. Rows without any value vanish.
    """
    if method not in ("mean_rra", "max_rra", "both_occur"):
        raise ValueError("method must be mean_rra, max_rra or both_occur")
    small = _small(control)
    totals = cells.groupBy("tag").agg(F.sum("cnt").alias("all")).where(F.col("all") > 0)
    reps = control.where("category = 'sample'").select("tag", "grp", "sample").distinct().join(totals, "tag")
    width = reps.groupBy("grp", "sample").agg(F.count("*").alias("width"))
    share = cells.join(small(reps), "tag").withColumn("rra", F.col("cnt") / F.col("all"))
    per = share.groupBy("experiment", "id", "grp", "sample").agg(F.sum("rra").alias("sum"), F.max("rra").alias("max"), F.sum((F.col("cnt") > 0).cast("long")).alias("seen"))
    mean = F.col("sum") / F.col("width")
    value = {"mean_rra": mean, "max_rra": F.col("max"), "both_occur": F.when(F.col("seen") >= repeat_times, mean).otherwise(0.0)}[method]
    out = per.join(small(width), ["grp", "sample"]).select("experiment", "id", "grp", "sample", value.alias("value")).where("value > 0")
    return out.withColumn("value", F.lit(1.0)) if present_absent else out


def replicate_columns(control: DataFrame) -> list[str]:
    """Names of the wide view: every group with every sample, also pairs without rows."""
    of = control.where("category = 'sample' and grp is not null and sample is not null")
    pairs = of.select("grp").distinct().crossJoin(of.select("sample").distinct())  # both sides are levels of the control table
    return [f"{g}_{s}" for g, s in pairs.orderBy("grp", "sample").collect()]


def to_wide(long: DataFrame, keys: list[str], name, value: str, columns: list[str], fill=0) -> DataFrame:
    """Pivot with a fixed list of columns, so that absent ones exist and no pass over the data finds them."""
    return long.withColumn("_name", name).groupBy(*keys).pivot("_name", columns).agg(F.sum(value)).na.fill(fill, columns)
