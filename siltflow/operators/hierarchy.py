"""Parent-child links to full hierarchies by tree contraction.

A round removes every leaf (rake) and splices out an independent set of unary chain nodes
(compress); each removal is recorded as (id, parent, steps, ids between). The rounds are then
taken back in reverse: a removed node gets root, depth and path from its recorded parent, which
was removed later or is a root. A loop has no leaves, so raking strips what hangs on it and splicing
shrinks it to a node that is its own parent and has no other child: that is how it is found.
The number of rounds is logarithmic in the number of nodes whatever the depth of the trees, and as the
links left shrink by a constant factor a round, all rounds together move a multiple of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltflow.plans.lineage import Stored, read_all, store
from siltflow.plans.skew import hot_values, salted_lookup


def links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent): one row per id, both as text; parent is null for roots.

    A parent that is null, blank, the id itself or not an id of the table makes a root. Rows
    without id are left out. If one id comes with several usable parents, the least is taken.
    """
    one = (
        df.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"))
        .where(F.col("id").isNotNull())
        .withColumn("parent", F.when((F.trim("parent") != "") & (F.col("parent") != F.col("id")), F.col("parent")))
        .groupBy("id")
        .agg(F.collect_set("parent").alias("parents"))
    )
    ids = one.select(F.col("id").alias("known"))
    child = one.select("id", F.explode("parents").alias("parent"))
    kept = child.join(ids, F.col("parent") == F.col("known"), "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    return one.select("id").join(kept, "id", "left")


def _contract(alive: DataFrame, number: int, paths: bool) -> DataFrame:
    """One round: all links with what becomes of them (kind), those spliced around already joined up.

    Everything is keyed by the node itself: a node learns of its children by one partial aggregation, and a spliced node hands
    its parent on to its only child, whose id it knows. No join is by parent, so a node with very many children is no hot key.
    """
    rank = lambda c: F.xxhash64(F.col(c), F.lit(number))
    below = alive.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n"), F.max("id").alias("child"))
    single = (F.col("n") == 1) & (F.col("top") | (rank("id") > rank("parent"))) & ((rank("id") > rank("child")) | (F.col("child") == F.col("parent")))
    kind = F.when(F.col("n").isNull(), "leaf").when(F.col("parent") == F.col("id"), F.when(F.col("n") == 1, "loop").otherwise("stays")).when(single, "splice").otherwise("stays")
    state = alive.join(below, F.col("id") == F.col("at"), "left").withColumn("kind", kind).drop("at", "n")
    # No two neighbours are spliced in one round, so a spliced node's child and parent stay or are raked.
    out = state.where("kind = 'splice'").select(F.col("child").alias("heir"), F.col("parent").alias("up"), F.col("top").alias("up_top"), F.col("w").alias("mid_w"), F.col("id").alias("mid"), F.col("via").alias("mid_via"))
    longer = F.when(F.col("heir").isNotNull(), F.concat("via", F.array("mid"), "mid_via")).otherwise(F.col("via"))
    return state.join(out, F.col("id") == F.col("heir"), "left").select(
        "id", F.coalesce("up", "parent").alias("parent"), F.coalesce("up_top", "top").alias("top"), (F.col("w") + F.coalesce("mid_w", F.lit(0))).alias("w"), (longer if paths else F.col("via")).alias("via"), "kind"
    )


def _restore(removed: DataFrame, done: list[Stored], lookups: bool, hot: list, paths: bool) -> DataFrame:
    """Root, depth and path of what one round removed. Only nodes below another removed node are joined, with what later rounds removed."""
    none = F.array().cast("array<string>")
    path = lambda start: F.concat(start, F.reverse("via"), F.array("id")) if paths else none
    loop = F.col("kind") == "loop"
    out = removed.where("top or kind = 'loop'").select(
        "id", F.when(loop, "").otherwise(F.col("parent")).alias("root"), F.when(loop, F.lit(-1)).otherwise(F.col("w")).cast("long").alias("depth"), F.when(loop, none).otherwise(path(F.array("parent"))).alias("path")
    )
    if not lookups:
        return out
    up = read_all(done).select(F.col("id").alias("up"), "root", F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
    ok = F.col("up_depth") >= 0
    below = salted_lookup(removed.where("not top and kind <> 'loop'"), "parent", up, "up", hot)
    return out.union(below.select("id", "root", F.when(ok, F.col("up_depth") + F.col("w")).otherwise(F.lit(-1)).alias("depth"), F.when(ok, path(F.col("up_path"))).otherwise(none).alias("path")))


def resolve(link: DataFrame, paths: bool = False) -> DataFrame:
    """(id, root, depth, path) for every row of ``links``.

    Roots have depth 0 and are their own root. Nodes on a loop, or leading into one, have root
    '' and depth -1. ``path`` runs from the root to the node; it is empty for nodes without root and unless ``paths`` is set.
    Empty input gives an empty result. Names of other columns do not matter, ``links`` having
    only two. Contraction goes on to the last link at every size. A node's children never grow in number by it, so the parents
    that have more than 1 % of all links, at most 100, are looked up once.
    """
    none = F.array().cast("array<string>")
    link = store(link).df
    child = link.where(F.col("parent").isNotNull())
    hot = hot_values(child, "parent")
    inner = salted_lookup(child.select("id", "parent"), "parent", child.select(F.col("id").alias("up")), "up", hot, "left")
    alive = inner.select("id", "parent", F.col("up").isNull().alias("top"), F.lit(1).cast("long").alias("w"), none.alias("via"))
    rounds: list[tuple[Stored, bool]] = []
    left = 1
    while left:
        seen = Observation()
        is_kind = lambda *k: F.col("kind").isin(*k)
        counted = _contract(alive, len(rounds), paths).observe(seen, F.count_if(is_kind("stays")).alias("left"), F.count_if(is_kind("leaf", "splice") & ~F.col("top")).alias("lookups"))
        table = store(counted)
        left, lookups = seen.get["left"], seen.get["lookups"]
        rounds.append((table, lookups > 0))
        alive = table.df.where("kind = 'stays'").drop("kind")
    done: list[Stored] = []
    for table, lookups in reversed(rounds):
        done.append(store(_restore(table.df.where("kind <> 'stays'"), done, lookups, hot, paths)))
        table.drop()
    roots = link.where(F.col("parent").isNull()).select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("id") if paths else none).alias("path"))
    return roots.union(read_all(done))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, id, steps): every node of a tree below each of its ancestors, from ``resolve(paths=True)``.

    The number of rows is the sum of all depths. Nodes without root have no rows.
    """
    return resolved.where("depth > 0").select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor")).select("ancestor", "id", (F.col("depth") - F.col("at")).alias("steps"))
