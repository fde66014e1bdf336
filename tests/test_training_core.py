import json
import random
import re
from collections import defaultdict

import pytest

from siltflow import queries_core as q
from siltflow.functions.loosejson import BROKEN, loose_json
from siltflow.operators import hierarchy, nested, skewagg, wide
from siltflow.plans.skew import salted_aggregate
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_forest(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent.setdefault(i, set()).add(p)
    one = {i: min((p for p in ps if p is not None and p.strip() and p != i and p in parent), default=None) for i, ps in parent.items()}
    out = {}
    for i in one:
        x, path = i, [i]
        while one[x] is not None and len(path) <= len(one) + 1:
            x = one[x]
            path.append(x)
        out[i] = (x, len(path) - 1, path[::-1]) if one[x] is None else ("", -1, [])
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(str(i), str(rng.randrange(max(1, i - 4), i + 1)) if i % 9 else None) for i in range(1, 120)]
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "f"), ("g", "nowhere"), ("h", " "), ("h", " "), (None, "a"), ("i", "h"), ("i", "g")]
    rows += [(f"chain{i}", f"chain{i - 1}") for i in range(1, 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, parent string, root string")
    got = {r.id: (r.root, r.depth, r.path) for r in hierarchy.resolve(hierarchy.links(df, "id", "parent"), paths=True).collect()}
    assert got == brute_forest(rows)


def test_long_chain_wide_hub_and_long_loop(spark):
    n = 100_000
    chain = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    hub = spark.range(30_000).select(F.concat(F.lit("h"), "id").alias("id"), F.lit("c70000").alias("parent"))
    loop = spark.range(5_000).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("l"), (F.col("id") + 1) % 5_000).alias("parent"))
    got = hierarchy.resolve(hierarchy.links(chain.union(hub).union(loop), "id", "parent"))
    want = F.when(F.col("id").startswith("c"), F.substring("id", F.lit(2), F.lit(9)).cast("long")).when(F.col("id").startswith("h"), 70_001).otherwise(-1)
    assert got.count() == n + 35_000
    assert got.where((F.col("depth") != want) | (F.col("root") != F.when(want < 0, "").otherwise("c0"))).count() == 0


def test_hierarchy_of_nothing_and_descendants(spark):
    none = spark.createDataFrame([], "id string, parent string")
    assert hierarchy.resolve(hierarchy.links(none, "id", "parent")).count() == 0
    df = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = hierarchy.descendants(hierarchy.resolve(hierarchy.links(df, "id", "parent"), paths=True)).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("r", "a", 1), ("r", "b", 2)]


def test_whole_numbers():
    good = {"7": 7, " 7\t": 7, "+7": 7, "0007": 7, "7.0": 7, "7.": 7, "1,014": 1014, "1.000000e+00": 1, "9.5e+01": 95}
    assert {k: wide.whole_number(k) for k in good} == good
    assert [wide.whole_number(x) for x in (None, "", "nan", "NA", "-", "?", "7.5", "-3", "1,01", "1e-1", "9" * 30)] == [None] * 11
    assert [wide.tag_of(x) for x in (" f001 ", "count_F002", "", None)] == ["F001", "F002", None, None]


def test_wide_table(spark):
    schema = "row_no long, experiment string, id string, sample string, count string, status string, loaded_at timestamp, tag string"
    rows = [
        (1, "e", "x", "F001", "5", "head", "2024-01-01 00:00:00"),
        (2, "e", "x", " f001", "6", " Head ", "2024-01-02 00:00:00"),
        (3, "e", "x", "F002", "7", "internal", None),
        (4, "e", "x", "F002", "?", "head", "2024-01-01 00:00:00"),
        (5, "e", "x", "F003", "1.0", None, "2024-01-01 00:00:00"),
        (6, "e", "x", "F003", "2", None, "2024-01-01 00:00:00"),
        (7, "e", None, None, "2", "head", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema.replace("timestamp", "string")).withColumn("loaded_at", F.to_timestamp("loaded_at"))
    got = {r.id: r for r in wide.wide_table(df, ["F001", "F002", "F009"]).collect()}
    assert tuple(got["x"]) == ("e", "x", 2, 8, 1, 6, "head", None, "head", None, None)
    assert tuple(got[None])[:5] == ("e", None, 0, 0, 0)
    assert wide.wide_table(df.limit(0), ["F001"]).count() == 0


def test_wide_columns_hold_the_deciding_cells(spark):
    from siltflow.queries_ref import latest_cells

    wide_rows = q.p5_wide(spark, SF)
    tags = [c[6:] for c in wide_rows.columns if c.startswith("count_")]
    got = {(r.experiment, r.id, t, r[f"count_{t}"], r[f"status_{t}"]) for r in wide_rows.collect() for t in tags if r[f"count_{t}"] is not None}
    assert got == {tuple(r) for r in latest_cells(spark, SF).collect()}


def test_blanks_inside_a_tag(spark):
    df = spark.createDataFrame([(1, "e", "x", " count_ f1\t a ", "3", None, None), (2, "e", "x", "f1  a", "4", None, None), (3, "e", "x", " ", "9", None, None)], "row_no long, experiment string, id string, sample string, count string, status string, loaded_at timestamp")
    assert wide.tags_of(df) == ["F1\t A", "F1  A"]
    assert wide.wide_table(df, wide.tags_of(df)).select("`count_F1\t A`", "`count_F1  A`").first() == (3, 4)


def test_loose_json():
    assert loose_json(' "a" : {"b": 1}, "c": [2]') == {"a": {"b": 1}, "c": [2]}
    assert loose_json('{"a": 1} {"x"') == {"a": 1}
    assert loose_json(json.dumps(json.dumps({"a": 1}))) == {"a": 1}
    assert loose_json('"a": {"b": 1}},') == {"a": {"b": 1}}
    assert [loose_json(x) for x in (None, "", "x", '{"a": 1', '"a": {"b"', '"plain"', "[" * 5000)] == [BROKEN] * 7


def leaves_of_headers(path):
    """Plain reading of p6, written apart from the operator."""
    import duckdb

    out = set()
    for i, t in duckdb.sql(f"SELECT DISTINCT node_id, raw_header FROM '{path}/node.parquet'").fetchall():
        if t is None or "{" not in t:
            continue
        try:
            v = json.JSONDecoder().raw_decode(t, t.index("{"))[0]
        except ValueError:
            continue
        if "denoise" in v:
            by = v["denoise"].get("by_sample", {})
            by = by.items() if isinstance(by, dict) else [(x["exp"], {s["sample"]: s for s in x["samples"]}) for x in by]
            out |= {("node", i, e, s, int(c["count"])) for e, m in by for s, c in m.items()}
        elif "stat" in v:
            ex = v["stat"].get("exp", {})
            ex = [(e, m["samples"]) for e, m in ex.items()] if isinstance(ex, dict) else [(x["name"], {s["sample"]: s["n"] for s in x["samples"]}) for x in ex]
            out |= {("node", i, e, s, int(c)) for e, m in ex for s, c in m.items()}
    for i, t in duckdb.sql(f"SELECT DISTINCT uniq_id, pairend_json FROM '{path}/unique_info.parquet'").fetchall():
        t = (t or "").strip()
        try:
            if t.startswith('"{'):
                t = json.JSONDecoder().raw_decode(t)[0]
            m = re.match(r'\s*\{?\s*"pairend"\s*:\s*', t)
            v = json.JSONDecoder().raw_decode(t, m.end())[0]
            if t.lstrip().startswith("{"):
                json.JSONDecoder().raw_decode(t.lstrip())
        except (ValueError, AttributeError):
            continue
        lanes = [(str(x["lane"]), x["pairs"]) for x in v["lanes"]] if isinstance(v, dict) and "lanes" in v else [("", v if isinstance(v, list) else [v])]
        out |= {("unique_info", i, lane, str(n), int(o["overlap"])) for lane, objs in lanes for n, o in enumerate(objs, 1) if "overlap" in o}
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_nested_against_plain_reading(spark, sf):
    got = [tuple(r) for r in q.p6_found(spark, f"/root/testdata/{sf}").collect()]
    assert len(got) == len(set(got))
    assert set(got) == leaves_of_headers(f"/root/testdata/{sf}")


def test_shared_inlining(spark):
    docs = [
        (1, '{"a": {"x": 1, "note": {"t": "p"}}, "b": {"note": {"t": "q"}}, "tree": {"v": 0, "tree": {"v": 1}}, "list": [{"k": 2}, 3]}'),
        (2, None), (3, '{"list": []'), (None, '{"list": [1]}'),
    ]
    df = spark.createDataFrame(docs, "id long, j string")
    graph = nested.schema_graph(df, "id", "j", {})
    assert graph.repeated == {"list"} and graph.shared == {"a/note", "b/note"} and graph.recursive == {"tree"}
    rows = nested.shred(df, "id", "j", {}, {})
    root = nested.table(rows, "", {"a.x": "int"}).collect()
    assert [(r.rec_id, r["a.x"]) for r in root] == [("1", 1)]
    tree = {r.row_id: (r.parent_relation, r.parent_id, r.v) for r in nested.table(rows, "tree", {"v": "int"}).collect()}
    assert tree == {".tree1": ("", "", 0), ".tree1.tree1": ("tree", ".tree1", 1)}
    assert sorted((r.pos, r.k, r.value) for r in nested.table(rows, "list", {"k": "int", "value": "int"}).collect()) == [(1, 2, None), (2, None, 3)]


def test_any_depth_is_read(spark):
    n = 100_000
    rows = [
        (1, '{"a": ' * n + '{"v": 7}' + "}" * n), (2, "[" * n + "5" + "]" * n), (3, '{"a": ' * n), (4, '{"m": [[1, 2], [], [[3]]]}'),
        (5, '{"list": ' + '{"k": {"list": ' * 1500 + "[4]" + "}}" * 1500 + "}"), (6, None), (7, " "),
    ]
    df = spark.createDataFrame(rows, "id long, j string")
    got = nested.shred(df, "id", "j", {}, {})
    assert [(r.rec_id, r.v) for r in nested.table(got, "a", {"v": "int"}).where("v is not null").collect()] == [("1", 7)]
    per = {r.rec_id: r["count"] for r in got.groupBy("rec_id").count().collect()}
    assert per["1"] == n + 1 and per["2"] == n and "3" not in per
    deep = got.where("rec_id = '1'")
    assert deep.join(deep.select(F.col("relation").alias("r"), F.col("row_id").alias("i")), (F.col("parent_relation") == F.col("r")) & (F.col("parent_id") == F.col("i"))).count() == n + 1
    m = [(r.parent_relation, r.parent_id, r.row_id, r.pos, r.value) for r in nested.table(got.where("rec_id = '4'"), "m", {"value": "int"}).orderBy("row_id").collect()]
    assert [x[3:] for x in m if x[4]] == [(1, 1), (2, 2), (1, 3)] and len(m) == 7
    assert tuple(nested.reading_report(df, "id", "j").first()) == (7, 2, 1, 4)


def test_deep_values_equal_the_plain_decoder():
    from siltflow.functions.loosejson import deep_value

    for t in ('{"a": [1, -2.5e3, true, null, {"b": "x\\u00e9\\"", "": {}}], "c": []} rest', "[]", '"s"', "12", "[ 1 ,2 ]", '{"a":1,"a":2}'):
        assert deep_value(t, 0) == json.JSONDecoder().raw_decode(t)
    for t in ("", "[1", "[1,", "[1 2]", '{"a"', '{"a":', '{"a":1,}', "{1:2}", "nul", "[1}"):
        with pytest.raises(ValueError):
            deep_value(t, 0)


def test_salted_aggregate_equals_plain(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 7}", i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, n long")
    got = salted_aggregate(df, ["k"], {"c": F.count("*"), "s": F.sum("n")}, {"c2": F.sum("c"), "s2": F.sum("s")}, F.col("id"), salts=4, share=0.2)
    want = defaultdict(lambda: [0, 0])
    for _, k, n in rows:
        want[k][0] += 1
        want[k][1] += n
    assert {r.k: [r.c2, r.s2] for r in got.collect()} == dict(want)


def test_map_entries_edges(spark):
    df = spark.createDataFrame([(1, {"e": {"s": 2}}), (1, {"e": {"s": 2}}), (2, None), (3, {}), (None, {"e": {"s": 1}}), (4, {"e": None})], "id long, m map<string,map<string,bigint>>")
    got = skewagg.map_entries(df, "id", "m")
    assert [tuple(r) for r in got.collect()] == [(1, "e", "s", 2)]
    assert [tuple(r) for r in skewagg.key_totals(got).collect()] == [("e", "s", 1, 2, 2)]
    assert skewagg.key_totals(got.limit(0)).count() == 0
