import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltflow.llm import leaks, lookalikes, mixing, names, near, registry, spans

SF = "/root/testdata/sf0.001"


def test_consistent_form(spark):
    rows = [
        (1, "Ｗide　９"), (2, "ﬁne"), (3, "été"), (4, "Тһіѕ"), (5, "a​b­"), (6, "plain  two ×"), (7, None), (8, ""), (9, " x y"),
        (10, "𝖺𝗯"), (11, "ї"), (12, "ï"), (1, "Ｗide　９"), (None, "Ｗ"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, v string, value string")
    got = {r.id: r.clean for r in lookalikes.unify(df, "id", ["v"]).collect()}
    assert got == {1: "Wide 9", 2: "fine", 3: "été", 4: "This", 5: "ab", 9: " x y", 10: "ab", 11: "ï", 12: "ï"}
    assert lookalikes.unify(df.limit(0), "id", ["v"]).count() == 0


def test_letters_of_any_script(spark):
    alike = lookalikes.confusable()
    assert len(alike) > 200 and (alike["Ꭰ"], alike["У"], alike["Ӏ"], alike["γ"]) == ("D", "Y", "I", "y") and "é" not in alike and "ø" not in alike
    df = spark.createDataFrame([(1, "Ꭰо\u200bg"), (2, "øre Ꮃ")], "id long, v string")
    assert {r.id: r.clean for r in lookalikes.unify(df, "id", ["v"]).collect()} == {1: "Dog", 2: "øre W"}


def test_collation_alone_joins_syllables(spark):
    letters, syllable = "\u1100\u1161 x", "\uac00 x"
    df = spark.createDataFrame([(1, letters), (2, syllable)], "id long, v string")
    assert [r.m for r in df.where("id = 1").select(lookalikes.consistent(F.col("v")).alias("m")).collect()] == [letters]
    assert {r.id: r.clean for r in lookalikes.unify(df, "id", ["v"]).collect()} == {1: syllable}


def brute_pairs(rows):
    recs = {}
    for i, s, m in rows:
        if i is not None and s and m:
            recs[i] = ({s.upper()[j : j + 8] for j in range(len(s) - 7)}, {(e, x) for e, inner in m.items() for x in (inner or {})})
    ids = sorted(recs)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if recs[a][1] & recs[b][1] and recs[a][0] and recs[b][0] and 10 * len(recs[a][0] & recs[b][0]) >= 6 * len(recs[a][0] | recs[b][0])
    }


@pytest.mark.parametrize("common,shard", [(64, 256), (3, 4)])
def test_similar_records_against_brute_force(spark, monkeypatch, common, shard):
    monkeypatch.setattr(near, "COMMON", common)
    monkeypatch.setattr(near, "SHARD", shard)
    rng = random.Random(5)
    primer = "AACTATGGACAGACCGTC"
    rows = []
    for f in range(25):
        base = primer + "".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 130)))
        for _ in range(rng.randrange(1, 8)):
            s = list(base)
            for _ in range(rng.randrange(0, 5)):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
            s = "".join(s)
            cut = rng.randrange(20, len(s) - 20)
            s = rng.choice([s, s[cut:] + s[:cut], s[: -rng.randrange(1, 25)], s.lower()])
            rows.append((len(rows), s, {"e": {rng.choice("st"): 1}}))
    rows += [(1000, None, {"e": {"s": 1}}), (1001, "ACGT", {"e": {"s": 1}}), (1002, rows[0][1], None), (1003, rows[0][1], {}), rows[3], (1004, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "id long, seq string, m map<string,map<string,bigint>>")
    got = {tuple(r) for r in near.similar_records(df, "id", "seq", "m").collect()}
    assert got == brute_pairs(rows)
    assert near.similar_records(df.limit(0), "id", "seq", "m").count() == 0


def test_no_similar_text_of_a_rearranged_family_is_lost(spark):
    rng = random.Random(0)
    base, seqs = "".join(rng.choice("ACGT") for _ in range(70)), set()
    while len(seqs) < 360:
        s = base
        for _ in range(rng.randrange(3)):
            i, j = sorted(rng.sample(range(len(s) + 1), 2))
            rest = s[:i] + s[j:]
            at = rng.randrange(len(rest) + 1)
            s = rest[:at] + s[i:j] + rest[at:]
        if rng.random() < 0.5:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice("ACGT") + s[i + 1 :]
        seqs.add(s)
    seqs = sorted(seqs)
    g = [near.grams(s) for s in seqs]
    want = {(a, b) for a in range(len(seqs)) for b in range(a + 1, len(seqs)) if 10 * len(g[a] & g[b]) >= 6 * len(g[a] | g[b])}
    df = spark.createDataFrame(list(enumerate(seqs)), "key long, seq string")
    assert {tuple(r) for r in near.similar_classes(df).collect()} == want and len(want) > 1_000


@pytest.mark.parametrize("shard", [2048, 6])
@pytest.mark.parametrize("similarity,every", [(0.2, 12), (0.3, 16), (0.45, 22), (0.6, 33), (0.8, 70)])
def test_every_similarity_has_its_anchors(spark, monkeypatch, similarity, every, shard):
    monkeypatch.setattr(near, "SHARD", shard)
    rng = random.Random(11)
    primer, seqs = "".join(rng.choice("ACGT") for _ in range(30)), []
    for n in range(150):
        s = list(primer * (n % 3 == 0) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(40, 240))))
        seqs.append("".join(s))
        for i in range(rng.randrange(every), len(s), every):
            s[i] = rng.choice([c for c in "ACGT" if c != s[i]])
        seqs.append("".join(s))
    g = [near.grams(s) for s in seqs]
    want = {(a, b) for a in range(len(seqs)) for b in range(a + 1, len(seqs)) if len(g[a] & g[b]) >= similarity * len(g[a] | g[b])}
    got = {tuple(r) for r in near.similar_classes(spark.createDataFrame(list(enumerate(seqs)), "key long, seq string"), similarity).collect()}
    assert len(want) > 50 and got == want


def test_similarity_has_bounds(spark):
    for wrong in (0, -1, 1.1):
        with pytest.raises(ValueError):
            near.schemes(wrong)


def test_similar_records_on_the_table(spark):
    rows = [(r.node_id, r.seq, r.exp_sample_count) for r in spark.read.parquet(f"{SF}/node.parquet").collect()]
    assert {tuple(r) for r in registry.p3_found(spark, SF).collect()} == brute_pairs(rows)


def test_bk_tree_misses_nothing():
    rng = random.Random(1)
    seqs = ["".join(rng.choice("AC") for _ in range(rng.randrange(8, 40))) for _ in range(120)]
    vectors, sizes = near.folded_vectors(seqs)
    assert [len(near.grams(s)) for s in seqs] == list(sizes)
    tree = near.BKTree()
    for i, (v, n) in enumerate(zip(vectors, sizes)):
        tree.add(i, int.from_bytes(v, "big"), int(n))
    for s, v, n in list(zip(seqs, vectors, sizes))[:30]:
        a = near.grams(s)
        want = {i for i, t in enumerate(seqs) if len(a & near.grams(t)) >= 0.5 * len(a | near.grams(t))}
        got = tree.within(int.from_bytes(v, "big"), int(n), 0.5)
        assert want <= set(got) and len(got) == len(set(got))


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        r = [i]
        for j, y in enumerate(b, 1):
            r.append(min(p[j] + 1, r[-1] + 1, p[j - 1] + (x != y)))
        p = r
    return p[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = [(i, word(5), word(6)) for i in range(60)]
    trie = names.NameTrie(entries)
    for _ in range(60):
        _, g, e = rng.choice(entries)
        key = list(f"{g} {e}")
        for _ in range(rng.randrange(4)):
            key[rng.randrange(len(key))] = rng.choice("abc ")
        key = "".join(key)
        if key[1:2] == " ":
            continue
        want = {}
        for i, a, b in entries:
            d = min(lev(key, p) for p in (f"{a} {b}", f"{b} {a}", a + b))
            if d <= 3:
                want[i] = d
        assert {ref: d for ref, d, _ in trie.search(key, 3)} == want


def test_many_keys_are_found_as_one_by_one():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    trie = names.NameTrie([(i, word(rng.randrange(3, 8)), word(rng.randrange(3, 9))) for i in range(150)] + [(999, "g" * 40, "e" * 40)])
    keys = {f"{word(rng.randrange(1, 8))} {word(rng.randrange(2, 9))}" for _ in range(300)} | {"g" * 40 + " " + "e" * 39, "", "a"}
    for most in range(4):
        assert trie.search_all(keys, most) == {k: trie.search(k, most) for k in keys}
    assert [x[:2] for x in trie.match_all(["g" * 40 + " " + "e" * 39])[0]] == [(999, 1)]


def test_entries_beyond_the_nearest_are_listed(spark):
    ref = spark.createDataFrame([(1, "Abcdefgia", "longepithet"), (2, "Abcdefgia", "longepithot"), (3, "Abcdefgia", "longapithot")], "ref_id long, genus string, epithet string")
    df = spark.createDataFrame([("a", "Abcdefgia longepithet"), ("b", "Abcdefgia lngepithet")], "id string, name string")
    for most in (100, 1):
        got = {r.id: [(m.ref_id, m.distance) for m in r.matches] for r in names.match_names(df, "id", "name", ref, most).collect()}
        assert got == {"a": [(1, 0), (2, 1), (3, 2)], "b": [(1, 1), (2, 2), (3, 3)]}


def test_names(spark):
    ref = spark.createDataFrame([(1, "Abcdefgia", "longepithet"), (2, "Abcdefgia", "otherword"), (3, "Zyxwvuta", "longepithet"), (4, "Accentïa", "longepithet")], "ref_id long, genus string, epithet string")
    typed = {
        "a": ("Abcdefgia longepithet", 1), "b": ("longepithet, ABCDEFGIA", 1), "c": ("Abcdefgia_longepithet", 1), "d": ("Abcdefgialongepithet", 1), "e": ("cf. Zyxwvuta (longepithet) Smith, 1900", 3),
        "f": ("Abcdfgia longepithte", 1), "g": ("A. otherword", 2), "h": ("A. longepithet", -1), "i": ("Abcdefgia sp.", -1), "j": ("Abcdefgia strange", -1), "k": (None, -1), "l": ("", -1), "m": ("Zyxwvuta [voucher 12]", -1),
        "n": ("Аbcdefgia longepithet", 1), "o": ("12: Zyxwvuta longepithet", 3), "p": ("x" * 20000, -1),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in typed.items()] + [(None, "x")], "id string, name string")
    want = {k: r for k, (_, r) in typed.items()}
    for most in (100, 2):
        got = names.match_names(df, "id", "name", ref, most)
        assert {r.id: r.r for r in got.select("id", names.decided().alias("r")).collect()} == want
    assert {r.r for r in names.match_names(df, "id", "name", ref.limit(0)).select(names.decided().alias("r")).collect()} == {-1}


def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for i, x in items:
            v = words(x)
            if any(tuple(v[j : j + 10]) in runs for j in range(len(v) - 9)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("most_chars", [10**7, 400])
def test_leaks_against_brute_force(spark, most_chars):
    rng = random.Random(4)
    vocab = ["The", "a", "net", "pond", "Ünder", "x1"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(5, 20))) for i in range(40)] + [(100, None), (101, ""), (3, text(12))]
    docs = []
    for i in range(120):
        t = text(rng.randrange(0, 60)).split()
        v = rng.choice(items)[1] or ""
        v = v.split()
        a = rng.randrange(0, max(1, len(v) - 8))
        docs.append((i, " ".join(t + v[a : a + rng.randrange(8, 14)] + text(5).split()).replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [(500, None), (501, ""), (502, text(3000) + " " + items[0][1] + " " + text(900)), docs[0], (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, "doc_id", "text", it, "item_id", "text", most_chars=most_chars).collect()}
    assert got == {x for x in brute_leaks(docs, items) if x[0] is not None}
    assert leaks.find_leaks(d.limit(0), "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_mixing_properties(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None, "other"]), rng.randrange(0, 60)) for i in range(3000)]
    sized = spark.createDataFrame(rows + rows[:50], "doc_id long, source string, n_tokens long")
    goal = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.15, 2), "absent": (0.05, 4)}
    targets = spark.createDataFrame([(k, *v) for k, v in goal.items()], "source string, target_share double, max_repeats int")
    picked, shares = mixing.mix(sized, "doc_id", targets)
    picked = picked.collect()
    tokens = Counter()
    for r in picked:
        assert r.copies <= goal[r.source][1]
        tokens[r.source] += r.copies * r.n_tokens
    have = Counter()
    for _, s, n in rows:
        have[s] += n
    total = min(have[s] * m / (t / 0.95) for s, (t, m) in goal.items() if have[s])
    for r in shares.collect():
        assert r.used_tokens == tokens[r.source] and r.actual_share == pytest.approx(tokens[r.source] / sum(tokens.values()))
        want = total * goal[r.source][0] / 0.95 if have[r.source] else 0
        assert want - 61 <= r.used_tokens <= want + 1e-3
    again = mixing.mix(sized.orderBy("n_tokens").repartition(5), "doc_id", targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, picked))
    assert mixing.mix(sized.limit(0), "doc_id", targets)[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "s"), (4, "<|endoftext|>", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(df, "doc_id", "text", ["source"]).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1


def brute_spans(docs, span):
    seen = {}
    for d, t in set(docs):
        if d is not None and t is not None:
            for i in range(len(t) - span + 1):
                seen.setdefault(t[i : i + span], set()).add(d)
    out = Counter()
    for d, t in set(docs):
        if d is not None and t is not None:
            hit = {j for i in range(len(t) - span + 1) if len(seen[t[i : i + span]]) > 1 for j in range(i, i + span)}
            out[d] += len(hit)
    return {d: n for d, n in out.items() if n}


@pytest.mark.parametrize("hot", [200, 10**9])
def test_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    pool = [text(80) for _ in range(6)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(pool)
            a = rng.randrange(0, 30)
            t += p[a : a + rng.randrange(20, 60)] + text(rng.randrange(0, 20))
        docs.append((i, t))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, ""), (103, None), (104, text(20000) + pool[0]), docs[7], (None, pool[0]), (105, "a" * 300), (106, "a" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spans.shared_spans(df, "doc_id", "text", span=30).collect()
    assert {r.doc_id: r.shared_chars for r in got} == brute_spans(docs, 30)
    assert all(sum(v.end - v.begin for v in r.intervals) == r.shared_chars for r in got)
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0
