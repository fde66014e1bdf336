import math
import random
import tarfile

import numpy as np
import pandas as pd
import pytest

from siltflow.functions import iupac
from siltflow.functions.iupac import revcomp
from siltflow.functions.seeds import seeds, window_hashes
from siltflow.operators import align, cluster, colmatch, denoise, derep, diversity, pairend, primers, tables, taxonomy
from siltflow.plans.order import numbered
from siltflow.sources import external, files
from siltflow.streaming import derep as stream
from pyspark.sql import functions as F

T = "ACGTTGCATGCCGATTACGGATCCTAGGCTAAGTCCTGAA"


def test_reverse_complement(spark):
    df = spark.createDataFrame([("GGRK",), ("acgN-",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(iupac.reverse_complement(F.col("s"))).collect()] == ["MYCC", "-Ncgt", "", None]
    assert revcomp(revcomp("ACGTRYKMBDHVN")) == "ACGTRYKMBDHVN"


def merged(r1, r2, longest, least, q1=None):
    b = pd.DataFrame({"r1_seq": [r1], "r1_qual": [q1 or "I" * len(r1)], "r2_seq": [r2], "r2_qual": ["I" * len(r2)]})
    return pairend.merge_pair_batch(b, pairend.Composition((0.25,) * 4, longest), least, 1.0, -1.0).iloc[0]


def test_pairs_with_known_results():
    r = merged(T[:30], revcomp(T[10:]), 30, 10)
    assert (r.seq, r.overlap, r.mismatch) == (T, 20, 0) and r.ovl_score == pytest.approx(19.996, abs=1e-5) and r.p_value == pytest.approx(2.03e-10, rel=0.01)
    r = merged(T[:20] + "C" + T[21:30], revcomp(T[10:]), 30, 10, "I" * 20 + "#" + "I" * 9)
    assert (r.seq, r.overlap, r.mismatch) == (T, 20, 1) and r.ovl_score == pytest.approx(18.2065, abs=1e-4) and r.p_value == pytest.approx(7.65e-10, rel=0.01)
    r = merged(T[:26], revcomp(T[16:40]), 26, 10)
    assert (r.seq, r.overlap) == (T, 10) and r.p_value == pytest.approx(6.95e-05, rel=0.01)
    r = merged(T[:20], revcomp(T[15:35]), 20, 5)
    assert r.overlap == 0 and r.p_value == pytest.approx(0.0202, rel=0.01)
    assert merged("", "", 0, 10).overlap == 0


def test_overlap_chance_against_sums():
    def plain(q, least, score, longest):
        below = [sum(math.comb(i, k) * q**k * (1 - q) ** (i - k) for k in range(i + 1) if 2 * k - i < score) for i in range(least, longest + 1)]
        return 1 - math.prod(below) ** 2 if below else 0.0

    rng = np.random.default_rng(0)
    for _ in range(40):
        longest, q = int(rng.integers(5, 60)), float(rng.uniform(0.05, 0.95))
        least, score = rng.integers(1, longest + 3, 6), rng.uniform(-longest, longest, 6)
        assert pairend.overlap_chances(q, least, score, 1.0, -1.0, longest) == pytest.approx([plain(q, n, s, longest) for n, s in zip(least.tolist(), score)], abs=1e-9)


def test_pairs_by_place(spark):
    rng = random.Random(1)
    t = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(40)]
    one = spark.createDataFrame([(i, f"@{i}", x[:40].lower(), "I" * 40) for i, x in enumerate(t)], "rec_no long, id string, seq string, qual string")
    two = spark.createDataFrame([(i, f"@{i}", revcomp(x[20:]), "I" * 40) for i, x in enumerate(t[:-1])] + [(99, "@", None, None)], "rec_no long, id string, seq string, qual string")
    assert {r.rec_no: r.seq for r in pairend.pairend(one, two).collect()} == dict(enumerate(t[:-1]))
    assert pairend.pairend(one.limit(0), two).count() == 0


def test_dereplicate(spark):
    reads = spark.createDataFrame([("A", "E1", "S1", 1), ("A", "E1", "S1", 1), ("A", None, None, 1), ("a", "E1", "S1", 1), (None, "E1", "S1", 1)], "seq string, exp string, sample string, size int")
    assert {tuple(r) for r in derep.dereplicate(reads).collect()} == {("A", "E1", "S1", 2), ("A", "none", "no_sample", 1), ("a", "E1", "S1", 1)}
    heads = spark.createDataFrame([("x;size=3;",), ("y;size=5;z size=2",), (None,)], "h string")
    assert tuple(derep.count_records(heads, "h").first()) == (3, 10)


def obs(spark, counts):
    return spark.createDataFrame([(s, "e", "p", n) for s, n in counts.items()], "seq string, exp string, sample string, cnt long")


def test_denoise_known(spark):
    got = {r.seq: r.status for r in denoise.denoise(obs(spark, {"ACGTACGT": 100, "ACGTACGA": 4, "ACGTACCA": 1, "TTTTTTTT": 50}), min_retained=0).collect()}
    assert got == {"ACGTACGT": "head", "ACGTACGA": "internal", "ACGTACCA": "singleton", "TTTTTTTT": "singleton"}
    assert {r.seq for r in denoise.denoise(obs(spark, {"ACGTACGT": 100, "ACGTACGA": 4, "TTTTTTTT": 50})).collect()} == {"ACGTACGT", "TTTTTTTT"}
    assert {r.seq: r.status for r in denoise.denoise(obs(spark, {"ACGTACGT": 100, "ACGTACGA": 5}), min_retained=0).collect()}["ACGTACGA"] == "internal"


@pytest.mark.parametrize("diff,indel", [(1, 0), (2, 1), (0, 2), (3, 3)])
def test_neighbours_against_brute_force(spark, diff, indel):
    rng = random.Random(7)
    seqs = list({"".join(rng.choice("ACN") for _ in range(rng.randrange(3, 9))) for _ in range(120)})
    got = {(r.a, r.b) for r in denoise.neighbour_pairs(obs(spark, dict.fromkeys(seqs, 3)), diff, indel).collect()}

    def inside(x, y):
        it = iter(y)
        return all(c in it for c in x)

    want = set()
    for a in seqs:
        for b in seqs:
            if a < b and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= diff) or (1 <= abs(len(a) - len(b)) <= indel and inside(min(a, b, key=len), max(a, b, key=len)))):
                want.add((a, b))
    assert got == want


def test_denoise_moves_little_more_than_its_input(spark):
    """Counts move without their sequences, and no text less one letter is made for each letter."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [word(300) for _ in range(200)]
    rows = [(t, "e", f"s{k}", 100) for t in seqs for k in range(5)]
    rows += [(seqs[0][:i] + seqs[0][i + 1 :], "e", "s1", 10) for i in (0, 150, 299)] + [(seqs[1][:150] + "GG" + seqs[1][152:], "e", "s2", 10), (seqs[2][:150] + "N" + seqs[2][150:], "e", "s9", 10)]
    df = spark.createDataFrame(rows, "seq string, exp string, sample string, cnt long")

    def moved():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    before = moved()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.seq, r.sample): r.status for r in denoise.denoise(df, 0.5, 3, 1, min_retained=0).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved() - before < 1_000_000
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v == "internal"} == {(r[0], r[2]) for r in rows[1000:] if r[2] != "s9" and r[0] not in seqs}
    assert {k for k, v in got.items() if v == "head"} == {(seqs[0], "s1"), (seqs[1], "s2")}


@pytest.mark.parametrize("method,threshold,want", [("maximum", 10, 12), ("mean", 10, 16), ("threshold", 10, 20), ("threshold", 5, 0), ("both_threshold", 5, 0)])
def test_decontamination(spark, method, threshold, want):
    cells = spark.createDataFrame([("e", "x", "F1", 20), ("e", "x", "B1", 3), ("e", "x", "B2", 8), ("e", "x", "B3", 1), ("e", "y", "F1", 4)], "experiment string, id string, tag string, cnt long")
    control = spark.createDataFrame([("s", "F1", "sample", "b", None, None), *[("b", f"B{i}", "EB", None, None, None) for i in (1, 2, 3)]], "sample string, tag string, category string, eb string, fb string, pb string")
    got = {r.id: (r.tag, r.cnt) for r in tables.decontaminate(cells, control, method, threshold=threshold).collect()}
    assert got == {"x": ("F1", want), "y": ("F1", 4)}
    with pytest.raises(ValueError):
        tables.decontaminate(cells, control, "other")


def test_merge_replicates(spark):
    cells = spark.createDataFrame([("e", "x", "F1", 5), ("e", "y", "F1", 5), ("e", "x", "F2", 0), ("e", "x", "F3", 1), ("e", "y", "F3", 3)], "experiment string, id string, tag string, cnt long")
    control = spark.createDataFrame([("s", f"F{i}", "g", "sample") for i in (1, 2, 3)] + [("t", "F9", "h", "sample")], "sample string, tag string, grp string, category string")
    value = lambda *a, **k: {r.id: r.value for r in tables.merge_replicates(cells, control, *a, **k).collect()}
    assert value("mean_rra")["x"] == 0.375 and value("max_rra")["x"] == 0.5 and value("both_occur", 3) == {} and value("both_occur", 2, True) == {"x": 1.0, "y": 1.0}
    assert tables.replicate_columns(control) == ["g_s", "g_t", "h_s", "h_t"]


def test_lineages(spark):
    nodes = spark.createDataFrame([(1, 1, None, "root"), (2, 1, "kingdom", "K"), (3, 2, "genus", "G"), (4, 5, "genus", "L"), (5, 4, "family", "F")], "tax_id long, parent long, rank string, name string")
    lineage = taxonomy.lineages(nodes, "tax_id", "parent", "rank", "name")
    asked = spark.createDataFrame([(3,), (99,), (4,)], "q long")
    got = {r.q: (r.kingdom, r.family, r.genus) for r in taxonomy.get_taxonomy(asked, lineage, "q").collect()}
    assert got == {3: ("K", None, "G"), 99: (None, None, None), 4: (None, None, "L")}


def test_accessions(spark):
    acc = spark.createDataFrame([("A1", "A1.1", 7)], ["accession", "accession.version", "taxid"])
    asked = spark.createDataFrame([(0, "A1"), (1, "ZZ"), (2, "A1")], "n int, a string")
    assert [r.taxid for r in taxonomy.get_taxid(asked, acc, "a", False).orderBy("n").collect()] == [7, None, 7]


def test_lca(spark):
    row = lambda q, n, i, e, genus, species: (q, f"s{n}", n, float(i), float(e), 100.0, None, None, None, None, None, genus, species)
    hits = spark.createDataFrame(
        [row("q1", 1, 99, 0, "G", "G a"), row("q1", 2, 99, 0, "G", "G b"), row("q2", 3, 99, 1, "H", "H a"), row("q2", 4, 98, 0, "H", "H b")],
        "qseqid string, sseqid string, staxids int, pident double, evalue double, qcovs double, kingdom string, phylum string, class string, `order` string, family string, genus string, species string",
    )
    (r,) = taxonomy.find_lca(hits, ["staxids"]).collect()
    assert (r.qseqid, r["rank"], r.scientific_name, r.taxid, r.accession) == ("q1", "genus", "G sp. 1", "1;2", "s1;s2")
    assert taxonomy.find_lca(hits, ["staxids"], keep_unresolved=True).count() == 2


def test_names(spark):
    df = spark.createDataFrame([("  Homo_Sapiens (L.) ",), ("--",), (None,)], "n string")
    got = [tuple(r) for r in df.select(colmatch.normalise(F.col("n")), colmatch.normalise(F.col("n"), True)).collect()]
    assert got == [("homo sapiens l", "homo sapiens i"), (None, None), (None, None)]
    assert colmatch.clean_column("col:scientificName") == "scientificname"


def test_synonyms_and_constraints(spark):
    taxa = spark.createDataFrame(
        [("k", None, "Animalia", "kingdom", "accepted", None), ("g", "k", "Abc", "genus", "accepted", None), ("s", "g", "Abc defg", "species", "accepted", "X"), ("o", "s", "Old defg", "species", "synonym", "Y")],
        "taxon_id string, parent_id string, scientific_name string, rank string, status string, authorship string",
    )
    checklist = colmatch.build(taxa)
    asked = spark.createDataFrame([(1, "old  DEFG", "animalia"), (2, "Abc defq", None), (3, "Old defg", "Plantae"), (4, "nothing", None)], "i int, name string, kd string")
    got = {r.i: (r.match_type, r.accepted_name, r.genus, r.distance) for r in colmatch.match(asked, "name", checklist, constraints={"kingdom": "kd"}, fuzzy=True).collect()}
    assert got == {1: ("exact", "Abc defg", "Abc", 0), 2: ("fuzzy", "Abc defg", "Abc", 1)}


def test_distances_known_and_bounded():
    from siltflow.functions import distances as ds

    assert (ds.osa("ca", "abc"), ds.damerau("ca", "abc"), ds.lcs("kitten", "sitting"), ds.hamming("karolin", "kathrin"), ds.hamming("a", "ab")) == (3, 2, 5, 3, ds.FAR)
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        for f, most in ds.METHODS.values():
            assert f(a, b) == f(b, a) and lev(a, b) <= most * f(a, b) and (f(a, b) == 0) == (a == b)
        assert ds.damerau(a, b) <= ds.osa(a, b) <= lev(a, b) <= ds.lcs(a, b)


def test_primer_sites():
    assert primers.sites("AACGTACT", "ACG", 1, "pattern") == [(1, 0), (5, 1)]
    assert primers.sites("ANG", "ACG", 0, "pattern") == [] and primers.sites("ANG", "ACG", 0, "both") == [(0, 0)]
    assert primers.sites("CGT", "ACG", 1, "both") == [(-1, 1)] and primers.sites("", "A", 0, "literal") == []
    ref = "TTACGGGGTTTCCAA"
    assert primers.amplicons(ref, "ACG", "GGA", 0, True, 5) == [(6, 10, "GGGTT")]
    assert primers.amplicons(ref, "ACG", "GGA", 0, False, 5)[0][2] == "ACGGGGTTTCC"
    assert primers.amplicons("TTACTGGGTTTCCAA", "ACG#", "GGA", 1, True, 5) == [] and primers.amplicons("TTACTGGGTTTCCAA", "ACG", "GGA", 1, True, 5) != []


def test_demultiplex(spark):
    table = spark.createDataFrame([(1, "x", "s1", "AACC:GGTT", "ACGTACGTAC", "TTGGCCTTGG"), (2, "x", "s2", "CACA", "acgtacgtac", "TTGGCCTTGG")], "row_no long, exp string, sample string, tags string, forward_primer string, reverse_primer string")
    read = "T" + "AACC" + "ACGTACGTAC" + "GATTACA" + revcomp("TTGGCCTTGG") + revcomp("GGTT") + "G"
    rows = [(1, "a", read), (2, "b", revcomp(read)), (3, "c", read.replace("AACC", "CACA")), (4, "d", None), (5, "e", ""), (6, "f", read.replace("ACGTACGTAC", "ACGTTCGTAC"))]
    df = spark.createDataFrame(rows, "rec_no long, id string, seq string")
    got = {r.rec_no: (r.identified, r.sample, r.seq, r.fwd_mismatch) for r in primers.demultiplex(df, table, 1).collect()}
    assert got[1] == got[2] == (True, "s1", "GATTACA", 0) and got[6] == (True, "s1", "GATTACA", 1)
    assert [got[i][0] for i in (3, 4, 5)] == [False] * 3
    assert primers.demultiplex(df.where("rec_no = 3"), table, 1, with_tag=False).first().sample == "s1"


def test_hill_numbers():
    a = diversity.Abundances(np.array([1, 2, 5, 10]), np.array([3, 2, 1, 1]))
    assert a.diversity(a.n, 0) == pytest.approx(7) and a.diversity(1, 0) == a.diversity(1, 1) == pytest.approx(1)
    p = np.repeat([1, 2, 5, 10], [3, 2, 1, 1]) / a.n
    assert a.diversity(a.n, 1) == pytest.approx(np.exp(-(p * np.log(p)).sum())) and a.diversity(a.n, 2) == pytest.approx(1 / (p**2).sum())
    for q in (0, 1, 2):
        grow = [a.diversity(m, q) for m in (1, 5, 12, a.n - 1, a.n, a.n + 1, 60)]
        assert grow == sorted(grow)
    assert a.coverage(a.n) == pytest.approx(1 - 3 / a.n * a.a)


def test_rarefaction_reaches_the_observed_size(spark):
    from siltflow import queries_ref

    d = "/root/testdata/sf0.001"
    size = {r.tag: r.n for r in queries_ref.latest_cells(spark, d).where("cnt > 0").groupBy("tag").agg(F.sum("cnt").alias("n")).collect()}
    assert max(size.values()) > 500
    for name in ("rarefaction_q0", "rarefaction_q1", "rarefaction_q2"):
        rows = queries_ref.QUERIES[name](spark, d).collect()
        assert {r.tag: r.m for r in rows if r.method == "Observed"} == {t: n for t, n in size.items() if n <= 150_000}
        assert {t: max(r.m for r in rows if r.tag == t) for t in size} == {t: 150_000 for t in size}


def test_chance_of_none_far_out():
    from decimal import Decimal, getcontext

    from siltflow.functions.numbers import chance_of_none, harmonic

    getcontext().prec = 40
    for n, x, m in ((20_000, 9_000, 20_000), (20_000, 9_000, 1), (20_000, 9_000, 30), (20_000, 5_000, 7_000), (20_000, 19_990, 1), (50_000, 4_097, 2_000), (20_000, 15_000, 6_000)):
        want = Decimal(1)
        for j in range(m):
            want *= Decimal(max(n - x - j, 0)) / Decimal(n - j)
        assert chance_of_none(n, np.array([x]), m)[0] == pytest.approx(float(want), rel=1e-9, abs=1e-300)
    assert harmonic(np.array([0, 1, 5, 31, 32, 100])) == pytest.approx([sum(1 / i for i in range(1, k + 1)) for k in (0, 1, 5, 31, 32, 100)], rel=1e-14)


def test_intervals(spark):
    rng = random.Random(3)
    rows = [(t, rng.randrange(1, 40)) for t in "ab" for _ in range(80)] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "tag string, cnt long")
    got = diversity.rarefaction(df, q=0, endpoint=5_000, knots=12, nboot=30).toPandas()
    again = diversity.rarefaction(df, q=0, endpoint=5_000, knots=12, nboot=30).toPandas()
    key = ["tag", "based", "m"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert set(got.tag) == {"a", "b", "c"} and set(got.based) == {"size", "coverage"}
    assert ((got.qD_LCL <= got.qD) & (got.qD <= got.qD_UCL)).all() and got[got.based == "coverage"].SC_LCL.isna().all()
    seen = got[(got.method == "Observed") & (got.based == "size") & (got.tag == "a")].iloc[0]
    assert seen.qD == 80 and 0 < seen.qD_UCL - seen.qD < 20


def test_drawn_entropy():
    a = diversity.Abundances(np.array([1, 2, 5, 40]), np.array([3, 2, 1, 1]))
    for m in (1, 7, 30, a.n - 1):
        f = [sum(g * math.comb(x, k) * math.comb(a.n - x, m - k) for x, g in ((1, 3), (2, 2), (5, 1), (40, 1))) / math.comb(a.n, m) for k in range(1, m + 1)]
        assert a.diversity(m, 1) == pytest.approx(math.exp(-sum(p * k / m * math.log(k / m) for k, p in enumerate(f, 1))))
    few, many = (diversity.Abundances(np.array([1, 2, 5000]), np.array([g, 300, 1])) for g in (100, 30))
    assert few.entropy() > 0 and many.entropy() > 0


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        r = [i]
        for j, y in enumerate(b, 1):
            r.append(min(p[j] + 1, r[-1] + 1, p[j - 1] + (x != y)))
        p = r
    return p[-1]


def test_clusters_against_sequential(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(8)]
    seqs = set()
    for b in base:
        for _ in range(5):
            s = list(b)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([[], ["A"], ["C", "G"]])
            seqs.add("".join(s))
    rows = [(s, rng.randrange(1, 50)) for s in sorted(seqs)]
    df = spark.createDataFrame(rows, "seq string, size long")
    limit = lambda a, b: int(0.1 * max(len(a), len(b)) + 1e-9)
    pairs = {(r.a, r.b) if (len(r.a), r.a) < (len(r.b), r.b) else (r.b, r.a) for r in cluster.similar_pairs(df, 0.9).collect()}
    assert pairs == {(a, b) for a in seqs for b in seqs if (len(a), a) < (len(b), b) and lev(a, b) <= limit(a, b)}
    want, centroids = {}, []
    for s in sorted(seqs, key=lambda x: (-len(x), x)):
        near = [(lev(s, c), -len(c), c) for c in centroids if lev(s, c) <= limit(s, c)]
        want[s] = min(near)[2] if near else s
        if not near:
            centroids.append(s)
    assert {r.seq: r.centroid for r in cluster.greedy_clusters(df, 0.9).collect()} == want


def test_one_long_text_hides_no_pair(spark):
    rng = random.Random(4)
    base, long = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (90, 6000))
    near, gap = base[:40] + ("A" if base[40] != "A" else "C") + base[41:], base[:20] + base[21:]
    df = spark.createDataFrame([(base,), (near,), (gap,), (long,), (long[:5990],)], "seq string")
    want = {(a, b, lev(a, b)) for a in (base, near, gap) for b in (base, near, gap) if (len(a), a) < (len(b), b) and lev(a, b) <= 2} | {(long[:5990], long, 10)}
    assert len(want) == 4 and {tuple(r) for r in cluster.similar_pairs(df).collect()} == want
    few = df.where("length(seq) < 100")
    assert {tuple(r) for r in cluster.similar_pairs(few, max_edits=1).collect()} == {w for w in want if w[2] < 2}


def test_chimera_and_search(spark):
    rng = random.Random(3)
    a, b, c = ("".join(rng.choice("ACGT") for _ in range(100)) for _ in range(3))
    df = spark.createDataFrame([(a, 50), (b, 40), (a[:50] + b[50:], 5), (c, 5)], "seq string, size long")
    assert {r.seq for r in cluster.chimeras(df).collect() if r.chimeric} == {a[:50] + b[50:]}
    db = spark.createDataFrame([("a", a), ("b", b)], "id string, seq string")
    q = spark.createDataFrame([("q", a[:49] + "A" + a[50:]), ("n", c), ("z", "")], "id string, seq string")
    assert [(r.qseqid, r.sseqid) for r in cluster.search(q, db).collect()] == [("q", "a")]


def test_reference_chimeras_in_sorted_order(spark):
    """Beginnings that many share lie in several ranges; nothing is made for each beginning."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("AC") for _ in range(n))
    starts, stops = [word(5) for _ in range(3)], [word(5) for _ in range(3)]
    ref = sorted({rng.choice(starts) + word(rng.randrange(0, 7)) + rng.choice(stops) for _ in range(150)})
    asked = sorted({*[rng.choice(ref)[: rng.randrange(3, 12)] + rng.choice(ref)[-rng.randrange(3, 12) :] for _ in range(150)], *ref[:20], "AC", "", "G" * 9})
    # One text is one range of its own when there are few.
    for parents, texts in ((ref, asked), (ref[:2], asked), ([], asked[:20]), (["A" * 8 + w for w in asked], ["A" * 8 + w for w in asked])):
        got = cluster.chimeras(spark.createDataFrame([(t, 1) for t in texts], "seq string, size long"), min_part=4, reference=spark.createDataFrame([(t,) for t in parents], "seq string"))
        assert "Generate" not in got._jdf.queryExecution().toString()
        rows = {r.seq: (r.left, r.right, r.chimeric) for r in got.collect()}

        def best(text, has, part):
            n = next((n for n in range(len(text), 3, -1) if any(has(p, part(text, n)) for p in parents)), 0)
            return n, max((p for p in parents if n and has(p, part(text, n))), default=None)

        want = {}
        for t in texts:
            (ln, lp), (rn, rp) = best(t, str.startswith, lambda t, n: t[:n]), best(t, str.endswith, lambda t, n: t[len(t) - n :])
            want[t] = (lp, rp, bool(lp and rp and ln < len(t) and rn < len(t) and ln + rn >= len(t) and lp != rp))
        assert rows == want


def plain_local(a, b):
    h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if x == y else -2), h[i - 1][j] - 2.5, h[i][j - 1] - 2.5)
            best = max(best, h[i][j])
    return best


def test_alignments_against_plain_tables(spark):
    rng = random.Random(4)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 50))) for _ in range(40)]
    b = [x[5:20] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 9))) + x[22:45] for x in a]
    for q, s, (score, cells) in zip(a, b, align.best_paths(a, b)):
        assert score == plain_local(q, s)
        row = align.describe(q, s, score, cells, 1000)
        if row:
            pident, length, mismatch, gapopen, q0, q1, s0, s1 = row[:8]
            equal = round(pident * length / 100)
            gaps = length - equal - mismatch
            assert equal - 2 * mismatch - 2.5 * gaps == score and (q1 - q0 + 1) + (s1 - s0 + 1) == 2 * length - gaps and gapopen <= gaps
    q, t = "TTTACGTACGTAGGATCCA", "ACGTACGTACGGATCCA"
    seqs = lambda x: spark.createDataFrame(x, "id string, seq string")
    hits = spark.createDataFrame([("q", "t"), ("q", "t"), ("q", "u"), ("z", "t")], "qseqid string, sseqid string")
    (r,) = align.align_hits(hits, seqs([("q", q.lower()), ("z", None)]), seqs([("t", t), ("u", "")])).collect()
    assert (r.qseqid, r.sseqid, r.qend, r.send) == ("q", "t", 19, 17) and r.bitscore > 10
    assert align.align_hits(hits.limit(0), seqs([("q", q)]), seqs([("t", t)])).count() == 0


def test_common_stretches_have_common_seeds():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 27, 28, 90, 200)]
    texts.append(texts[3][20:60] + texts[4][100:130])
    text, k = seeds(texts, 28, 21)
    of = [set(k[text == i].tolist()) for i in range(len(texts))]
    assert not of[0] and not of[1] and len(of[2]) == 1 and of[5] & of[3] and of[5] & of[4] and not of[3] & of[4]
    for length in (1, 2, 5, 21):
        codes = np.frombuffer(texts[4].encode(), np.uint8)
        h = window_hashes(codes, length)
        assert len(h) == len(codes) - length + 1
        of_text = {}
        for i, x in enumerate(h.tolist()):
            of_text.setdefault(texts[4][i : i + length], set()).add(x)
        assert all(len(v) == 1 for v in of_text.values()) and len(set(h.tolist())) == len(of_text)


def test_search_follows_the_seeds_of_a_large_family(spark):
    rng = random.Random(9)
    base, family = "".join(rng.choice("ACGT") for _ in range(60)), {}
    while len(family) < 5000:
        s = list(base)
        for i in rng.sample([*range(30), *range(31, 60)], rng.randrange(1, 3)):
            s[i] = rng.choice("ACGT")
        family.setdefault("".join(s), f"s{len(family):04}")
    q = base[:30] + ("A" if base[30] != "A" else "C") + base[31:]
    mers = lambda t: {t[i : i + 28] for i in range(33)}
    hits = sorted((-round(100 * (1 - lev(q, s) / 60), 3), k) for s, k in family.items() if mers(s) & mers(q))
    db = spark.createDataFrame([(k, s) for s, k in family.items()], "id string, seq string")
    found = cluster.search(spark.createDataFrame([("q", q)], "id string, seq string"), db)
    assert {(-r.pident, r.sseqid) for r in found.collect()} == set(hits[:10])


def test_files(spark, tmp_path):
    fq = tmp_path / "a.fastq"
    fq.write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n@half\nAC\n")
    assert [(r.rec_no, r.id, r.seq, r.qual) for r in files.read_fastq(spark, str(fq)).orderBy("rec_no").collect()] == [(0, "@r1", "ACGT", "IIII"), (1, "@r2", "GG", "II")]
    fa = tmp_path / "a.fas"
    fa.write_text(">x one\nAC\nGT\n>empty\n>y\nTT\n")
    assert {tuple(r) for r in files.read_fasta(spark, str(fa)).collect()} == {("x one", "ACGT"), ("y", "TT")}
    assert files.sniff(str(fq)) == (False, "fastq") and files.sniff(str(fa)) == (False, "fasta")
    files.write_fasta(files.read_fasta(spark, str(fa)), str(tmp_path / "o.fas.gz"))
    assert {tuple(r) for r in files.read_fasta(spark, str(tmp_path / "o.fas.gz")).collect()} == {("x one", "ACGT"), ("y", "TT")}
    merged = spark.createDataFrame([("@a b", "AC", "II", 0, 20, 19.996)], "id string, seq string, qual string, mismatch int, overlap int, ovl_score double")
    files.write_fastq(merged, str(tmp_path / "m"))
    assert files.read_fastq(spark, str(tmp_path / "m")).first().id == '@a_b;{"pairend":{"mismatch":0,"overlap":20,"ovl_score":19.996}}'
    (tmp_path / "p.txt").write_text("#exp\tsample\ttags\tforward_primer\treverse_primer\ntrnL\tF001\taacc:ggtt\tacg\tttg\n\n")
    assert tuple(files.read_primer_table(spark, str(tmp_path / "p.txt")).first()) == (1, "trnL", "F001", "AACC:GGTT", "ACG", "TTG")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n1\t|\tall\t|\t\t|\tsynonym\t|\n")
    assert [tuple(r) for r in files.read_names(spark, str(tmp_path / "names.dmp")).collect()] == [(1, "root")]
    page = spark.createDataFrame([('<a href="nt.00.tar.gz">nt.00.tar.gz</a>  2024-01-02 03:04  2.5G',), ('<a href="nt.00.tar.gz.md5">x</a> 2024-01-02 03:04 1K',)], "l string")
    assert [(r.file_name, r.size_gb) for r in files.listing(page, "l").collect()] == [("nt.00.tar.gz", 2.5)]
    (tmp_path / "c.tsv").write_text("col:ID\tcol:parentID\tcol:scientificName\tcol:rank\nx\t\tAbc\tgenus\n")
    assert files.read_checklist(spark, str(tmp_path / "c.tsv")).columns == ["taxon_id", "parent_id", "scientific_name", "rank"]
    with tarfile.open(tmp_path / "d.tar.gz", "w:gz") as t:
        t.add(tmp_path / "names.dmp", "names.dmp")
    (tmp_path / "out").mkdir()
    assert files.unpack(str(tmp_path / "d.tar.gz"), str(tmp_path / "out")) == ["names.dmp"]
    assert files.read_names(spark, str(tmp_path / "out" / "names.dmp")).count() == 1
    (tmp_path / "two").mkdir()
    for k, lines in (("a", "x1\nx2\n"), ("b", "y1\r\ny2\ny3"), ("c", "")):
        (tmp_path / "two" / f"{k}.txt").write_bytes(lines.encode())
    assert sorted(map(tuple, files.numbered_lines(spark, str(tmp_path / "two")).collect())) == [(0, "x1"), (1, "x2"), (2, "y1"), (3, "y2"), (4, "y3")]
    with pytest.raises(ValueError):
        external.chimera_args("a", "b", "uchime_ref")
    assert external.cluster_args("a", "b", 0.9)[-1] == "1" and "6 std qcovs staxids" in external.search_args("q", "o", "db")
    with pytest.raises(FileNotFoundError):
        external.find("no-such-program-here")
    assert primers.split_tags("aa:cc") == ("AA", "CC") and primers.split_tags(":aa") == (":AA", ":AA")


def test_stream(spark, tmp_path):
    rows = [(i, "ACGT"[i % 4], "e", "s", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "rec_no long, seq string, exp string, sample string, t string").withColumn("loaded_at", F.to_timestamp("t")).drop("t")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = stream.read_drops(spark, str(tmp_path / "in"), files_a_batch=1)
    stream.start(stream.running_counts(src), str(tmp_path / "counts"), str(tmp_path / "c1")).awaitTermination()
    assert {tuple(r) for r in stream.latest(spark, str(tmp_path / "counts"), "cnt").collect()} == {(c, "e", "s", 5) for c in "ACGT"}
    stream.start(stream.counts_by_window(src, late="30 days"), str(tmp_path / "windows"), str(tmp_path / "c2")).awaitTermination()
    assert sum(r.reads for r in stream.latest(spark, str(tmp_path / "windows"), "reads").collect()) == 20
    df.limit(4).write.mode("append").parquet(str(tmp_path / "in"))
    stream.start(stream.running_counts(src), str(tmp_path / "counts"), str(tmp_path / "c1")).awaitTermination()
    assert sum(r.cnt for r in stream.latest(spark, str(tmp_path / "counts"), "cnt").collect()) == 24


def test_numbers_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", None, "x"]), i) for i in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "k string, v int")
    want = {(k, v): sum(1 for a, b in rows if a == k and b <= v) for k, v in rows}
    assert {(r.k, r.v): r.no for r in numbered(df, ["v"], "no", ["k"]).collect()} == want
    assert [r.no for r in numbered(df, ["v"], "no").orderBy("v").collect()] == list(range(1, 601))
    assert numbered(df.limit(0), ["v"], "no").count() == 0
