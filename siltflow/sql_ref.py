"""SQL for the metabarcoding queries."""

from __future__ import annotations

from siltflow.operators.taxonomy import RANKS
from siltflow.sql_core import _CELLS, _FOREST, _NESTED

_DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_READS = f"reads AS (SELECT doc_id rec_no, CAST(doc_id AS VARCHAR) prefix, {_DNA.format('text')} seq, coalesce(lang, 'none') exp, coalesce(source, 'no_sample') sample FROM documents WHERE text IS NOT NULL)"
_OBS = """obs0 AS (SELECT seq, e.key exp, unnest(map_entries(e.value)) s FROM (SELECT seq, unnest(map_entries(m)) e FROM (SELECT min(seq) seq, any_value(exp_sample_count) m FROM node WHERE node_id IS NOT NULL GROUP BY node_id)) WHERE seq IS NOT NULL),
obs AS (SELECT seq, exp, s.key AS sample, sum(s.value) cnt FROM obs0 GROUP BY 1, 2, 3)"""
_EVENTS = f"""ev AS (SELECT event_type exp, CAST(event_id % 4 AS VARCHAR) sample, event_id, {_DNA.format("CAST(user_id % 5 AS VARCHAR)")} base FROM events),
ev2 AS (SELECT exp, sample, CASE WHEN event_id % 10 <> 0 THEN base ELSE substr(base, 1, (event_id // 10) % 32) || CASE WHEN substr(base, (event_id // 10) % 32 + 1, 1) = 'A' THEN 'C' ELSE 'A' END || substr(base, (event_id // 10) % 32 + 2) END seq FROM ev),
obs AS (SELECT seq, exp, sample, count(*) cnt FROM ev2 GROUP BY 1, 2, 3)"""


def _denoise(obs: str, threshold: float, diff: int, indel: int, keep: bool) -> str:
    pairs = f"length(a.seq) = length(b.seq) AND hamming(regexp_replace(upper(a.seq), '[^ACGT]', 'N', 'g'), regexp_replace(upper(b.seq), '[^ACGT]', 'N', 'g')) <= {diff}"
    union = f"""UNION SELECT a.exp, a.sample, a.seq, b.seq, a.cnt, b.cnt FROM obs a JOIN obs b USING (exp, sample) WHERE a.seq < b.seq AND abs(length(a.seq) - length(b.seq)) BETWEEN 1 AND {indel}
      AND CASE WHEN least(a.cnt, b.cnt) / greatest(a.cnt, b.cnt) <= {threshold} AND (left(a.seq, 4) = left(b.seq, 4) OR right(a.seq, 4) = right(b.seq, 4)) THEN levenshtein(a.seq, b.seq) = abs(length(a.seq) - length(b.seq)) ELSE false END""" if indel else ""
    return f"""WITH {obs},
    p AS (SELECT a.exp, a.sample, a.seq sa, b.seq sb, a.cnt ca, b.cnt cb FROM obs a JOIN obs b USING (exp, sample) WHERE a.seq < b.seq AND least(a.cnt, b.cnt) / greatest(a.cnt, b.cnt) <= {threshold} AND CASE WHEN length(a.seq) = length(b.seq) THEN {pairs} ELSE false END {union}),
    e AS (SELECT exp, sample, CASE WHEN ca < cb THEN sa ELSE sb END child, CASE WHEN ca < cb THEN sb ELSE sa END parent FROM p WHERE least(ca, cb) / greatest(ca, cb) <= {threshold}),
    st AS (SELECT seq, exp, sample, CAST(cnt AS BIGINT) cnt, CASE WHEN (exp, sample, seq) IN (SELECT (exp, sample, child) FROM e) THEN 'internal' WHEN (exp, sample, seq) IN (SELECT (exp, sample, parent) FROM e) THEN 'head' ELSE 'singleton' END status FROM obs),
    k AS (SELECT * FROM st {"" if keep else "WHERE status <> 'internal'"})
    SELECT seq, exp, sample, cnt, status, CAST(sum(cnt) OVER (PARTITION BY seq) AS BIGINT) size FROM k QUALIFY size >= 10"""


_DECON = f"""WITH {_CELLS}, x AS (SELECT experiment, id, tag, n AS cnt FROM cells WHERE n IS NOT NULL),
links AS (SELECT sample, tag, category, 'EB' type, eb blank FROM control_table UNION ALL SELECT sample, tag, category, 'FB', fb FROM control_table UNION ALL SELECT sample, tag, category, 'PB', pb FROM control_table),
bt AS (SELECT DISTINCT c.tag, c.sample blank, c.category type FROM control_table c WHERE c.category IN ('EB', 'FB', 'PB') AND c.sample IN (SELECT blank FROM links WHERE blank IS NOT NULL) AND c.tag IN (SELECT tag FROM x)),
wid AS (SELECT blank, type, count(*) w FROM bt GROUP BY 1, 2),
val AS (SELECT x.experiment, x.id, bt.blank, bt.type, max(cnt) most, sum(cnt) total, any_value(w) w FROM x JOIN bt USING (tag) JOIN wid USING (blank, type) GROUP BY 1, 2, 3, 4),
lev AS (SELECT *, %s lv FROM val),
tgt AS (SELECT DISTINCT tag, type, blank FROM links WHERE category = 'sample' AND blank IS NOT NULL),
dirt AS (SELECT experiment, id, tgt.tag, sum(lv) lv FROM lev JOIN tgt USING (type, blank) GROUP BY 1, 2, 3)
SELECT x.experiment, x.id, x.tag, CAST(%s AS BIGINT) cnt FROM x LEFT JOIN dirt ON dirt.experiment = x.experiment AND dirt.id = x.id AND dirt.tag = x.tag WHERE x.tag NOT IN (SELECT tag FROM bt)"""
_MINUS, _GATE = "greatest(cnt - coalesce(lv, 0), 0)", "CASE WHEN coalesce(lv, 0) > 0 THEN 0 ELSE cnt END"


def _merge(value: str, where: str = "", out: str = "round(value, 9)") -> str:
    return f"""WITH {_CELLS}, x AS (SELECT experiment, id, tag, n AS cnt FROM cells WHERE n IS NOT NULL),
    tot AS (SELECT tag, sum(cnt) total FROM x GROUP BY 1 HAVING sum(cnt) > 0),
    reps AS (SELECT DISTINCT tag, grp, sample, total FROM control_table JOIN tot USING (tag) WHERE category = 'sample'),
    wid AS (SELECT grp, sample, count(*) w FROM reps GROUP BY ALL),
    per AS (SELECT experiment, id, grp, sample, sum(cnt / total) s, max(cnt / total) m, count(*) FILTER (WHERE cnt > 0) seen FROM x JOIN reps USING (tag) GROUP BY ALL),
    v AS (SELECT experiment, id, per.grp, per.sample, {value} AS value FROM per JOIN wid ON wid.grp IS NOT DISTINCT FROM per.grp AND wid.sample IS NOT DISTINCT FROM per.sample)
    SELECT experiment, id, grp, sample, {out} AS value FROM v WHERE value > 0"""


_Q = ", ".join(f'"{r}"' for r in RANKS)
_LINEAGE = f"""link2 AS (SELECT id, parent FROM link WHERE tbl = 'nodes'),
own AS (SELECT CAST(n.tax_id AS VARCHAR) nid, any_value(rank) rank, min(name) "name", bool_or(n.tax_id = n.parent_tax_id) self FROM nodes n LEFT JOIN (SELECT tax_id, min(name) "name" FROM tax_names WHERE name IS NOT NULL GROUP BY 1) t USING (tax_id) GROUP BY n.tax_id),
up AS (SELECT l.id, l.id nid, 0 up FROM link2 l UNION ALL SELECT u.id, l.parent, u.up + 1 FROM up u JOIN link2 l ON l.id = u.nid WHERE l.parent IS NOT NULL AND u.up < 100 AND u.id IN (SELECT id FROM down WHERE tbl = 'nodes')),
lin AS (SELECT id, {", ".join(f"arg_min(o.name, up) FILTER (WHERE o.rank = '{r}' AND o.name IS NOT NULL AND (up = 0 OR NOT o.self)) AS " + chr(34) + r + chr(34) for r in RANKS)} FROM up JOIN own o USING (nid) GROUP BY 1)"""

_NORM = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'), '[^a-z0-9 ._-]', '', 'g'), '[._-]+', ' ', 'g'), '\s+', ' ', 'g')), '')"
_CHECK = f"""one AS (SELECT taxon_id, min(struct_pack(scientific_name, rank, parent_id, status, authorship)) r FROM col_taxa WHERE taxon_id IS NOT NULL GROUP BY 1),
chk AS (SELECT taxon_id, r.scientific_name AS scientific_name, lower(r.rank) rank, r.parent_id AS parent_id, r.status AS status, r.authorship AS authorship, {_NORM.format("r.scientific_name")} nn FROM one),
ask AS (SELECT ref_id, canonical_name query, {_NORM.format("canonical_name")} q FROM taxon_reference)"""
_FULL = """acc AS (SELECT f.*, a.taxon_id aid, a.scientific_name aname, a.authorship aauth, a.status astat FROM found f LEFT JOIN chk a ON contains(lower(f.status), 'synonym') AND trim(f.parent_id) <> '' AND a.taxon_id = f.parent_id),
res AS (SELECT ref_id, query, taxon_id, scientific_name, match_type, CAST(distance AS INTEGER) distance, coalesce(aid, taxon_id) accepted_id, coalesce(aname, scientific_name) accepted_name, coalesce(astat, status) status, coalesce(aauth, authorship) authorship, q FROM acc)"""

def _fuzzy(near: str, apart: str) -> str:
    return f"""WITH {_CHECK}, ex AS (SELECT ask.*, chk.*, 'exact' match_type, 0 distance FROM ask JOIN chk ON q = nn AND rank = 'species'),
      fz AS (SELECT ask.*, chk.*, 'fuzzy' match_type, {apart} distance FROM ask JOIN chk ON rank = 'species' AND left(replace(q, 'l', 'i'), 1) = left(replace(nn, 'l', 'i'), 1) AND abs(length(q) - length(nn)) <= 2
        WHERE q NOT IN (SELECT q FROM ex) AND {near}),
      found AS (SELECT * FROM ex UNION ALL SELECT * FROM fz), {_FULL}
      SELECT * EXCLUDE (q) FROM res QUALIFY row_number() OVER (PARTITION BY q, ref_id ORDER BY match_type <> 'exact', distance, coalesce(lower(status) <> 'accepted', true), taxon_id) = 1"""


_I = "replace(q, 'l', 'i'), replace(nn, 'l', 'i')"

SQL = {
    "dereplicate": f"WITH {_READS} SELECT seq, exp, sample, count(*) cnt FROM reads GROUP BY 1, 2, 3",
    "dereplicate_headers": f"WITH {_READS}, f AS (SELECT seq, arg_min(prefix, rec_no) prefix, count(*) total_count FROM reads GROUP BY 1) SELECT seq, any_value(prefix) prefix, any_value(total_count) total_count, exp, sample, count(*) cnt FROM reads JOIN f USING (seq) GROUP BY seq, exp, sample".replace("any_value(prefix) prefix", "any_value(f.prefix) prefix"),
    "count_records": "SELECT count(*) records, CAST(coalesce(sum(list_sum(list_transform(regexp_extract_all(raw_header, 'size=([0-9]+)', 1), lambda x: CAST(x AS BIGINT)))), 0) AS BIGINT) size_sum FROM node",
    "denoise_default": _denoise(_OBS, 0.05, 1, 0, True),
    "denoise_loose": _denoise(_OBS, 0.5, 3, 1, False),
    "denoise_events": _denoise(_EVENTS, 0.05, 1, 0, True),
    "sequence_ids": "SELECT seq AS \"SEQ\", 'SEQ_' || lpad(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR), 7, '0') AS \"SEQ_ID\" FROM (SELECT DISTINCT seq FROM node WHERE seq IS NOT NULL)",
    "latest_cells": f"WITH {_CELLS} SELECT experiment, id, tag, n AS cnt, status FROM cells WHERE n IS NOT NULL",
    "decontamination_maximum": _DECON % ("most", _MINUS),
    "decontamination_mean": _DECON % ("round_even(total / w, 0)", _MINUS),
    "decontamination_threshold": _DECON % ("CASE WHEN most < 10 THEN 0 ELSE 1 END", _GATE),
    "decontamination_both_threshold": _DECON % ("CASE WHEN most < 10 THEN 0 ELSE 1 END", _GATE),
    "merge_replicate_mean_rra": _merge("s / w"),
    "merge_replicate_max_rra": _merge("m"),
    "merge_replicate_both_occur": _merge("CASE WHEN seen >= 1 THEN s / w ELSE 0 END"),
    "merge_replicate_present_absent": _merge("CASE WHEN seen >= 1 THEN s / w ELSE 0 END", out="1.0::DOUBLE"),
    "find_lca": f"""WITH hits AS (SELECT l_partkey qseqid, l_orderkey || '.' || l_linenumber sseqid, l_suppkey staxids, l_orderkey, l_linenumber, CAST(100 - floor(round(l_discount * 100) / 6) AS INTEGER) pident,
        CAST(floor(round(l_tax * 100) / 5) AS INTEGER) evalue, CAST(100 - floor(l_quantity / 26) AS INTEGER) qcovs, r_name kingdom, n_name phylum, 'C' || (s_suppkey % 7) "class", CASE WHEN s_suppkey % 4 > 0 THEN 'O' || (s_suppkey % 11) END "order", 'F' || (s_suppkey % 20) family, 'G ' || (s_suppkey % 50) genus, s_name species
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      best AS (SELECT * FROM hits QUALIFY pident = max(pident) OVER (PARTITION BY qseqid) AND evalue = min(evalue) OVER (PARTITION BY qseqid) AND qcovs = max(qcovs) OVER (PARTITION BY qseqid)),
      one AS (SELECT qseqid, {", ".join(f'CASE WHEN count(DISTINCT "{r}") = 1 THEN max("{r}") END AS "{r}"' for r in RANKS)}, string_agg(staxids::VARCHAR, ';' ORDER BY l_orderkey, l_linenumber) taxid, string_agg(sseqid, ';' ORDER BY l_orderkey, l_linenumber) accession, max(qcovs) coverage, max(pident) identity FROM best GROUP BY 1),
      two AS (SELECT *, CASE {" ".join(f'WHEN "{r}" IS NOT NULL THEN ' + chr(39) + r + chr(39) for r in reversed(RANKS))} END AS "rank", coalesce({", ".join(f'"{r}"' for r in reversed(RANKS))}) nm, row_number() OVER (PARTITION BY {_Q} ORDER BY qseqid) k FROM one)
      SELECT * EXCLUDE (nm, k), CASE WHEN "rank" IS NULL OR "rank" = 'species' THEN nm ELSE nm || ' sp. ' || k END scientific_name FROM two""",
    "get_taxonomy": f"WITH RECURSIVE {_FOREST}, {_LINEAGE} SELECT q.query_tax_id, {_Q} FROM (SELECT tax_id query_tax_id FROM nodes UNION SELECT parent_tax_id FROM nodes) q LEFT JOIN lin ON lin.id = CAST(q.query_tax_id AS VARCHAR)",
    "format_to_dada": f"WITH RECURSIVE {_FOREST}, {_LINEAGE} SELECT id, replace(concat_ws(';', " + ", ".join(f"coalesce(\"{r}\", 'NA')" for r in RANKS) + "), ' ', '_') header FROM link2 LEFT JOIN lin USING (id)",
    "taxids_of_names": "WITH q AS (SELECT scientific_name query FROM col_taxa UNION SELECT name FROM tax_names) SELECT query, tax_id FROM q LEFT JOIN (SELECT DISTINCT tax_id, name FROM tax_names WHERE name IS NOT NULL) t ON t.name = q.query",
    "get_taxid": "SELECT 'A' || (l_orderkey * 2 - l_linenumber) || '.1' AS query, l_orderkey || '.' || l_linenumber AS rec, o_custkey taxid FROM lineitem LEFT JOIN (SELECT o_orderkey, min(o_custkey) o_custkey FROM orders GROUP BY 1) ON 'A' || (l_orderkey * 2 - l_linenumber) = 'A' || o_orderkey",
    "col_normalise": "SELECT DISTINCT taxon_id, scientific_name_norm norm FROM col_taxa WHERE scientific_name_norm IS NOT NULL",
    "col_match_exact": f"WITH {_CHECK}, found AS (SELECT ask.*, chk.*, 'exact' match_type, 0 distance FROM ask JOIN chk ON q = nn AND rank = 'species'), {_FULL} SELECT * EXCLUDE (q) FROM res",
    "col_match_fuzzy": _fuzzy(f"least(levenshtein(q, nn), levenshtein({_I})) <= 2", "levenshtein(q, nn)"),
    "col_match_dl": _fuzzy(f"damerau_levenshtein({_I}) <= 2", "CAST(damerau_levenshtein(q, nn) AS INTEGER)"),
    "col_match_hamming": _fuzzy(f"CASE WHEN length(q) = length(nn) THEN hamming({_I}) <= 2 ELSE false END", "CASE WHEN length(q) = length(nn) THEN hamming(q, nn) END"),
}
_COL_RANKS = RANKS
SQL["col_lineage"] = f"""WITH RECURSIVE {_FOREST}, {_CHECK},
  l AS (SELECT id, parent FROM link WHERE tbl = 'col_taxa'),
  up AS (SELECT id, id nid, 0 up FROM l UNION ALL SELECT u.id, l.parent, u.up + 1 FROM up u JOIN l ON l.id = u.nid WHERE l.parent IS NOT NULL AND u.up < 40 AND u.id IN (SELECT id FROM down WHERE tbl = 'col_taxa'))
  SELECT up.id taxon_id, {", ".join(f"arg_min(c.scientific_name, up) FILTER (WHERE c.rank = '{r}' AND c.scientific_name IS NOT NULL) AS " + chr(34) + r + chr(34) for r in RANKS)} FROM up JOIN chk c ON c.taxon_id = up.nid GROUP BY 1"""

_REFS = "refs AS (SELECT CAST(node_id AS VARCHAR) AS name, upper(min(seq)) seq FROM node WHERE node_id IS NOT NULL GROUP BY 1)"


def _sites(name: str, pattern: str, most: int, n_is_wild: bool) -> str:
    wrong = " + ".join(f"CAST(substr(seq, i + {j}, 1) NOT IN ('{c}'{', ' + chr(39) + 'N' + chr(39) if n_is_wild else ''}) AS INTEGER)" for j, c in enumerate(pattern))
    return f"{name} AS (SELECT name, CAST(i AS INTEGER) AS s, CAST(i + {len(pattern) - 1} AS INTEGER) AS e, w FROM (SELECT name, i, {wrong} w FROM (SELECT name, seq, unnest(range(1, length(seq) - {len(pattern) - 2})) i FROM refs WHERE length(seq) >= {len(pattern)})) WHERE w <= {most})"


def _product(label: str, f: str, r: str) -> str:
    return f"""SELECT '{label}' primer_pair, name, CAST(a_e + 1 AS INTEGER) AS "begin", CAST(b_s - 1 AS INTEGER) AS "end", substr(seq, a_e + 1, b_s - a_e - 1) seq FROM (
      SELECT f.name, refs.seq, CASE WHEN f.e > r.e THEN r.e ELSE f.e END a_e, CASE WHEN f.e > r.e THEN f.s ELSE r.s END b_s FROM {f} f JOIN {r} r USING (name) JOIN refs USING (name)) WHERE a_e < b_s"""


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


_RARE = f"""WITH {_CELLS}, ab AS (SELECT tag, n x, count(*) f FROM cells WHERE n > 0 GROUP BY 1, 2), tot AS (SELECT tag, CAST(sum(x * f) AS BIGINT) n, sum(f) s, coalesce(sum(f) FILTER (WHERE x = 1), 0) f1, coalesce(sum(f) FILTER (WHERE x = 2), 0) f2 FROM ab GROUP BY 1),
par AS (SELECT *, (n - 1) / n * CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END f0, CASE WHEN f2 > 0 THEN (n - 1) * f1 / ((n - 1) * f1 + 2 * f2) WHEN f1 > 1 THEN (n - 1) * (f1 - 1) / ((n - 1) * (f1 - 1) + 2) ELSE 0 END a FROM tot),
kn AS (SELECT DISTINCT tag, CAST(floor(m) AS BIGINT) m FROM (SELECT tag, CASE WHEN i = 19 THEN least(n, 150000)::DOUBLE ELSE 1 + i * ((least(n, 150000) - 1) / 19.0::DOUBLE) END m FROM par, range(20) t(i) UNION ALL SELECT tag, CASE WHEN i = 19 THEN 150000.0::DOUBLE ELSE n + i * ((150000 - n) / 19.0::DOUBLE) END FROM par, range(20) t(i) WHERE n < 150000)),
inn AS (SELECT kn.tag, m, sum(f * (1 - coalesce(list_product(list_transform(range(CAST(x AS BIGINT)), lambda j: greatest(n - m - j, 0) / (n - j))), 1))) d, 1 - sum(f * x / n * coalesce(list_product(list_transform(range(CAST(x AS BIGINT) - 1), lambda j: greatest(n - 1 - m - j, 0) / (n - 1 - j))), 1)) c
  FROM kn JOIN par USING (tag) JOIN ab USING (tag) WHERE m < n GROUP BY 1, 2)
SELECT kn.tag, kn.m, CASE WHEN kn.m < n THEN 'Rarefaction' WHEN kn.m = n THEN 'Observed' ELSE 'Extrapolation' END AS method,
  round(%s, 6) AS "qD", round(CASE WHEN kn.m < n THEN c ELSE 1 - f1 / n * a ** (kn.m - n + 1) END, 6) AS "SC"
FROM kn JOIN par USING (tag) LEFT JOIN inn ON inn.tag = kn.tag AND inn.m = kn.m %s"""

# Entropy of a drawn sample: every count x gives k reads by the hypergeometric distribution. Beyond the reads there are, the
# sum of t^r / r from n on is the unseen part of the entropy's estimate.
_RARE_ENTROPY = _RARE % (
    "CASE WHEN kn.m < n THEN exp(hd) WHEN kn.m = n OR n < 2 OR exp(goal) <= exp(hb) THEN exp(hs) ELSE exp(hs) + (exp(goal) - exp(hs)) * (1 - (1 - (exp(hs) - exp(hb)) / (exp(goal) - exp(hb))) ** (kn.m - n)) END",
    "LEFT JOIN drawn ON drawn.tag = kn.tag AND drawn.m = kn.m LEFT JOIN less ON less.tag = kn.tag LEFT JOIN ent ON ent.tag = kn.tag",
)
_RARE_ENTROPY = _RARE_ENTROPY.replace("\nSELECT kn.tag", """,
drawn AS (SELECT tag, m, -sum(f * k / m::DOUBLE * ln(k / m::DOUBLE) * exp(lgamma(x + 1) - lgamma(k + 1) - lgamma(x - k + 1) + lgamma(n - x + 1) - lgamma(m - k + 1) - lgamma(n - x - m + k + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1))) hd
  FROM (SELECT tag, m, x, f, n, unnest(range(CAST(greatest(1, m - (n - x)) AS BIGINT), CAST(least(x, m) AS BIGINT) + 1)) k FROM kn JOIN tot USING (tag) JOIN ab USING (tag) WHERE m < n) GROUP BY 1, 2),
less AS (SELECT tag, -sum(f * (x / n * CASE WHEN x > 1 THEN (x - 1) / (n - 1) * ln((x - 1) / (n - 1)) ELSE 0 END + (1 - x / n) * x / (n - 1) * ln(x / (n - 1)))) hb FROM ab JOIN tot USING (tag) WHERE n > 1 GROUP BY 1),
harm AS (SELECT i, sum(1 / i) OVER (ORDER BY i) h FROM (SELECT CAST(unnest(range(1, (SELECT max(n) FROM tot) + 1)) AS DOUBLE) i)),
seen AS (SELECT tag, -sum(f * x / n * ln(x / n)) hs, sum(f * x / n * (coalesce(hn.h, 0) - coalesce(hx.h, 0))) h1 FROM ab JOIN tot USING (tag) LEFT JOIN harm hn ON hn.i = n - 1 LEFT JOIN harm hx ON hx.i = x - 1 GROUP BY 1),
unseen AS (SELECT tag, n, f1, 1 - CASE WHEN f2 > 0 THEN 2 * f2 / ((n - 1) * f1 + 2 * f2) WHEN f1 > 1 THEN 2 / ((n - 1) * (f1 - 1) + 2) ELSE 1 END t FROM tot WHERE f1 > 0 AND n > 1),
tail AS (SELECT tag, f1 / n * sum(t ** (i + 1) / (n + i)) u FROM (SELECT *, unnest(range(0, CAST(least(60 / (1 - t), 3000000) AS BIGINT))) i FROM unseen WHERE t > 0) GROUP BY tag, f1, n),
ent AS (SELECT tag, hs, h1 + coalesce(u, 0) goal FROM seen LEFT JOIN tail USING (tag))
SELECT kn.tag""")

_PAIRS = """SELECT a.s a, b.s b, CAST(levenshtein(a.s, b.s) AS INTEGER) edits FROM q a JOIN q b ON (length(a.s) < length(b.s) OR (length(a.s) = length(b.s) AND a.s < b.s)) AND length(b.s) - length(a.s) <= floor(0.03 * length(b.s) + 1e-9)
      WHERE CASE WHEN left(a.s, 12) = left(b.s, 12) OR right(a.s, 12) = right(b.s, 12) OR contains(b.s, substr(a.s, length(a.s) // 2, 12)) OR contains(b.s, substr(a.s, length(a.s) // 4, 12)) OR contains(b.s, substr(a.s, length(a.s) * 3 // 4 - 4, 12)) OR contains(b.s, substr(a.s, 20, 12)) OR contains(b.s, substr(a.s, length(a.s) - 30, 12)) THEN levenshtein(a.s, b.s) <= floor(0.03 * length(b.s) + 1e-9) ELSE false END"""

SQL |= {
    "find_primer_binding_sites": f"WITH {_REFS}, {_sites('p', 'AACTATGGACAG', 2, False)} SELECT name, s AS start, e AS \"end\", w AS mismatches FROM p",
    "in_silico": f"WITH {_REFS}, {_sites('f1', 'AACTATGGACAG', 0, True)}, {_sites('r1', 'ACCGT', 0, True)}, {_sites('f2', 'GAGGCGCTTG', 0, True)}, {_sites('r2', 'GCTA', 0, True)} {_product('F_AACTATGGACAG__R_ACGGT', 'f1', 'r1')} UNION ALL {_product('F_GAGGCGCTTG__R_TAGC', 'f2', 'r2')}",
    "pairend": f"""WITH t AS (SELECT doc_id rec_no, {_DNA.format("text")} || {_DNA.format("reverse(text)")} t FROM documents WHERE text IS NOT NULL)
      SELECT rec_no, t AS seq, CAST(rec_no % 3 = 0 AND substr(t, 21, 1) <> 'A' AS INTEGER) mismatch, CAST(24 AS INTEGER) overlap FROM t""",
    "demultiplex": f"""WITH r AS (SELECT doc_id, 'F' || lpad(CAST(doc_id % 300 AS VARCHAR), 3, '0') tag, {_DNA.format("text")} ins FROM documents WHERE text IS NOT NULL)
      SELECT doc_id rec_no, c.tag IS NOT NULL identified, c.tag AS sample, CASE WHEN c.tag IS NOT NULL THEN ins END AS "insert", CASE WHEN c.tag IS NOT NULL THEN CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) END fwd_mismatch, CASE WHEN c.tag IS NOT NULL THEN CAST(0 AS INTEGER) END rev_mismatch
      FROM r LEFT JOIN (SELECT min(tag) tag, substr({_DNA.format('tag')}, 1, 8) code FROM control_table WHERE tag IS NOT NULL GROUP BY 2) c ON c.code = substr({_DNA.format('r.tag')}, 1, 8)""",
    "rarefaction_q0": _RARE % ("CASE WHEN kn.m < n THEN d WHEN f0 > 0 THEN s + f0 * (1 - (1 - f1 / (n * f0 + f1)) ** (kn.m - n)) ELSE s END", ""),
    "rarefaction_q1": _RARE_ENTROPY,
    "rarefaction_q2": _RARE % ("1 / (1 / kn.m + (kn.m - 1) / kn.m * CASE WHEN n > 1 THEN p2 / (n * (n - 1)) ELSE 0 END)", "JOIN (SELECT tag, sum(f * x * (x - 1)) p2 FROM ab GROUP BY 1) pp ON pp.tag = kn.tag"),
    "similar_pairs": f"WITH {_OBS}, q AS (SELECT DISTINCT seq s FROM obs) {_PAIRS}",
    "cluster_table": f"""WITH RECURSIVE {_OBS}, q AS MATERIALIZED (SELECT DISTINCT seq s FROM obs), pairs AS MATERIALIZED ({_PAIRS}),
      z AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY length(s) DESC, s) no FROM q),
      e AS MATERIALIZED (SELECT greatest(x.no, y.no) no, list({{'d': edits, 'o': least(x.no, y.no)}}) near FROM pairs JOIN z x ON x.s = a JOIN z y ON y.s = b GROUP BY 1),
      g AS (SELECT CAST(0 AS BIGINT) no, CAST([] AS BOOLEAN[]) f UNION ALL SELECT z.no, list_append(f, len(list_filter(coalesce(near, []), lambda x: f[x.o])) = 0) FROM g JOIN z ON z.no = g.no + 1 LEFT JOIN e ON e.no = z.no),
      f AS (SELECT f FROM g ORDER BY no DESC LIMIT 1),
      c AS (SELECT z.s, CASE WHEN f[z.no] THEN z.no ELSE list_min(list_filter(near, lambda x: f[x.o])).o END k FROM f, z LEFT JOIN e ON e.no = z.no)
      SELECT exp experiment, m.s AS "SEQ", sample, CAST(sum(cnt) AS BIGINT) count FROM obs JOIN c ON c.s = obs.seq JOIN z m ON m.no = c.k GROUP BY 1, 2, 3""",
    "chimeras_ref": """WITH z AS (SELECT upper(seq) seq, max(coalesce(total_count, 0)) size, length(seq) len FROM node WHERE seq IS NOT NULL GROUP BY upper(seq), length(seq)), p AS (SELECT DISTINCT upper(seq) seq, length(seq) len FROM unique_info WHERE seq IS NOT NULL),
      lt AS (SELECT p, max(seq) par FROM (SELECT seq, left(seq, n) p FROM (SELECT seq, unnest(range(24, len + 1)) n FROM p WHERE len >= 24)) GROUP BY 1), rt AS (SELECT p, max(seq) par FROM (SELECT seq, right(seq, n) p FROM (SELECT seq, unnest(range(24, len + 1)) n FROM p WHERE len >= 24)) GROUP BY 1),
      lb AS (SELECT seq, max(n) n, arg_max(par, n) par FROM (SELECT seq, n, left(seq, n) p FROM (SELECT seq, unnest(range(24, len + 1)) n FROM z)) JOIN lt USING (p) GROUP BY 1), rb AS (SELECT seq, max(n) n, arg_max(par, n) par FROM (SELECT seq, n, right(seq, n) p FROM (SELECT seq, unnest(range(24, len + 1)) n FROM z)) JOIN rt USING (p) GROUP BY 1)
      SELECT z.seq, z.size, coalesce(lb.n < len AND rb.n < len AND lb.n + rb.n >= len AND lb.par <> rb.par, false) chimeric FROM z LEFT JOIN lb USING (seq) LEFT JOIN rb USING (seq)""",
    "chimeras": f"""WITH {_OBS}, z AS (SELECT seq, CAST(sum(cnt) AS BIGINT) size, length(seq) len FROM obs GROUP BY 1),
      l AS (SELECT seq, size, n, left(seq, n) p FROM (SELECT seq, size, unnest(range(24, len)) n FROM z WHERE len > 24)), r AS (SELECT seq, size, n, right(seq, n) p FROM (SELECT seq, size, unnest(range(24, len)) n FROM z WHERE len > 24)),
      lt AS (SELECT p, max({{'size': size, 'seq': seq}}) t FROM l GROUP BY 1), rt AS (SELECT p, max({{'size': size, 'seq': seq}}) t FROM r GROUP BY 1),
      lb AS (SELECT seq, max(n) n, arg_max(t.seq, n) par FROM l JOIN lt USING (p) WHERE t.size >= 2 * size GROUP BY 1), rb AS (SELECT seq, max(n) n, arg_max(t.seq, n) par FROM r JOIN rt USING (p) WHERE t.size >= 2 * size GROUP BY 1)
      SELECT z.seq, z.size, coalesce(lb.n + rb.n >= len AND lb.par <> rb.par, false) chimeric FROM z LEFT JOIN lb USING (seq) LEFT JOIN rb USING (seq)""",
    "streaming_dereplicate": SQL["dereplicate"],
}


def _both(name: str, strands: str, pattern: str, most: int, hits: int) -> str:
    """The first ``hits`` sites of a pattern in which codes stand for any of their bases, also hanging over an end."""
    bases = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "N": "ACGT"}
    fits = lambda j, c: f"CASE WHEN i + {j} BETWEEN 1 AND length(seq) AND substr(seq, CAST(greatest(i + {j}, 1) AS BIGINT), 1) IN ({', '.join(chr(39) + x + chr(39) for x in 'ACGTN' if x == 'N' or x in bases[c])}) THEN 0 ELSE 1 END"
    wrong = " + ".join(fits(j, c) for j, c in enumerate(pattern))
    return f"""{name} AS (SELECT name, i AS s, i + {len(pattern) - 1} AS e FROM (SELECT name, seq, i, {wrong} w FROM (SELECT name, seq, unnest(range({1 - most}, length(seq) - {len(pattern) - 2 - most})) i FROM {strands}))
      WHERE w <= {most} QUALIFY row_number() OVER (PARTITION BY name ORDER BY i) <= {hits})"""


_COMPLEMENT = "translate({}, 'ACGTRYKMBDHV', 'TGCAYRMKVHDB')"
_MERGED = _merge("s / w", out="1.0::DOUBLE")

SQL |= {
    "fasta_to_table": f"""WITH {_NESTED}, recs AS (SELECT CAST(node_id AS VARCHAR) rec, min(struct_pack(id := regexp_replace(regexp_replace(raw_header, '^>', ''), ';size.*$', '', 's'), seq := seq)) r FROM node WHERE node_id IS NOT NULL GROUP BY node_id),
      long AS (SELECT exp AS experiment, r.id AS "ID", r.seq AS "SEQ", sample, n AS count, status FROM counts6 JOIN recs USING (rec) WHERE r.seq IS NOT NULL)
      SELECT *, CAST(sum(count) OVER (PARTITION BY "SEQ", experiment) AS BIGINT) total_count, 'SEQ_' || lpad(CAST(dense_rank() OVER (ORDER BY "SEQ") AS VARCHAR), 7, '0') AS "SEQ_ID" FROM long""",
    "merge_wide": f"""SELECT * EXCLUDE (mark) FROM (PIVOT (SELECT 1 mark, experiment, id, grp || '_' || sample AS name, value FROM ({_MERGED})
      UNION ALL SELECT 0, NULL, NULL, g.grp || '_' || s.sample, 0 FROM (SELECT DISTINCT grp FROM control_table WHERE category = 'sample' AND grp IS NOT NULL AND sample IS NOT NULL) g, (SELECT DISTINCT sample FROM control_table WHERE category = 'sample' AND grp IS NOT NULL AND sample IS NOT NULL) s)
      ON name USING coalesce(sum(value), 0.0) GROUP BY mark, experiment, id) WHERE mark = 1""",
    "search": """WITH q AS (SELECT uniq_id AS qseqid, min(seq) q FROM unique_info WHERE uniq_id IS NOT NULL GROUP BY 1), s AS (SELECT CAST(node_id AS VARCHAR) AS sseqid, min(seq) s FROM node WHERE node_id IS NOT NULL GROUP BY 1),
      met AS (SELECT DISTINCT qseqid, sseqid FROM (SELECT DISTINCT qseqid, substr(q, i, 28) k FROM (SELECT *, unnest(range(1, length(q) - 26)) i FROM q WHERE length(q) >= 28)) JOIN (SELECT DISTINCT sseqid, substr(s, i, 28) k FROM (SELECT *, unnest(range(1, length(s) - 26)) i FROM s WHERE length(s) >= 28)) USING (k)),
      hit AS (SELECT qseqid, sseqid, round(100 * (1 - levenshtein(q, s) / greatest(length(q), length(s))), 3) pident, round(100 * least(length(q), length(s)) / length(q), 3) qcovs FROM met JOIN q USING (qseqid) JOIN s USING (sseqid))
      SELECT * FROM hit WHERE pident >= 90 AND qcovs >= 90 QUALIFY row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, qcovs DESC, sseqid) <= 10""",
    "in_silico_strict": f"""WITH {_REFS}, strands AS (SELECT name, seq FROM refs WHERE seq IS NOT NULL AND length(seq) < 10000 UNION ALL SELECT '[REVERSE]' || name, reverse({_COMPLEMENT.format('seq')}) FROM refs WHERE seq IS NOT NULL AND length(seq) < 10000),
      {_both('f', 'strands', 'AACTATGGACRG', 2, 5)}, {_both('r', 'strands', 'GTNACCGT', 2, 5)},
      pair AS (SELECT name, seq, CASE WHEN f.e > r.e THEN r.s ELSE f.s END a_s, CASE WHEN f.e > r.e THEN r.e ELSE f.e END a_e, CASE WHEN f.e > r.e THEN f.s ELSE r.s END b_s, CASE WHEN f.e > r.e THEN f.e ELSE r.e END b_e FROM f JOIN r USING (name) JOIN strands USING (name)),
      fit AS (SELECT *, a_e - 6 BETWEEN 1 AND length(seq) AND substr(seq, CAST(greatest(a_e - 6, 1) AS BIGINT), 1) IN ('T', 'N') AND b_s + 1 BETWEEN 1 AND length(seq) AND substr(seq, CAST(greatest(b_s + 1, 1) AS BIGINT), 1) IN ('T', 'N') ok FROM pair WHERE a_e < b_s)
      SELECT 'F_AACTAT#GGACRG__R_ACGGTNA#C' primer_pair, name, CAST(greatest(a_s, 1) AS INTEGER) AS "begin", CAST(least(b_e, length(seq)) AS INTEGER) AS "end", substr(seq, CAST(greatest(a_s, 1) AS BIGINT), CAST(least(b_e, length(seq)) - greatest(a_s, 1) + 1 AS BIGINT)) seq
      FROM fit QUALIFY bool_and(ok) OVER (PARTITION BY name)""",
}
