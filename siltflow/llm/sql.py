"""SQL over the same tables, for the queries of this package that SQL can express."""

from __future__ import annotations

import sys
import unicodedata


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Letters of other scripts, each before the Latin letter it stands for.
_OTHER_SCRIPTS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa νv οo ρp ιi υu κk χx ϲc ϳj"
)
_SHAPELESS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def _clean(col: str) -> str:
    """The consistent form, by normalising every character alone; made apart from the operator's tables."""
    single, longer, gone = dict(p for p in _OTHER_SCRIPTS.split() if p), [], _SHAPELESS
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind, plain = unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if kind[0] == "Z" or c == "\x85":
            single[c] = " "
        elif kind in ("Cf", "Cc") or "VARIATION SELECTOR" in unicodedata.name(c, ""):
            gone += c
        elif kind[0] in "LN" and plain.isascii() and plain.isalnum():
            if len(plain) == 1:
                single[c] = plain
            else:
                longer.append((c, plain))
    out = f"translate({col}, {_q(''.join([*single, *gone]))}, {_q(''.join(single.values()))})"
    for c, plain in longer:
        out = f"replace({out}, {_q(c)}, {_q(plain)})"
    return f"nfc_normalize({out})"


# Words that qualify a name and are not part of it.
_QUALIFIERS = "adult aff cf forma indet isolate juv larva nr sample sp specimen spp ssp strain subsp var voucher".split()

_LONG = """
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 150),
w AS (SELECT doc_id, i, substr(text, i, 150) s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) i FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT w.doc_id, w.i, lead(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) nxt FROM w SEMI JOIN r ON r.s = w.s)
"""

# levenshtein() counts bytes: accented letters are given one-byte stand-ins.
_BYTES = "translate({}, 'ëïöüéæœáíóúàèñçøåäß', '0123456789ABCDEFGHI')"

_MIX = """
r AS (SELECT doc_id, min(source) source, CAST(min(coalesce(n_chars, 0)) AS BIGINT) n, CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) h FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT m.source, any_value(target_share) target_share, any_value(max_repeats) max_repeats, count(doc_id) n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) tokens FROM mix_targets m LEFT JOIN r ON r.source = m.source GROUP BY 1),
s AS (SELECT *, CASE WHEN tokens > 0 AND max_repeats > 0 THEN target_share ELSE 0 END / (SELECT sum(target_share) FROM t WHERE tokens > 0 AND max_repeats > 0) share FROM t),
b AS (SELECT *, least(CAST(floor(share * (SELECT min(tokens * max_repeats / share) FROM s WHERE share > 0) + 1e-6) AS BIGINT), tokens * max_repeats) budget FROM s),
picked AS (SELECT doc_id, source, n AS n_tokens, CAST(budget // tokens + CASE WHEN cum <= budget % tokens THEN 1 ELSE 0 END AS BIGINT) copies FROM (
  SELECT r.*, budget, tokens, sum(n) OVER (PARTITION BY r.source ORDER BY h) cum FROM r JOIN b USING (source) WHERE budget > 0)),
used AS (SELECT source, CAST(sum(n_tokens * copies) AS BIGINT) used_tokens, max(copies) most_copies FROM picked WHERE copies > 0 GROUP BY 1)
"""

SQL = {
    "p9_mix_by_chars": f"WITH {_MIX} SELECT * FROM picked WHERE copies > 0",
    "p9_shares_by_chars": f"""WITH {_MIX} SELECT b.source, target_share, max_repeats, n_docs, tokens, budget, coalesce(used_tokens, 0) used_tokens, coalesce(most_copies, 0) most_copies,
      round(coalesce(used_tokens, 0) / (SELECT sum(used_tokens) FROM used), 9) actual_share FROM b LEFT JOIN used USING (source)""",
    "p3_found": """
      WITH n AS (SELECT node_id id, upper(min(seq)) seq, any_value(exp_sample_count) m FROM node WHERE node_id IS NOT NULL GROUP BY 1),
      g AS (SELECT DISTINCT id, substr(seq, i, 8) g FROM (SELECT id, seq, unnest(range(1, length(seq) - 6)) i FROM n WHERE length(seq) >= 8)),
      c AS (SELECT id, count(*) c FROM g GROUP BY 1),
      met AS (SELECT a.id a, b.id b, count(*) k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
      sim AS (SELECT a, b FROM met JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 10 * k >= 6 * (x.c + y.c - k)),
      e AS (SELECT id, e.key x, unnest(map_keys(e.value)) s FROM (SELECT id, unnest(map_entries(m)) e FROM n))
      SELECT DISTINCT a AS node_a, b AS node_b FROM sim JOIN e p ON p.id = a JOIN e q ON q.id = b AND q.x = p.x AND q.s = p.s""",
    "p4_found": f"""
      WITH t AS (SELECT taxon_id, lower({_clean("min(scientific_name)")}) n FROM col_taxa WHERE rank = 'species' AND trim(scientific_name) <> '' AND taxon_id IS NOT NULL GROUP BY 1),
      w AS (SELECT taxon_id, list_filter(regexp_extract_all(n, '\\p{{L}}+'), lambda x: NOT list_contains([{", ".join(map(_q, _QUALIFIERS))}], x)) w FROM t),
      k AS (SELECT taxon_id, w[i] a, w[j] b FROM (SELECT taxon_id, w, i, unnest([i + 1, i + 2]) j FROM (SELECT taxon_id, w, unnest(range(1, len(w))) i FROM w)) WHERE j <= len(w) AND length(w[j]) > 1),
      keys AS (SELECT DISTINCT taxon_id, CASE WHEN length(a) = 1 THEN a ELSE '' END ini, CASE WHEN length(a) = 1 THEN b ELSE a || ' ' || b END key, length(a) + length(b) size FROM k
        UNION SELECT taxon_id, '', x, length(x) FROM (SELECT taxon_id, unnest(w) x FROM w) WHERE length(x) > 9),
      r AS (SELECT ref_id, lower(genus) g, lower(epithet) e FROM taxon_reference),
      alias AS (SELECT ref_id, '' ini, g || ' ' || e p FROM r UNION SELECT ref_id, '', e || ' ' || g FROM r UNION SELECT ref_id, '', g || e FROM r UNION SELECT ref_id, left(g, 1), e FROM r),
      d AS (SELECT taxon_id, ref_id, min(levenshtein({_BYTES.format("key")}, {_BYTES.format("p")})) d FROM keys JOIN alias ON alias.ini = keys.ini AND abs(length(key) - length(p)) <= 3
        WHERE levenshtein({_BYTES.format("key")}, {_BYTES.format("p")}) <= CASE WHEN size < 4 THEN 0 WHEN size < 7 THEN 1 WHEN size < 10 THEN 2 ELSE 3 END GROUP BY 1, 2),
      best AS (SELECT taxon_id, CASE WHEN count(*) = 1 THEN max(ref_id) ELSE -1 END ref_id FROM (SELECT * FROM d QUALIFY d = min(d) OVER (PARTITION BY taxon_id)) GROUP BY 1)
      SELECT t.taxon_id, coalesce(best.ref_id, -1) AS ref_id FROM t LEFT JOIN best USING (taxon_id)""",
    "p2_found": f"""
      WITH long AS (SELECT taxon_id, 'scientific_name' col_name, scientific_name v FROM col_taxa UNION SELECT taxon_id, 'scientific_name_fuzzy', scientific_name_fuzzy FROM col_taxa)
      SELECT * FROM (SELECT DISTINCT taxon_id, col_name, {_clean("v")} clean_text, v FROM long WHERE v IS NOT NULL AND taxon_id IS NOT NULL)
      WHERE v <> clean_text""".replace("SELECT * FROM", "SELECT taxon_id, col_name, clean_text FROM", 1),
    "p8_found": r"""
      WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark),
      runs AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i + 9], ' ') || ' ' r FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) i FROM iw WHERE len(w) >= 10)),
      dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
      druns AS (SELECT DISTINCT doc_id, ' ' || array_to_string(w[i:i + 9], ' ') || ' ' r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) i FROM dw WHERE len(w) >= 10))
      SELECT DISTINCT doc_id, item_id FROM druns JOIN runs USING (r)""",
    "p10_found": f"WITH {_LONG} SELECT doc_id, CAST(sum(least(150, coalesce(nxt - i, 150))) AS BIGINT) shared_chars FROM h GROUP BY doc_id",
}
