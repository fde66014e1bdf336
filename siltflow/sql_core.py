"""SQL over the same tables, for the core queries."""

from __future__ import annotations

_FOREST = """
raw AS (
  SELECT 'nodes' tbl, CAST(tax_id AS VARCHAR) id, CAST(parent_tax_id AS VARCHAR) parent FROM nodes WHERE tax_id IS NOT NULL
  UNION SELECT 'col_taxa', taxon_id, parent_id FROM col_taxa WHERE taxon_id IS NOT NULL),
link AS (
  SELECT r.tbl, r.id, min(k.id) parent FROM raw r
  LEFT JOIN (SELECT DISTINCT tbl, id FROM raw) k ON k.tbl = r.tbl AND k.id = r.parent AND trim(r.parent) <> '' AND r.parent <> r.id
  GROUP BY 1, 2),
down AS (
  SELECT tbl, id, id root, CAST(0 AS BIGINT) depth, id AS path FROM link WHERE parent IS NULL
  UNION ALL SELECT l.tbl, l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM link l JOIN down d ON l.tbl = d.tbl AND l.parent = d.id)
"""

_ALL = """SELECT l.tbl, l.id AS node_key, coalesce(d.root, '') AS root_key, coalesce(d.depth, -1) AS depth, coalesce(d.path, '') AS path
FROM link l LEFT JOIN down d ON d.tbl = l.tbl AND d.id = l.id"""

_CELLS = r"""
c0 AS (SELECT experiment, id, row_no, loaded_at, status, count AS c, upper(regexp_replace(trim(sample, E' \t\n\r'), '^count_ *', '', 'i')) tag FROM fasta_to_table),
c1 AS (SELECT *, row_number() OVER (PARTITION BY experiment, id, tag ORDER BY loaded_at DESC NULLS LAST, row_no DESC NULLS LAST) k FROM c0 WHERE tag <> ''),
c2 AS (SELECT experiment, id, tag, nullif(lower(trim(status, E' \t\n\r')), '') status, trim(c, E' \t\n\r') t FROM c1 WHERE k = 1),
cells AS (SELECT experiment, id, tag, status,
  CASE WHEN regexp_full_match(t, '\+?(\d+|\d{1,3}(,\d{3})+)(\.0*)?') THEN try_cast(regexp_replace(regexp_replace(t, '[+,]', '', 'g'), '\.0*$', '') AS BIGINT)
       WHEN regexp_full_match(t, '\+?\d+(\.\d*)?[eE][+-]?\d{1,2}') AND try_cast(t AS DOUBLE) = floor(try_cast(t AS DOUBLE)) THEN try_cast(try_cast(t AS DOUBLE) AS BIGINT) END AS n
  FROM c2),
per_entity AS (SELECT e.experiment, e.id, CAST(count(n) AS BIGINT) n_samples, CAST(coalesce(sum(n), 0) AS BIGINT) total_count, CAST(count(*) FILTER (WHERE n IS NOT NULL AND status = 'head') AS BIGINT) n_head
  FROM (SELECT DISTINCT experiment, id FROM fasta_to_table) e LEFT JOIN cells c ON c.experiment IS NOT DISTINCT FROM e.experiment AND c.id IS NOT DISTINCT FROM e.id GROUP BY 1, 2)
"""


def _entries(tbl: str, key: str, col: str) -> str:
    return f"""SELECT '{tbl}' tbl, i, e.key exp, unnest(map_entries(e.value)) s FROM (
  SELECT i, unnest(map_entries(m)) e FROM (SELECT {key} i, any_value({col}) m FROM {tbl} WHERE {key} IS NOT NULL GROUP BY 1))"""


_TOTALS = f"""
ent AS ({_entries("node", "node_id", "exp_sample_count")} UNION ALL {_entries("unique_info", "uniq_id", "exp_samples")}),
tot AS (SELECT tbl, exp, s.key AS sample, count(*) n_entries, CAST(sum(s.value) AS BIGINT) total_count, max(s.value) max_count FROM ent GROUP BY 1, 2, 3)
"""

# A text that is cut off has no beginning that is valid JSON; of one that goes on after its end exactly one is.
_NESTED = r"""
texts AS (
  SELECT 'node' tbl, CAST(node_id AS VARCHAR) rec, min(raw_header) raw FROM node WHERE node_id IS NOT NULL GROUP BY node_id
  UNION ALL SELECT 'unique_info', CAST(uniq_id AS VARCHAR), min(pairend_json) FROM unique_info WHERE uniq_id IS NOT NULL GROUP BY uniq_id),
body AS (SELECT tbl, rec, trim(CASE WHEN tbl = 'node' THEN substr(raw, strpos(raw, '{')) WHEN json_valid(raw) AND json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE raw END, E' \n\t\r') t FROM texts WHERE contains(raw, '{')),
ends AS (SELECT tbl, rec, t, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) IN ('}', ']'))) p FROM body),
whole AS (SELECT tbl, rec, arg_max(js, length(js)) v FROM (SELECT tbl, rec, CASE WHEN t[1] = '{' THEN substr(t, 1, p) ELSE '{' || substr(t, 1, p) || '}' END js FROM ends) WHERE json_valid(js) GROUP BY 1, 2),
blocks AS (SELECT rec, json_exists(v, '$.denoise') d, json_extract(v, CASE WHEN json_exists(v, '$.denoise') THEN '$.denoise.by_sample' ELSE '$.stat.exp' END) e FROM whole WHERE tbl = 'node'),
exps AS (
  SELECT rec, d, k AS exp, CASE WHEN d THEN json_extract(e, '$."' || k || '"') ELSE json_extract(e, '$."' || k || '".samples') END s FROM (SELECT rec, d, e, unnest(json_keys(e)) k FROM blocks WHERE json_type(e) = 'OBJECT')
  UNION ALL SELECT rec, d, coalesce(json_extract_string(x, '$.exp'), json_extract_string(x, '$.name')), json_extract(x, '$.samples') FROM (SELECT rec, d, unnest(CAST(e AS JSON[])) x FROM blocks WHERE json_type(e) = 'ARRAY')),
cells6 AS (
  SELECT rec, exp, k AS sample, json_extract(s, '$."' || k || '"') y FROM (SELECT rec, exp, s, unnest(json_keys(s)) k FROM exps WHERE json_type(s) = 'OBJECT')
  UNION ALL SELECT rec, exp, json_extract_string(y, '$.sample'), y FROM (SELECT rec, exp, unnest(CAST(s AS JSON[])) y FROM exps WHERE json_type(s) = 'ARRAY')),
counts6 AS (SELECT rec, exp, sample, CAST(try_cast(CASE WHEN json_type(y) = 'OBJECT' THEN coalesce(json_extract_string(y, '$.count'), json_extract_string(y, '$.n')) ELSE json_extract_string(y, '$') END AS DECIMAL(38, 6)) AS BIGINT) n,
  CASE WHEN json_type(y) = 'OBJECT' THEN json_extract_string(y, '$.status') END status FROM cells6),
pe AS (SELECT rec, json_extract(v, '$.pairend') e FROM whole WHERE tbl = 'unique_info'),
lanes AS (
  SELECT rec, json_extract_string(x, '$.lane') lane, json_extract(x, '$.pairs') o FROM (SELECT rec, unnest(CAST(json_extract(e, '$.lanes') AS JSON[])) x FROM pe WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.lanes'))
  UNION ALL SELECT rec, '', CASE WHEN json_type(e) = 'ARRAY' THEN e ELSE json_array(e) END FROM pe WHERE json_type(e) = 'ARRAY' OR NOT json_exists(e, '$.lanes')),
pairs6 AS (SELECT rec, lane, unnest(range(1, len(CAST(o AS JSON[])) + 1)) pos, unnest(CAST(o AS JSON[])) x FROM lanes)
"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_FOREST} SELECT tbl, node_key, root_key, depth FROM ({_ALL})",
    "p1_paths": f"WITH RECURSIVE {_FOREST} SELECT tbl, node_key, depth, path FROM ({_ALL})",
    "p1_descendants": f"""WITH RECURSIVE {_FOREST},
      pairs AS (SELECT l.tbl, l.parent anc, l.id, CAST(1 AS BIGINT) steps FROM link l JOIN down USING (tbl, id) WHERE l.parent IS NOT NULL
        UNION ALL SELECT p.tbl, l.parent, p.id, p.steps + 1 FROM pairs p JOIN link l ON l.tbl = p.tbl AND l.id = p.anc WHERE l.parent IS NOT NULL)
      SELECT tbl, anc AS node_key, id AS descendant_key, steps FROM pairs""",
    "p5_found": f"WITH {_CELLS} SELECT * FROM per_entity",
    "p5_wide": f"""SELECT experiment, id, n_samples, total_count, n_head, COLUMNS('^(.*)_c$') AS 'count_\\1', COLUMNS('^(.*)_s$') AS 'status_\\1' FROM (
      PIVOT (WITH {_CELLS} SELECT p.*, tag, n, status FROM per_entity p LEFT JOIN cells c ON c.experiment IS NOT DISTINCT FROM p.experiment AND c.id IS NOT DISTINCT FROM p.id)
      ON tag USING max(n) AS c, max(status) AS s GROUP BY experiment, id, n_samples, total_count, n_head)""",
    "p6_found": f"""WITH {_NESTED} SELECT 'node' tbl, CAST(rec AS BIGINT) rec_id, exp parent_key, sample child_key, n AS val FROM counts6
      UNION SELECT 'unique_info', CAST(rec AS BIGINT), lane, CAST(pos AS VARCHAR), CAST(try_cast(json_extract_string(x, '$.overlap') AS DECIMAL(38, 6)) AS BIGINT) FROM pairs6 WHERE json_extract_string(x, '$.overlap') IS NOT NULL""",
    "p6_report": f"""WITH {_NESTED}, r AS (SELECT texts.tbl, raw IS NULL OR trim(raw) = '' blank, v IS NOT NULL AS good FROM texts LEFT JOIN whole USING (tbl, rec))
      SELECT tbl, count(*) records, count(*) FILTER (WHERE blank) blank, count(*) FILTER (WHERE NOT blank AND NOT good) broken, count(*) FILTER (WHERE good) AS "read" FROM r GROUP BY 1""",
    "p7_totals": f"WITH {_TOTALS} SELECT tbl, exp, sample, n_entries, total_count, max_count FROM tot",
    "p7_found": f"WITH {_TOTALS} SELECT tbl, exp, sample FROM tot QUALIFY n_entries * 100 > 3 * sum(n_entries) OVER (PARTITION BY tbl)",
}
