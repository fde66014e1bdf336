"""SQL for the queries that go through files: what was written must be read."""

from __future__ import annotations

from siltflow.sql_ref import _DNA, SQL as _REF

_SEQ = "SELECT 'n' || node_id id, min(seq) seq FROM node WHERE node_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1 HAVING min(seq) <> ''"
_NUMBER = "rtrim(rtrim(printf('%.6f', {}), '0'), '.')"
_RAW = "lower(regexp_replace(regexp_replace(raw, '^col:', '', 'i'), '[^A-Za-z0-9_]', '', 'g'))"
_TEXT = r"nullif(regexp_replace({}, '[\t\r\n]', ' ', 'g'), '')"

SQL = {
    "fastq_records": f"SELECT '@doc ' || doc_id id, {_DNA.format('text')} seq, '+' plus, repeat('I', 32) qual FROM documents WHERE text IS NOT NULL",
    "fastq_merged_records": f"""SELECT '@doc_' || doc_id || ';{{"pairend":{{"mismatch":' || (doc_id % 5) || ',"overlap":' || (doc_id % 20 + 10) || ',"ovl_score":' || {_NUMBER.format('(doc_id % 40) / 4.0 + 1')} || '}}}}' id, {_DNA.format('text')} seq, '+' plus, repeat('I', 32) qual FROM documents WHERE text IS NOT NULL""",
    "fasta_records": _SEQ,
    "fasta_index": f"SELECT id, CAST(length(seq) AS INTEGER) seqlength FROM ({_SEQ})",
    "sniffed_files": "SELECT * FROM (VALUES ('fastq', true), ('fasta', false)) t(kind, packed)",
    "primer_table_file": f"SELECT 'trnL' exp, tag AS sample, substr({_DNA.format('tag')}, 1, 8) || ':' || substr({_DNA.format('reverse(tag)')}, 1, 8) tags, 'GGGCAATCCTGAGCCAA' forward_primer, 'CCATTGAGTCTCTGCACCTATC' reverse_primer FROM control_table WHERE tag IS NOT NULL",
    "control_file": "SELECT * FROM control_table",
    "nodes_dump": "SELECT DISTINCT tax_id, parent_tax_id, rank, embl_code, " + ", ".join(f"CAST({c} AS VARCHAR) {c}" for c in "division_id inherited_div_flag genetic_code_id inherited_gc_flag mito_genetic_code_id inherited_mgc_flag genbank_hidden_flag subtree_root_flag".split()) + ", comments FROM nodes",
    "names_dump": "SELECT DISTINCT tax_id, name FROM tax_names",
    "accession_files": "SELECT 'A' || o_orderkey accession, 'A' || o_orderkey || '.1' AS version, o_custkey taxid FROM orders",
    "checklist_file": f"SELECT DISTINCT taxon_id, nullif(parent_id, '') parent_id, {_TEXT.format('scientific_name')} scientific_name, rank, status, {_TEXT.format('authorship')} authorship FROM col_taxa",
    "checklist_columns": f"SELECT DISTINCT raw, {_RAW} clean FROM (SELECT 'COL:' || p_type || '-' || p_size raw FROM part)",
    "blast_file": """SELECT CAST(l_partkey AS VARCHAR) qseqid, l_orderkey || '.' || l_linenumber sseqid, CAST(trunc(100 - l_discount * 100) AS DOUBLE) pident, CAST(l_quantity AS INTEGER) length, CAST(l_linenumber - 1 AS INTEGER) mismatch, 0 gapopen, 1 qstart, CAST(l_quantity AS INTEGER) qend,
      5 sstart, CAST(l_quantity + 4 AS INTEGER) send, 1e-30 evalue, l_quantity * 2 bitscore, CAST(100 AS DOUBLE) qcovs, l_suppkey || ';' || l_linenumber staxids FROM lineitem""",
    "clusters_file": "SELECT DISTINCT 'H' AS type, CAST(node_id % 100 AS INTEGER) AS cluster, CAST(120 AS INTEGER) c_length, '98.5' similarity, '+' orientation, 'n' || node_id \"query_ID\", 'n' || (node_id % 100) \"centroid_ID\" FROM node WHERE node_id IS NOT NULL",
    "archive_listing": "SELECT 'nt.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.tar.gz' file_name, '2024-01-02 03:04' AS date, round((p_size + 0.5::DOUBLE) / CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 1024 END, 6) size_gb FROM part WHERE p_partkey % 3 <> 0",
    "archive_sizes": "SELECT replace(p_brand, '#', '_') AS database, count(*) archives, CAST(sum(p_size) AS DOUBLE) size_gb FROM part GROUP BY 1",
    "iupac_matches": "SELECT DISTINCT node_id, regexp_matches(upper(seq), 'AC[CTY]G[AGR][ACGTN]T[ATW]') AS found FROM node WHERE node_id IS NOT NULL AND seq IS NOT NULL",
    "taxonomy_database": """SELECT n.tax_id, parent_tax_id, rank, name, accessions, first_accession FROM (SELECT DISTINCT tax_id, parent_tax_id, rank FROM nodes) n LEFT JOIN (SELECT DISTINCT * FROM tax_names) USING (tax_id)
      LEFT JOIN (SELECT o_custkey % 1500 tax_id, count(*) accessions, min('A' || o_orderkey) first_accession FROM orders GROUP BY 1) USING (tax_id)""",
    "denoise_headers": _REF["denoise_default"],
}
