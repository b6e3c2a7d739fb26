"""DuckDB text of the chunk documents (R01-R05, X16, W06) for the oracle."""

from __future__ import annotations

from .oracle import _cte

_cte("lin_lines", ("lin_cl",), """
SELECT dataset_key AS key, string_agg(line, chr(10) ORDER BY f_time, f_seq, f_fpos) AS lines
FROM (SELECT dataset_key, out_field, f_time, f_seq, f_fpos,
        '  ' || out_field || ' ← ' || string_agg(src_table || '.' || src_field || ' [' || type
          || '/' || subtype || ']', ', ' ORDER BY s_time, s_seq, s_fpos) AS line
      FROM lin_cl GROUP BY dataset_key, out_field, f_time, f_seq, f_fpos)
GROUP BY dataset_key""")

_cte("lin_pc", ("lin_datasets", "lin_edges", "lin_jobs"), """
SELECT d.key,
  (SELECT string_agg(j.name, ', ' ORDER BY j.name) FROM lin_edges e JOIN lin_jobs j
     ON j.key = e.src WHERE e.dst = d.key AND e.relation = 'produces') AS producers,
  (SELECT string_agg(j.name, ', ' ORDER BY j.name) FROM lin_edges e JOIN lin_jobs j
     ON j.key = e.dst WHERE e.src = d.key AND e.relation = 'feeds') AS consumers
FROM lin_datasets d""")

_cte("chunk_datasets", ("lin_datasets", "lin_pc", "lin_lines"), """
SELECT d.key AS id, 'dataset' AS kind, d.name, d.namespace, NULL::VARCHAR AS source,
  concat_ws(chr(10), 'Dataset: ' || d.name, 'Namespace: ' || d.namespace,
    'Format: ' || d.format,
    CASE WHEN d.schema <> '' THEN 'Schema: ' || d.schema END,
    CASE WHEN p.producers IS NOT NULL THEN 'Produced by jobs: ' || p.producers END,
    CASE WHEN p.consumers IS NOT NULL THEN 'Consumed by jobs: ' || p.consumers END,
    CASE WHEN l.lines IS NOT NULL THEN 'Column lineage:' || chr(10) || l.lines END) AS text
FROM lin_datasets d LEFT JOIN lin_pc p ON p.key = d.key LEFT JOIN lin_lines l ON l.key = d.key""")

_cte("chunk_jobs", ("lin_jobs", "lin_edges", "lin_datasets", "lin_runs"), """
SELECT j.key AS id, 'job' AS kind, j.name, j.namespace, NULL::VARCHAR AS source,
  concat_ws(chr(10), 'Job (ETL pipeline): ' || j.name, 'Namespace: ' || j.namespace,
    'Reads from (inputs): ' || coalesce((SELECT string_agg(d.name, ', ' ORDER BY d.name)
       FROM lin_edges e JOIN lin_datasets d ON d.key = e.src
       WHERE e.dst = j.key AND e.relation = 'feeds'), 'none'),
    'Writes to (outputs): ' || coalesce((SELECT string_agg(d.name, ', ' ORDER BY d.name)
       FROM lin_edges e JOIN lin_datasets d ON d.key = e.dst
       WHERE e.src = j.key AND e.relation = 'produces'), 'none'),
    'Executions: ' || r.n_ok || ' successful, ' || r.n_fail || ' failed',
    'Last event: ' || r.last_type || ' at ' || r.last_time) AS text
FROM lin_jobs j JOIN (
  SELECT job_key, count(*) FILTER (WHERE event_type = 'COMPLETE') AS n_ok,
    count(*) FILTER (WHERE event_type = 'FAIL') AS n_fail,
    arg_max(event_type, event_time) AS last_type, max(event_time) AS last_time
  FROM lin_runs GROUP BY job_key) r ON r.job_key = j.key""")

_CHAIN_LINE = "'  -> job ''' || j.name || ''' -> dataset ''' || o.name || ''''"

_cte("chunk_impact", ("lin_sources", "lin_edges", "lin_jobs", "lin_datasets"), f"""
SELECT 'impact::' || s.key AS id, 'impact_chain' AS kind, s.name, '' AS namespace,
  NULL::VARCHAR AS source,
  'Impact chain for dataset: ' || s.name || chr(10) || 'If ''' || s.name
    || ''' changes schema or is deleted, the following are affected:' || chr(10)
    || string_agg({_CHAIN_LINE}, chr(10) ORDER BY {_CHAIN_LINE}) AS text
FROM lin_sources s JOIN lin_edges f ON f.src = s.key AND f.relation = 'feeds'
JOIN lin_edges p ON p.src = f.dst AND p.relation = 'produces'
JOIN lin_jobs j ON j.key = f.dst JOIN lin_datasets o ON o.key = p.dst
GROUP BY s.key, s.name""")

_cte("md_files", (), r"""
SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path,
  '# ' || source || ' ' || lang || chr(10)
    || regexp_replace(text, '\n([^\n]*)\n', chr(10) || '## \1' || chr(10), 'g') AS content
FROM documents""")

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FIRST = "regexp_extract(section, '^([^\\n]*)', 1)"
_BODY = "regexp_extract(section, '^[^\\n]*\\n([\\s\\S]*)$', 1)"

_cte("md_sections", ("md_files",), f"""
SELECT source, idx, name, text FROM (
  SELECT source, idx,
    CASE WHEN idx = 0 THEN source ELSE {_STRIP.format(x=_FIRST)} END AS name,
    CASE WHEN idx = 0 THEN {_STRIP.format(x='section')}
         ELSE '## ' || {_STRIP.format(x=_FIRST)} || chr(10) || chr(10) ||
              CASE WHEN contains(section, chr(10)) THEN {_STRIP.format(x=_BODY)} ELSE '' END
    END AS text
  FROM (SELECT path AS source, unnest(parts) AS section,
               generate_subscripts(parts, 1) - 1 AS idx
        FROM (SELECT path, string_split(content, chr(10) || '## ') AS parts FROM md_files)))
WHERE length(text) >= 60""")

_cte("chunk_knowledge", ("md_sections",), """
SELECT 'knowledge::' || source || '::' || CAST(row_number() OVER (ORDER BY source, idx) - 1
                                              AS VARCHAR) AS id,
  'knowledge' AS kind, name, '' AS namespace, source, text AS document
FROM md_sections""")

_cte("chunks_all", ("chunk_datasets", "chunk_jobs", "chunk_impact", "chunk_knowledge"), """
SELECT id, kind, name, namespace, source, 'passage: ' || text AS document FROM chunk_datasets
UNION ALL
SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_jobs
UNION ALL
SELECT id, kind, name, namespace, source, 'passage: ' || text FROM chunk_impact
UNION ALL
SELECT id, kind, name, namespace, source, document FROM chunk_knowledge""")
