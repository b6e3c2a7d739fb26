"""Registered lineage-graph queries.

The graph is built from lineage events derived from the ``events`` table, so
every query's work grows with it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.lineage import norm_job_name
from ..operators import codematch as CM
from ..operators import graph_ops as G
from ..operators.lineage_graph import build_graph, export_graph, run_stats
from ..schemas import EVENT
from ..session import scratch_path
from ..sources.code import job_code_files
from ..sources.events import day_cutoff, lineage_events, parse_events, read_events
from ..streaming.ingest import write_event_files
from . import oracle as O

# Fixed request parameters of the registered lookups.
ROOT_NAME = "ds_3"
ROOT_NS = "staging"
FIELD = "value_2"
SUGGEST_TEXT = "ds_1"
SCHEMA_NAME = "ds_hudi_1"
CENTRAL_JOB = "job_etl_user_1"


def graph(spark, d):
    """The lineage graph of ``events``, materialised once per query."""
    return build_graph(lineage_events(spark, d), materialize=True)


def q_datasets(spark, d):
    return graph(spark, d).datasets.select(
        "key", "namespace", "name", "format", F.array_join("schema", ", ").alias("schema"),
        "last_seen")


def q_jobs(spark, d):
    return graph(spark, d).jobs.select("key", "namespace", "name")


def q_edges(spark, d):
    return graph(spark, d).edges


def q_run_stats(spark, d):
    return run_stats(graph(spark, d).runs).select(
        "job_key", "n_complete", "n_fail", F.col("last.event_type").alias("last_type"),
        F.col("last.event_time").alias("last_time"))


def q_column_lineage(spark, d):
    return graph(spark, d).column_lineage.select(
        "dataset_key", "out_field", "src_table", "src_field", "type", "subtype")


def q_export_nodes(spark, d):
    return export_graph(graph(spark, d))[0]


def exact_code(spark, d, g):
    """(job_key, code) of the jobs that a file names exactly."""
    return CM.match_exact(g.jobs, CM.code_index(job_code_files(spark, d))).select("job_key", "code")


def q_export_nodes_code(spark, d):
    g = graph(spark, d)
    return export_graph(g, exact_code(spark, d, g))[0]


def q_export_edges(spark, d):
    return export_graph(graph(spark, d))[1]


def q_list_datasets(spark, d):
    return G.list_datasets(graph(spark, d))


_EVENT_COLUMNS = ("eventTime AS event_time", "eventType AS event_type",
                  "job.namespace AS namespace", "substring_index(job.name, '.', 1) AS job_name",
                  "coalesce(size(inputs), 0) AS n_inputs",
                  "coalesce(size(outputs), 0) AS n_outputs")


def q_read_events(spark, d):
    """The events written as NDJSON files and read back."""
    path = scratch_path(spark, "ndjson")
    write_event_files(lineage_events(spark, d), path)
    return read_events(spark, path).selectExpr(*_EVENT_COLUMNS)


def q_read_events_prefix(spark, d):
    """The same files below two folders of a prefix, read recursively."""
    path = scratch_path(spark, "ndjson")
    events = lineage_events(spark, d)
    even = F.pmod(F.xxhash64("eventTime", "job.name"), F.lit(2)) == 0
    write_event_files(events.where(even), path + "/a/b")
    write_event_files(events.where(~even), path + "/c")
    return read_events(spark, path, recursive=True).selectExpr(*_EVENT_COLUMNS)


def q_read_events_cutoff(spark, d):
    """A scan of the files modified since the cut-off of a day: all of
    them for a day long past, none for a day to come."""
    path = scratch_path(spark, "ndjson")
    write_event_files(lineage_events(spark, d), path)
    days = {"past": dt.datetime(2000, 1, 1, 12, tzinfo=dt.timezone.utc),
            "coming": dt.datetime(2999, 1, 1, 12, tzinfo=dt.timezone.utc)}
    past, coming = (read_events(spark, path, modified_since=day_cutoff(now), recursive=True)
                    .selectExpr(f"'{day}' AS day", *_EVENT_COLUMNS) for day, now in days.items())
    return past.unionByName(coming)


def q_parse_events(spark, d):
    """The events as JSON text rows, parsed."""
    events = lineage_events(spark, d)
    cols = [f.name for f in EVENT.fields if f.name != "_corrupt"]
    lines = events.select(F.to_json(F.struct(*cols)).alias("value"))
    return parse_events(lines).selectExpr(*_EVENT_COLUMNS)


_EVENTS_SQL = O.sql("""
SELECT event_time, ol_type AS event_type, 'shop' AS namespace, job_name,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN n_in ELSE 0 END AS n_inputs,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n_outputs
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS n_in
      FROM lin_ev)""", "lin_ev")


def q_sources(spark, d):
    return G.source_datasets(graph(spark, d)).select("key", "name", "namespace")


def q_terminals(spark, d):
    return G.terminal_datasets(graph(spark, d)).select("key", "name", "namespace")


def q_two_hop(spark, d):
    return G.two_hop(graph(spark, d))


def q_impact_chain(spark, d):
    return G.impact_chain(graph(spark, d)).select("ds_key", "ds_name", "job_name", "out_name")


def q_find_jobs(spark, d):
    return G.find_jobs(graph(spark, d)).select(
        "key", "name", "namespace", F.array_join("producers", ", ").alias("producers"),
        F.array_join("consumers", ", ").alias("consumers"))


def q_find_contains(spark, d):
    return G.find_datasets(graph(spark, d), ROOT_NAME, ROOT_NS, "contains").select(
        "key", "name", "namespace")


def q_find_exact(spark, d):
    return G.find_datasets(graph(spark, d), ROOT_NAME.upper(), None, "exact").select(
        "key", "name", "namespace")


def q_namespaces(spark, d):
    return G.list_namespaces(graph(spark, d))


def q_suggest(spark, d):
    return G.suggest(graph(spark, d), "dataset", SUGGEST_TEXT)


def q_search_field(spark, d):
    return G.search_field(graph(spark, d), FIELD).select("key", "name", "namespace", "source",
                                                          "hit")


def q_impact_exact(spark, d):
    return G.impact_by_name(graph(spark, d), ROOT_NAME, how="exact").select(
        "root_key", "node_key", "depth", "kind", "name", "truncated")


def q_impact_contains(spark, d):
    return G.impact_by_name(graph(spark, d), ROOT_NAME, ROOT_NS, how="contains").select(
        "root_key", "node_key", "depth", "kind", "name", "truncated")


def q_impact_all(spark, d):
    g = graph(spark, d)
    return G.with_names(g, G.impact_of_all(g)).select(
        "root_key", "node_key", "depth", "kind", "name", "truncated")


def q_impact_layers(spark, d):
    g = graph(spark, d)
    rows = G.impact_by_name(g, ROOT_NAME, ROOT_NS, how="contains")
    return G.impact_layers(rows).select("root_key", "depth",
                                        F.array_join("layer", "; ").alias("layer"))


def q_transitive(spark, d):
    """All nodes downstream of every source dataset, to the end of the chains."""
    return G.transitive_chain(graph(spark, d)).select("root_key", "node_key", "depth", "kind",
                                                      "name")


def q_trace(spark, d):
    g = graph(spark, d)
    roots = g.column_lineage.select(F.col("dataset_key").alias("key"),
                                    F.col("out_field").alias("field")).distinct()
    t = G.column_trace(g, roots)
    return (t.filter(~F.col("revisited"))
            .groupBy("root_key", "root_field", F.lower("src_dataset").alias("dataset"),
                     F.col("src_field").alias("field"))
            .agg(F.min(F.col("depth") + 1).cast("int").alias("depth")))


def q_trace_edges(spark, d):
    """Every expanded lineage edge of the walk, with its kind and marks."""
    g = graph(spark, d)
    roots = g.column_lineage.select(F.col("dataset_key").alias("key"),
                                    F.col("out_field").alias("field")).distinct()
    return G.column_trace(g, roots)


def q_dataset_schema(spark, d):
    return G.dataset_schema(graph(spark, d), SCHEMA_NAME)


def q_central(spark, d):
    return G.central(graph(spark, d), dataset=ROOT_NAME, job=CENTRAL_JOB)


def q_expand(spark, d):
    g = graph(spark, d)
    return G.expand(g, G.central(g, dataset=ROOT_NAME, job=CENTRAL_JOB), "both")


def q_expand_down_ns(spark, d):
    g = graph(spark, d)
    return G.expand(g, G.central(g, dataset=ROOT_NAME), "downstream", ns="shop")


def q_expandable(spark, d):
    g = graph(spark, d)
    vis = G.expand(g, G.central(g, dataset=ROOT_NAME, job=CENTRAL_JOB), "both")
    return G.expandable(g, vis, "both")


def q_induced(spark, d):
    g = graph(spark, d)
    vis = G.expand(g, G.central(g, dataset=ROOT_NAME, job=CENTRAL_JOB), "both")
    return G.induced_subgraph(g, vis)


def q_adjacency(spark, d):
    succ, pred = G.adjacency(graph(spark, d))
    return succ.select("key", F.array_join("successors", ",").alias("successors"))


def q_predecessors(spark, d):
    succ, pred = G.adjacency(graph(spark, d))
    return pred.select("key", F.array_join("predecessors", ",").alias("predecessors"))


def q_stats(spark, d):
    return G.graph_stats(graph(spark, d))


def q_sorted_names(spark, d):
    return G.sort_distinct(graph(spark, d).nodes, "name")


def q_norm_names(spark, d):
    return graph(spark, d).jobs.select("key", norm_job_name("name").alias("norm_name"))


_IMPACT_COLS = "root_key, node_key, depth, kind, name"

#: CTEs of the walk from every output field back to its sources.
_TRACE = (
    ("resolve", """
SELECT lower(name) AS lname, arg_min(key, (first_time, first_seq)) AS rkey
FROM lin_datasets GROUP BY lower(name)"""),
    ("trace(root_key, root_field, root_name, ldataset, field, d)", """
SELECT c.dataset_key, c.out_field, d.name, lower(d.name), c.out_field, 0
FROM (SELECT DISTINCT dataset_key, out_field FROM lin_cl) c
JOIN lin_datasets d ON d.key = c.dataset_key
UNION
SELECT t.root_key, t.root_field, t.root_name, lower(c.src_table), c.src_field, t.d + 1
FROM trace t JOIN resolve r ON r.lname = t.ldataset
JOIN lin_cl c ON c.dataset_key = r.rkey AND c.out_field = t.field
WHERE t.d < 7"""))


QUERIES = {
    "g01_graph_datasets": (q_datasets, O.sql(
        "SELECT key, namespace, name, format, schema, last_seen FROM lin_datasets",
        "lin_datasets")),
    "g01_graph_jobs": (q_jobs, O.sql("SELECT * FROM lin_jobs", "lin_jobs")),
    "a06_edges": (q_edges, O.sql("SELECT * FROM lin_edges", "lin_edges")),
    "a04_run_stats": (q_run_stats, O.sql("""
SELECT job_key, CAST(count(*) FILTER (WHERE event_type = 'COMPLETE') AS BIGINT) AS n_complete,
  CAST(count(*) FILTER (WHERE event_type = 'FAIL') AS BIGINT) AS n_fail,
  arg_max(event_type, event_time) AS last_type, max(event_time) AS last_time
FROM lin_runs GROUP BY job_key""", "lin_runs")),
    "a08_column_lineage": (q_column_lineage, O.sql(
        "SELECT dataset_key, out_field, src_table, src_field, type, subtype FROM lin_cl",
        "lin_cl")),
    "s14_export_nodes": (q_export_nodes, O.sql("""
SELECT n.key, n.kind, n.name, n.namespace, false AS has_code,
  n.key IN (SELECT dataset_key FROM lin_cl) AS has_column_lineage,
  coalesce(d.format, '') AS format
FROM lin_nodes n LEFT JOIN lin_datasets d ON d.key = n.key""", "lin_nodes", "lin_datasets",
                                                "lin_cl")),
    "s14_export_nodes_code": (q_export_nodes_code, O.sql("""
SELECT n.key, n.kind, n.name, n.namespace,
  n.kind = 'job' AND TRY_CAST(regexp_extract(n.name, '[0-9]+$') AS BIGINT) % 4 = 0 AS has_code,
  n.key IN (SELECT dataset_key FROM lin_cl) AS has_column_lineage,
  coalesce(d.format, '') AS format
FROM lin_nodes n LEFT JOIN lin_datasets d ON d.key = n.key""", "lin_nodes", "lin_datasets",
                                                "lin_cl")),
    "s14_export_edges": (q_export_edges, O.sql(
        "SELECT src AS source, dst AS target, relation FROM lin_edges", "lin_edges")),
    "f08_list_datasets": (q_list_datasets, O.sql(
        "SELECT key, namespace, name FROM lin_datasets", "lin_datasets")),
    "s05_read_events": (q_read_events, _EVENTS_SQL),
    "s06_read_events_prefix": (q_read_events_prefix, _EVENTS_SQL),
    "s06_read_events_cutoff": (q_read_events_cutoff,
                               _EVENTS_SQL.replace("SELECT event_time, ol_type",
                                                   "SELECT 'past' AS day, event_time, ol_type")),
    "x13_parse_events": (q_parse_events, _EVENTS_SQL),
    "j04_source_datasets": (q_sources, O.sql("SELECT key, name, namespace FROM lin_sources",
                                             "lin_sources")),
    "j05_terminal_datasets": (q_terminals, O.sql("""
SELECT key, name, namespace FROM lin_datasets
WHERE key NOT IN (SELECT src FROM lin_edges WHERE relation = 'feeds')""",
                                                 "lin_datasets", "lin_edges")),
    "j06_two_hop": (q_two_hop, O.sql("""
SELECT f.dst AS job_key, f.src AS ds_key, p.dst AS out_key
FROM lin_edges f JOIN lin_edges p ON f.dst = p.src
WHERE f.relation = 'feeds' AND p.relation = 'produces'""", "lin_edges")),
    "g06_impact_chain": (q_impact_chain, O.sql("""
SELECT s.key AS ds_key, s.name AS ds_name, j.name AS job_name, o.name AS out_name
FROM lin_sources s JOIN lin_edges f ON f.src = s.key AND f.relation = 'feeds'
JOIN lin_edges p ON p.src = f.dst AND p.relation = 'produces'
JOIN lin_jobs j ON j.key = f.dst JOIN lin_datasets o ON o.key = p.dst""",
                                               "lin_sources", "lin_edges", "lin_jobs",
                                               "lin_datasets")),
    "j07_find_jobs": (q_find_jobs, O.sql("""
SELECT d.key, d.name, d.namespace,
  coalesce((SELECT string_agg(j.name, ', ' ORDER BY j.name) FROM lin_edges e
            JOIN lin_jobs j ON j.key = e.src WHERE e.dst = d.key AND e.relation = 'produces'),
           '') AS producers,
  coalesce((SELECT string_agg(j.name, ', ' ORDER BY j.name) FROM lin_edges e
            JOIN lin_jobs j ON j.key = e.dst WHERE e.src = d.key AND e.relation = 'feeds'),
           '') AS consumers
FROM lin_datasets d""", "lin_datasets", "lin_edges", "lin_jobs")),
    "f06_find_datasets_contains": (q_find_contains, O.sql(f"""
SELECT key, name, namespace FROM lin_datasets
WHERE contains(lower(name), '{ROOT_NAME}') AND contains(lower(namespace), '{ROOT_NS}')""",
                                                         "lin_datasets")),
    "f07_find_datasets_exact": (q_find_exact, O.sql(f"""
SELECT key, name, namespace FROM lin_datasets WHERE lower(name) = '{ROOT_NAME}'""",
                                                    "lin_datasets")),
    "f08_list_namespaces": (q_namespaces, O.sql("""
SELECT DISTINCT namespace FROM lin_datasets WHERE namespace <> ''""", "lin_datasets")),
    "f09_suggest": (q_suggest, O.sql(f"""
SELECT DISTINCT name FROM lin_datasets WHERE contains(lower(name), '{SUGGEST_TEXT}')
ORDER BY name LIMIT 50""", "lin_datasets")),
    "f11_search_field": (q_search_field, O.sql("""
SELECT * FROM sch
UNION ALL
SELECT o.key, d.name, d.namespace, 'lineage output' AS source, o.out_field AS hit
FROM outs o JOIN lin_datasets d ON d.key = o.key
WHERE NOT EXISTS (SELECT 1 FROM sch WHERE sch.key = o.key AND starts_with(sch.hit, o.out_field))
""", "lin_datasets", "lin_cl", extra=(
        ("sch", f"""
SELECT key, name, namespace, 'schema' AS source, trim(e) AS hit
FROM (SELECT key, name, namespace, unnest(string_split(schema, ', ')) AS e FROM lin_datasets)
WHERE contains(lower(trim(split_part(e, '(', 1))), '{FIELD}')"""),
        ("outs", f"""
SELECT DISTINCT dataset_key AS key, out_field FROM lin_cl
WHERE contains(lower(out_field), '{FIELD}')""")))),
    "g03_impact_exact": (q_impact_exact, O.impact_sql(
        f"SELECT key FROM lin_datasets WHERE lower(name) = '{ROOT_NAME}'")),
    "g04_impact_contains": (q_impact_contains, O.impact_sql(
        f"SELECT key FROM lin_datasets WHERE contains(lower(name), '{ROOT_NAME}') "
        f"AND contains(lower(namespace), '{ROOT_NS}')")),
    "g02_impact_layers": (q_impact_layers, O.impact_sql(
        f"SELECT key FROM lin_datasets WHERE contains(lower(name), '{ROOT_NAME}') "
        f"AND contains(lower(namespace), '{ROOT_NS}')", select="""
SELECT i.root_key, i.depth,
  string_agg('[' || n.kind || '] ' || n.name, '; ' ORDER BY '[' || n.kind || '] ' || n.name)
    AS layer
FROM impact i JOIN lin_nodes n ON n.key = i.node_key GROUP BY i.root_key, i.depth""")),
    "g05_impact_all": (q_impact_all, O.impact_sql("SELECT key FROM lin_datasets")),
    "g07_transitive_chain": (q_transitive, O.sql("""
SELECT w.root_key, w.node_key, CAST(min(w.d) AS INTEGER) AS depth, any_value(n.kind) AS kind,
       any_value(n.name) AS name
FROM walk w JOIN lin_nodes n ON n.key = w.node_key WHERE w.node_key <> w.root_key
GROUP BY w.root_key, w.node_key""",
        "lin_datasets", "lin_edges", "lin_nodes", "lin_sources", extra=(
            ("walk(root_key, node_key, d)", """
  SELECT key, key, 0 FROM lin_sources
  UNION
  SELECT w.root_key, e.dst, w.d + 1 FROM walk w JOIN lin_edges e ON e.src = w.node_key
  WHERE w.d < (SELECT count(*) FROM lin_nodes)"""),),
        recursive=True)),
    "g08_column_trace": (q_trace, O.sql("""
SELECT root_key, root_field, ldataset AS dataset, field, CAST(min(d) AS INTEGER) AS depth
FROM trace
WHERE NOT (ldataset = lower(root_name) AND field = root_field)
GROUP BY root_key, root_field, ldataset, field""", "lin_datasets", "lin_cl", extra=_TRACE,
                                recursive=True)),
    "g08_column_trace_edges": (q_trace_edges, O.sql(f"""
SELECT n.root_key, n.root_field, n.depth, n.ldataset AS dataset, n.field,
  c.src_table AS src_dataset, c.src_field, c.type, c.subtype,
  s.depth <> n.depth + 1 AS revisited,
  s.depth = n.depth + 1 AND n.depth + 1 > {G.MAX_DEPTH} AS truncated
FROM reached n JOIN resolve r ON r.lname = n.ldataset
JOIN lin_cl c ON c.dataset_key = r.rkey AND c.out_field = n.field AND c.src_table IS NOT NULL
LEFT JOIN reached s ON s.root_key = n.root_key AND s.root_field = n.root_field
  AND s.ldataset = lower(c.src_table) AND s.field = c.src_field
WHERE n.depth <= {G.MAX_DEPTH}""", "lin_datasets", "lin_cl", extra=(*_TRACE, ("reached", """
SELECT root_key, root_field, ldataset, field, CAST(min(d) AS INTEGER) AS depth
FROM trace GROUP BY root_key, root_field, ldataset, field""")), recursive=True)),
    "g12_central": (q_central, O.sql(f"""
SELECT key, kind, namespace, name FROM lin_nodes
WHERE (kind = 'dataset' AND name = '{ROOT_NAME}') OR (kind = 'job' AND name = '{CENTRAL_JOB}')
""", "lin_nodes")),
    "g10_expand": (q_expand, O.sql("""
SELECT key FROM central UNION
SELECT e.dst FROM lin_edges e JOIN central c ON e.src = c.key UNION
SELECT e.src FROM lin_edges e JOIN central c ON e.dst = c.key""", "lin_nodes", "lin_edges",
                                   extra=(("central", f"""
SELECT key FROM lin_nodes
WHERE (kind = 'dataset' AND name = '{ROOT_NAME}') OR (kind = 'job' AND name = '{CENTRAL_JOB}')
"""),))),
    "g10_expand_downstream_ns": (q_expand_down_ns, O.sql("""
SELECT key FROM central UNION
SELECT e.dst FROM lin_edges e JOIN central c ON e.src = c.key
WHERE e.dst IN (SELECT key FROM lin_nodes WHERE namespace = 'shop')""",
                                                         "lin_nodes", "lin_edges",
                                                         extra=(("central", f"""
SELECT key FROM lin_nodes WHERE kind = 'dataset' AND name = '{ROOT_NAME}'"""),))),
    "g11_expandable": (q_expandable, O.sql("""
SELECT DISTINCT v.key FROM vis v
JOIN (SELECT src AS key, dst AS nbr FROM lin_edges
      UNION ALL SELECT dst AS key, src AS nbr FROM lin_edges) e ON e.key = v.key
WHERE e.nbr NOT IN (SELECT key FROM vis)""", "lin_nodes", "lin_edges", extra=(
        ("central", f"""
SELECT key FROM lin_nodes
WHERE (kind = 'dataset' AND name = '{ROOT_NAME}') OR (kind = 'job' AND name = '{CENTRAL_JOB}')
"""),
        ("vis", """
SELECT key FROM central UNION
SELECT e.dst FROM lin_edges e JOIN central c ON e.src = c.key UNION
SELECT e.src FROM lin_edges e JOIN central c ON e.dst = c.key""")))),
    "j12_induced_subgraph": (q_induced, O.sql("""
SELECT * FROM lin_edges WHERE src IN (SELECT key FROM vis) AND dst IN (SELECT key FROM vis)""",
                                              "lin_nodes", "lin_edges", extra=(
        ("central", f"""
SELECT key FROM lin_nodes
WHERE (kind = 'dataset' AND name = '{ROOT_NAME}') OR (kind = 'job' AND name = '{CENTRAL_JOB}')
"""),
        ("vis", """
SELECT key FROM central UNION
SELECT e.dst FROM lin_edges e JOIN central c ON e.src = c.key UNION
SELECT e.src FROM lin_edges e JOIN central c ON e.dst = c.key""")))),
    "g13_adjacency": (q_adjacency, O.sql("""
SELECT src AS key, string_agg(dst, ',' ORDER BY dst) AS successors FROM lin_edges GROUP BY src""",
                                         "lin_edges")),
    "g13_predecessors": (q_predecessors, O.sql("""
SELECT dst AS key, string_agg(src, ',' ORDER BY src) AS predecessors FROM lin_edges
GROUP BY dst""", "lin_edges")),
    "a09_graph_stats": (q_stats, O.sql("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM lin_datasets) AS datasets,
       (SELECT CAST(count(*) AS BIGINT) FROM lin_jobs) AS jobs,
       (SELECT CAST(count(*) AS BIGINT) FROM lin_edges) AS edges""",
                                       "lin_datasets", "lin_jobs", "lin_edges")),
    "k01_sorted_names": (q_sorted_names, O.sql("SELECT DISTINCT name FROM lin_nodes",
                                               "lin_nodes")),
    "x09_norm_job_name": (q_norm_names, O.sql("""
SELECT key, regexp_replace(replace(lower(name), '-', '_'), '^job_', '') AS norm_name
FROM lin_jobs""", "lin_jobs")),
}
