"""Registered model, streaming, DAG and tool-surface queries (M01, M02, M04,
T01, T02, P13, G09)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import warehouse as W
from ..operators.chunks import L_CODE
from ..operators.tools import run_tool
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as X
from ..sources.events import lineage_events
from ..streaming import ingest as S
from . import oracle as O
from .chunk_queries import QUERIES as CQ
from .graph_queries import QUERIES as GQ
from .graph_queries import FIELD, ROOT_NAME, ROOT_NS, SCHEMA_NAME, graph
from .warehouse_queries import AS_OF, QUERIES as WQ, STAMP, _c360, _metrics

#: The end of a job's document that holds its code (matched names have no SQL form).
CODE_TAIL = "(?s)\n" + re.escape(L_CODE) + ".*"


def q_churn_model(spark, d):
    """Every customer-month scored by a model of the latest labelled period."""
    c360 = cut_lineage(_c360(spark, d), "customer_360")
    path = scratch_path(spark, "churn_model")
    M.save(M.fit_churn(M.churn_snapshot(c360, M.label_cut(c360))), path)
    scored = M.score_churn(M.load(path), W.churn_features(c360, AS_OF))
    return W.churn_scores(scored, scored_at=STAMP).select("customer_id", "churn_probability",
                                                          "risk_level")


def q_churn_snapshot(spark, d):
    """Features and labels of the latest labelled period."""
    c360 = cut_lineage(_c360(spark, d), "customer_360")
    return M.churn_snapshot(c360, M.label_cut(c360))


def q_churn_quality(spark, d):
    """A model of the period before, judged on the latest one."""
    c360 = cut_lineage(_c360(spark, d), "customer_360")
    model = M.fit_churn(M.churn_snapshot(c360, M.label_cut(c360, back=1)))
    return M.churn_quality(model, M.churn_snapshot(c360, M.label_cut(c360)))


def _demand_pairs(spark, d):
    return M.demand_pairs(W.inventory_features(_metrics(spark, d)))


def q_demand_model(spark, d):
    """Every product-month scored by a model of the next row's units."""
    pairs = cut_lineage(_demand_pairs(spark, d).select("product_id", "sku", *M.DEMAND_FEATURES,
                                                       "next_sold"), "demand_pairs")
    path = scratch_path(spark, "demand_model")
    M.save(M.fit_demand(pairs), path)
    return W.inventory_forecast(M.score_demand(M.load(path), pairs), AS_OF)


def q_demand_pairs(spark, d):
    """Rolling mean and the units of the product's next row."""
    return _demand_pairs(spark, d).select("product_id", "year", "month", "total_sold",
                                          "rolling_avg_sold", "next_sold", "next_month")


def q_demand_quality(spark, d):
    """A model of the rows whose next row lies before the last twelve months,
    judged on the others."""
    pairs = cut_lineage(_demand_pairs(spark, d), "demand_pairs")
    cut = M.label_cut(pairs)
    model = M.fit_demand(pairs.where(F.col("next_month") < F.lit(cut)))
    return M.demand_quality(model, pairs.where(F.col("next_month") >= F.lit(cut)))


def _streamed_graph(spark, d):
    src = scratch_path(spark, "events")
    S.write_event_files(lineage_events(spark, d), src)
    store, ck = scratch_path(spark, "graph_store"), scratch_path(spark, "stream_ckpt")
    S.stream_ingest(spark, src, store, ck, max_files_per_trigger=4)
    return S.stored_graph(spark, store)


def q_stream_ingest(spark, d):
    return _streamed_graph(spark, d).datasets.select(
        "key", "namespace", "name", "format", F.array_join("schema", ", ").alias("schema"),
        "last_seen")


def q_stream_graph(spark, d):
    """The other four tables of the streamed graph, as (table, a, b, c, detail)."""
    g = _streamed_graph(spark, d)
    none = F.lit(None).cast("string")

    def rows(name, df, a, b, c, detail):
        return df.select(F.lit(name).alias("table"), F.col(a).alias("a"), F.col(b).alias("b"),
                         F.col(c).alias("c"), detail.alias("detail"))

    return (rows("jobs", g.jobs, "key", "namespace", "name", none)
            .unionByName(rows("edges", g.edges, "src", "dst", "relation", none))
            .unionByName(rows("runs", g.runs, "job_key", "event_type", "event_time", none))
            .unionByName(rows("column_lineage", g.column_lineage, "dataset_key", "out_field",
                              "src_table", F.concat_ws("|", "src_field", "type", "subtype"))))


def q_stream_run_stats(spark, d):
    src = scratch_path(spark, "events")
    S.write_event_files(lineage_events(spark, d), src)
    t = S.stream_run_stats(spark, src, scratch_path(spark, "stats_ckpt"),
                           scratch_path(spark, "run_stats"))
    return t.select("job_key", "n_complete", "n_fail", F.col("last.event_type").alias("last_type"),
                    F.col("last.event_time").alias("last_time"))


def _run_chain(spark, d, models=False):
    from .warehouse_dag import run_warehouse
    raw = {"orders": X.raw_orders(spark, d), "customers": X.raw_customers(spark, d),
           "products": X.raw_products(spark, d)}
    return run_warehouse(spark, raw, scratch_path(spark, "warehouse"), AS_OF, loaded_at=STAMP,
                         models=models)


def q_warehouse_dag(spark, d):
    return spark.read.parquet(_run_chain(spark, d)["marketing_segments"])


def q_warehouse_models(spark, d):
    """Rows of the tables that follow from the models' scores, when the chain
    fits, saves and loads its own models, and how many rows hold a score in range."""
    paths = _run_chain(spark, d, models=True)

    def scored(name, good):
        return spark.read.parquet(paths[name]).agg(
            F.count("*").alias("n_rows"), F.count_if(F.expr(good)).alias("n_scored")
        ).select(F.lit(name).alias("table"), "n_rows", "n_scored")

    return (scored("inventory_forecast", "predicted_demand IS NOT NULL")
            .unionByName(scored("churn_scores", "churn_probability BETWEEN 0 AND 1")))


#: Table of the job chain -> its own query and the amount that the check sums.
CHAIN = {"orders_clean": ("p01_orders_clean", "amount"),
         "customers_enriched": ("p02_customers_enrich", "age_days"),
         "products_normalized": ("p03_products_normalize", "price"),
         "customers_anonymized": ("p04_gdpr_mask", "age_days"),
         "fact_sales": ("p05_sales_fact", "amount"),
         "product_metrics": ("p06_product_metrics", "total_sold"),
         "daily_revenue": ("p07_daily_revenue", "total_revenue"),
         "customer_360": ("p08_customer_360", "total_spent"),
         "inventory_forecast": ("p09_inventory_forecast", "predicted_demand"),
         "catalog_enriched": ("p10_catalog_enriched", "stock"),
         "churn_scores": ("p11_churn_scores", "churn_probability"),
         "marketing_segments": ("p12_marketing_segments", "customer_id")}


def q_warehouse_tables(spark, d):
    """Every table of the chain as written: rows and the sum of one
    amount."""
    from .warehouse_dag import run_warehouse
    raw = {"orders": X.raw_orders(spark, d), "customers": X.raw_customers(spark, d),
           "products": X.raw_products(spark, d)}
    paths = run_warehouse(spark, raw, scratch_path(spark, "warehouse"), AS_OF, loaded_at=STAMP)
    out = None
    for name, (_, amount) in CHAIN.items():
        row = spark.read.parquet(paths[name]).agg(
            F.count("*").alias("n_rows"), F.round(F.sum(F.col(amount).cast("double")), 1)
            .alias("total")).select(F.lit(name).alias("table"), "n_rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


def q_sync(spark, d):
    """The stored index after a sync of events, then of events, code and
    markdown: the chunks as stored, a job's document without its code."""
    from ..sources.code import job_code_files
    from ..sources.markdown import markdown_files
    from .sync import sync
    store = scratch_path(spark, "index_store")
    events = lineage_events(spark, d)
    for code, markdown in ((None, None), (job_code_files(spark, d), markdown_files(spark, d))):
        built, index, _ = sync(spark, events, code, markdown, store)
        built.drop()                        # the index is stored
    text = F.when(F.col("kind") == "job", F.regexp_replace("document", CODE_TAIL, "")).otherwise(
        F.col("document"))
    return index.withColumn("document", text)


def q_dataset_schema(spark, d):
    return run_tool(graph(spark, d), "get_dataset_schema", dataset_name=SCHEMA_NAME)


def q_tool_impact(spark, d):
    return run_tool(graph(spark, d), "get_impact", dataset_name=ROOT_NAME,
                    namespace=ROOT_NS).select("root_key", "node_key", "depth", "kind", "name",
                                              "truncated")


def q_tool_search_field(spark, d):
    return run_tool(graph(spark, d), "search_field", field_name=FIELD).select(
        "key", "name", "namespace", "source", "hit")


def q_tool_find_jobs(spark, d):
    return run_tool(graph(spark, d), "find_jobs", dataset_name="").select(
        "key", "name", "namespace", F.array_join("producers", ", ").alias("producers"),
        F.array_join("consumers", ", ").alias("consumers"))


def q_tool_job_code(spark, d):
    """The code of every job through the lookup, which compares names in any case."""
    from ..sources.code import job_code_files
    return run_tool(graph(spark, d), "get_job_code", code=job_code_files(spark, d)).select(
        "job_key", "job_name", "code")


QUERIES = {
    "m01_churn_model": (q_churn_model, None),
    "m02_demand_model": (q_demand_model, None),
    "m01_churn_quality": (q_churn_quality, None),
    "m02_demand_quality": (q_demand_quality, None),
    "m01_churn_snapshot": (q_churn_snapshot, f"""
WITH c AS (SELECT *, make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), 1) AS m
           FROM ({WQ["p08_customer_360"][1]})),
k AS (SELECT CAST(max(m) - INTERVAL 11 MONTH AS DATE) AS cut FROM c),
active AS (SELECT DISTINCT customer_id FROM c, k WHERE m >= cut)
SELECT c.customer_id, total_orders, total_spent, avg_order_value,
  CAST(date_diff('day', last_order_date, cut) AS INTEGER) AS days_since_last_order, year, month,
  CASE WHEN a.customer_id IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label
FROM c CROSS JOIN k LEFT JOIN active a ON a.customer_id = c.customer_id
WHERE m < cut"""),
    "m02_demand_pairs": (q_demand_pairs, f"""
SELECT product_id, year, month, total_sold,
  avg(total_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_avg_sold,
  CAST(lead(total_sold) OVER w AS DOUBLE) AS next_sold,
  lead(make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), 1)) OVER w AS next_month
FROM ({WQ["p06_product_metrics"][1]})
WINDOW w AS (PARTITION BY product_id ORDER BY year, month)"""),
    "t01_stream_ingest": (q_stream_ingest, GQ["g01_graph_datasets"][1]),
    "t01_stream_graph": (q_stream_graph, O.sql("""
SELECT 'jobs' AS "table", key AS a, namespace AS b, name AS c, NULL::VARCHAR AS detail
FROM lin_jobs
UNION ALL SELECT 'edges', src, dst, relation, NULL FROM lin_edges
UNION ALL SELECT 'runs', job_key, event_type, event_time, NULL FROM lin_runs
UNION ALL SELECT 'column_lineage', dataset_key, out_field, src_table,
                 concat_ws('|', src_field, type, subtype) FROM lin_cl""",
                                               "lin_jobs", "lin_edges", "lin_runs", "lin_cl")),
    "t02_stream_run_stats": (q_stream_run_stats, GQ["a04_run_stats"][1]),
    "p13_warehouse_models": (q_warehouse_models, f"""
SELECT 'inventory_forecast' AS "table", count(*) AS n_rows, count(*) AS n_scored
FROM ({WQ["p09_inventory_forecast"][1]})
UNION ALL SELECT 'churn_scores', count(*), count(*) FROM ({WQ["p11_churn_scores"][1]})"""),
    "p13_warehouse_dag": (q_warehouse_dag, WQ["p12_marketing_segments"][1]),
    "p13_warehouse_tables": (q_warehouse_tables, "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"table\", count(*) AS n_rows, "
        f"round(sum(CAST({amount} AS DOUBLE)), 1) AS total FROM ({WQ[query][1]})"
        for name, (query, amount) in CHAIN.items())),
    "g09_dataset_schema": (q_dataset_schema, O.sql(f"""
SELECT d.key, d.name, d.namespace, d.schema,
  coalesce((SELECT string_agg(line, chr(10) ORDER BY f_time, f_seq, f_fpos) FROM (
     SELECT f_time, f_seq, f_fpos, out_field || ' ← ' ||
       string_agg(src_table || '.' || src_field, ', ' ORDER BY s_time, s_seq, s_fpos) AS line
     FROM lin_cl c WHERE c.dataset_key = d.key GROUP BY out_field, f_time, f_seq, f_fpos)),
    '') AS lineage
FROM (SELECT * FROM lin_datasets WHERE contains(lower(name), '{SCHEMA_NAME}')
      ORDER BY first_time, first_seq LIMIT 1) d""", "lin_datasets", "lin_cl")),
    "m04_tool_impact": (q_tool_impact, GQ["g04_impact_contains"][1]),
    "m04_tool_search_field": (q_tool_search_field, GQ["f11_search_field"][1]),
    "m04_tool_find_jobs": (q_tool_find_jobs, GQ["j07_find_jobs"][1]),
    "m04_tool_job_code": (q_tool_job_code, None),
    "g15_sync": (q_sync, CQ["r05_build_index"][1]),
}
