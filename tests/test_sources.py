"""Event, code and markdown readers on small files written by the test."""

import json
import os

from trellis.operators.lineage_graph import build_graph
from trellis.session import scratch_path
from trellis.sources.events import quarantine, read_events


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def _golden_events():
    """The example pipeline's twelve jobs, one COMPLETE event each."""
    jobs = [
        ("orders_clean", ["raw/retail/orders"], "staging/retail/orders_clean"),
        ("customers_enrich", ["raw/retail/customers"], "staging/retail/customers_enriched"),
        ("products_normalize", ["raw/retail/products"], "staging/retail/products_normalized"),
        ("gdpr_mask", ["staging/retail/customers_enriched"],
         "compliance/retail/customers_anonymized"),
        ("sales_fact", ["staging/retail/orders_clean", "staging/retail/customers_enriched"],
         "analytics/retail/fact_sales"),
        ("product_metrics", ["staging/retail/orders_clean",
                             "staging/retail/products_normalized"],
         "analytics/retail/product_metrics"),
        ("daily_revenue", ["analytics/retail/fact_sales"], "reports/retail/daily_revenue"),
        ("customer_360", ["analytics/retail/fact_sales", "analytics/retail/product_metrics"],
         "reports/retail/customer_360"),
        ("catalog_enriched", ["staging/retail/products_normalized",
                              "ml/retail/inventory_forecast"],
         "staging/retail/catalog_enriched"),
        ("inventory_forecast", ["analytics/retail/product_metrics"],
         "ml/retail/inventory_forecast"),
        ("churn_model", ["analytics/retail/fact_sales", "reports/retail/customer_360"],
         "ml/retail/churn_scores"),
        ("marketing_segments", ["reports/retail/customer_360", "ml/retail/churn_scores"],
         "reports/retail/marketing_segments"),
    ]
    out = []
    for i, (j, ins, o) in enumerate(jobs):
        out.append({"eventType": "COMPLETE", "eventTime": f"2024-01-01T00:00:{i:02d}Z",
                    "job": {"namespace": "retail", "name": f"job_retail_{j}.run"},
                    "inputs": [{"namespace": "s3", "name": n} for n in ins],
                    "outputs": [{"namespace": "s3", "name": o,
                                 "facets": {"schema": {"fields": [{"name": "id",
                                                                   "type": "long"}]}}}]})
    return out


def test_golden_pipeline_graph_and_impact(spark):
    from trellis.operators import graph_ops as G
    path = scratch_path(spark, "golden")
    os.makedirs(_local(path), exist_ok=True)
    with open(os.path.join(_local(path), "events.ndjson"), "w") as f:
        for e in _golden_events():
            f.write(json.dumps(e) + "\n\n")          # blank lines are skipped
        f.write("{not json\n")                        # quarantined, not fatal
    ev = read_events(spark, path)
    good, bad = quarantine(ev)
    assert bad.count() == 1
    g = build_graph(good)
    rel = {r.relation: r["count"] for r in g.edges.groupBy("relation").count().collect()}
    assert rel == {"feeds": 18, "produces": 12}
    assert g.jobs.count() == 12
    imp = G.impact_by_name(g, "orders", ns="raw_retail", how="exact").collect()
    by_depth = {}
    for r in imp:
        by_depth.setdefault(r.depth, set()).add(r.name)
    assert by_depth[1] == {"job_retail_orders_clean"}
    assert by_depth[2] == {"orders_clean"}
    assert by_depth[3] == {"job_retail_sales_fact", "job_retail_product_metrics"}
    assert by_depth[5] == {"job_retail_daily_revenue", "job_retail_customer_360",
                           "job_retail_churn_model", "job_retail_inventory_forecast"}
    assert max(by_depth) == 6                        # capped: marketing_segments not reached


def test_missing_event_path_is_empty(spark):
    assert read_events(spark, "/nonexistent/trellis/events").count() == 0


def test_job_code_and_markdown_readers(spark):
    from trellis.sources.code import read_job_code
    from trellis.sources.markdown import read_markdown
    base = _local(scratch_path(spark, "files"))
    os.makedirs(os.path.join(base, "sub"), exist_ok=True)
    with open(os.path.join(base, "sub", "job_a.py"), "w") as f:
        f.write("print(1)\nprint(2)\n")
    with open(os.path.join(base, "notes.md"), "w") as f:
        f.write("# t\n## s\nbody\n")
    code = {r.file_name: r.code for r in read_job_code(spark, base).collect()}
    assert code == {"job_a": "print(1)\nprint(2)\n"}
    assert read_job_code(spark, base, recursive=False).count() == 0     # one folder only
    with open(os.path.join(base, "job_b.py"), "w") as f:
        f.write("pass\n")
    assert [r.file_name for r in read_job_code(spark, base, recursive=False).collect()] == ["job_b"]
    with open(os.path.join(base, "sub", "notes.md"), "w") as f:
        f.write("# deeper\n")
    md = [tuple(r) for r in read_markdown(spark, base).collect()]
    assert md == [("notes.md", "# t\n## s\nbody\n")]


def test_parse_events_and_modified_since(spark):
    import datetime as dt

    from trellis.sources.events import parse_events
    lines = spark.createDataFrame(
        [('{"eventType": "START", "eventTime": "t", "job": {"namespace": "n", "name": "j.x"}}',),
         ("not json",)], "value string")
    got = [(r.eventType, r.job.name if r.job else None, r._corrupt is not None)
           for r in parse_events(lines).collect()]
    assert got == [("START", "j.x", False), (None, None, True)]
    path = scratch_path(spark, "mtime")
    os.makedirs(_local(path), exist_ok=True)
    with open(os.path.join(_local(path), "a.ndjson"), "w") as f:
        f.write(json.dumps(_golden_events()[0]) + "\n")
    future = dt.datetime.now() + dt.timedelta(days=1)
    assert read_events(spark, path, modified_since=future, recursive=True).count() == 0
    past = dt.datetime(2000, 1, 1)
    assert read_events(spark, path, modified_since=past, recursive=True).count() == 1


def test_chat_logs_are_read_by_entry(spark):
    """One huge log file is split among tasks: no row holds more than one entry,
    and (block, pos) give the order they were written in."""
    from trellis.sources.chatlog import ENTRY_SEPARATOR, QUESTION_PATTERN, read_chat_logs
    base = os.path.join(_local(scratch_path(spark, "chats")), "chat_date=2024-01-01")
    os.makedirs(base)
    entries = [f"## 10:00:00 UTC\n\n**Question:** why {i}?\n\n{'line - ' * (i % 90)}\nso {i}\n\n"
               for i in range(3000)] + ["no question\n\n"]
    with open(os.path.join(base, "log.txt"), "w") as f:
        f.write("".join(e + ENTRY_SEPARATOR for e in entries))
    assert QUESTION_PATTERN and ENTRY_SEPARATOR == "---\n\n"
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = read_chat_logs(spark, os.path.dirname(base))
        assert got.rdd.getNumPartitions() > 3
        rows = got.orderBy("file", "block", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [r.question for r in rows] == [f"why {i}?" for i in range(3000)]
    assert all(r.answer.endswith(f"so {i}") for i, r in enumerate(rows))
    assert len({r.block for r in rows}) > 3 and {r.chat_date for r in rows} == {"2024-01-01"}


def test_churn_labels_come_from_the_later_period(spark):
    import datetime as dt

    from trellis.operators import models as M
    rows = [(1, 2020, 3, "2020-03-05"), (1, 2021, 2, "2021-02-01"), (2, 2020, 4, "2020-04-30"),
            (3, 2021, 12, "2021-12-31"), (2, 2020, 12, "2020-12-31")]
    c360 = spark.createDataFrame([(c, y, m, dt.date.fromisoformat(d), 1, 2.0, 2.0)
                                  for c, y, m, d in rows],
                                 "customer_id int, year int, month int, last_order_date date, "
                                 "total_orders bigint, total_spent double, avg_order_value double")
    cut = M.label_cut(c360)
    assert cut == dt.date(2021, 1, 1) and M.label_cut(c360, back=1) == dt.date(2020, 1, 1)
    got = {(r.customer_id, r.month): (r.days_since_last_order, r.label)
           for r in M.churn_snapshot(c360, cut).collect()}
    assert got == {(1, 3): (302, 0.0), (2, 4): (246, 1.0), (2, 12): (1, 1.0)}
