"""Spark queries against their DuckDB oracle on sf0.001 (row count, column
names and an order-insensitive value hash)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "tools"))

from conftest import SF_SMALL  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

FAST = [
    "p01_orders_clean", "p02_customers_enrich", "p03_products_normalize", "p04_gdpr_mask",
    "p05_sales_fact", "p06_product_metrics", "p07_daily_revenue", "p08_customer_360",
    "p08b_customer_360_dedup", "p09_inventory_features", "p09_inventory_forecast",
    "p10_catalog_enriched", "p11_churn_scores", "p12_marketing_segments",
    "g01_graph_datasets", "a06_edges", "a08_column_lineage", "a04_run_stats",
    "g05_impact_all", "g08_column_trace", "f11_search_field", "j09_match_suffix",
    "r01_dataset_chunks", "r04_knowledge_chunks", "r06_vector_search_l2",
    "r09_detect_entities", "r10_graph_context", "r15_history_query", "w05_last_pairs",
    "d05_field_rows", "d04_inline_systems", "g09_dataset_schema",
]


def test_every_query_has_a_callable_and_oracles_are_known_ids():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark, duck):
    df = E.entry(spark)
    assert df.count() == len(duck.execute(E.oracle_sql()[E.FLAGSHIP]).fetchall()) > 0
    assert df.columns == ["report_date", "country", "segment", "year", "month",
                          "total_orders", "total_revenue", "avg_order_value"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(srows, df.columns)[0] == digest(orows, ocols)[0]
