"""Registered warehouse queries (P01-P12, S01-S02, F/J/A/W rows on warehouse data).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables.  Parameters are fixed for repeatable oracle runs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse as W
from ..session import cut_lineage
from ..sources import fixtures as X
from . import oracle as O

AS_OF = _dt.date.fromisoformat(O.AS_OF)
STAMP = _dt.datetime.fromisoformat(O.STAMP)


def _orders_clean(spark, d):
    return W.orders_clean(X.raw_orders(spark, d), loaded_at=STAMP)


def _customers_enriched(spark, d):
    return W.customers_enrich(X.raw_customers(spark, d), AS_OF, loaded_at=STAMP)


def _products_normalized(spark, d):
    return W.products_normalize(X.raw_products(spark, d), loaded_at=STAMP)


def _fact(spark, d):
    return W.sales_fact(W.as_partition_types(_orders_clean(spark, d)),
                        _customers_enriched(spark, d))


def _metrics(spark, d):
    return W.product_metrics(W.as_partition_types(_orders_clean(spark, d)),
                             _products_normalized(spark, d))


def _c360(spark, d, dedup=False):
    """Fact and metrics from one scan of the order lines: the cleaned orders are
    written once, cut to the columns that either reads."""
    clean = cut_lineage(W.as_partition_types(_orders_clean(spark, d)).select(
        *W.FACT_FROM_ORDER, *W.FACT_PARTITION), "orders_clean")
    fact = W.sales_fact(clean, _customers_enriched(spark, d))
    metrics = W.product_metrics(clean, _products_normalized(spark, d))
    return W.customer_360(fact, metrics, dedup_categories=dedup)


def _forecast(spark, d):
    return W.inventory_forecast(W.given_demand(W.inventory_features(_metrics(spark, d))),
                                AS_OF)


def _churn(spark, d, c360=None):
    c360 = _c360(spark, d) if c360 is None else c360
    return W.churn_scores(W.given_churn(W.churn_features(c360, AS_OF)), scored_at=STAMP)


def q_raw_orders(spark, d):
    return X.raw_orders(spark, d)


def q_raw_customers(spark, d):
    return X.raw_customers(spark, d)


def q_raw_products(spark, d):
    return X.raw_products(spark, d)


def q_pruned_scan(spark, d):
    """A two-column projection reads two columns."""
    return X.raw_products(spark, d).select("product_id", "sku")


def q_p04(spark, d):
    return W.gdpr_mask(_customers_enriched(spark, d))


def q_p08b(spark, d):
    return _c360(spark, d, dedup=True)


def q_p09_features(spark, d):
    return W.inventory_features(_metrics(spark, d))


def q_p10(spark, d):
    return W.catalog_enriched(_products_normalized(spark, d), _forecast(spark, d))


def q_p12(spark, d):
    c360 = cut_lineage(_c360(spark, d), "customer_360")
    return W.marketing_segments(c360, _churn(spark, d, c360))


def q_f04_tiers(spark, d):
    """F04 on the churn tiers: counts per (risk, action)."""
    seg = q_p12(spark, d)
    return (seg.groupBy("churn_risk", "recommended_action")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


QUERIES = {
    "s01_raw_orders": (q_raw_orders, O.sql("SELECT * FROM raw_orders", "raw_orders")),
    "s01_raw_customers": (q_raw_customers,
                          O.sql("SELECT * FROM raw_customers", "raw_customers")),
    "s01_raw_products": (q_raw_products, O.sql("SELECT * FROM raw_products", "raw_products")),
    "s02_pruned_scan": (q_pruned_scan,
                        O.sql("SELECT product_id, sku FROM raw_products", "raw_products")),
    "p01_orders_clean": (_orders_clean, O.sql("SELECT * FROM orders_clean", "orders_clean")),
    "p02_customers_enrich": (_customers_enriched,
                             O.sql("SELECT * FROM customers_enriched", "customers_enriched")),
    "p03_products_normalize": (_products_normalized,
                               O.sql("SELECT * FROM products_normalized",
                                     "products_normalized")),
    "p04_gdpr_mask": (q_p04, O.sql(
        "SELECT customer_id, signup_date, segment, country, age_days FROM customers_enriched",
        "customers_enriched")),
    "p05_sales_fact": (_fact, O.sql("SELECT * FROM fact_sales", "fact_sales")),
    "p06_product_metrics": (_metrics, O.sql("SELECT * FROM product_metrics", "product_metrics")),
    "p07_daily_revenue": (lambda s, d: W.daily_revenue(_fact(s, d)), O.sql("""
SELECT order_date AS report_date, country, segment, "year", "month",
  CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
  CAST(sum(amount) AS DOUBLE) AS total_revenue,
  CAST(sum(amount) AS DOUBLE) / CAST(count(amount) AS DOUBLE) AS avg_order_value
FROM fact_sales GROUP BY order_date, country, segment, "year", "month\"""", "fact_sales")),
    "p08_customer_360": (_c360, O.sql("SELECT * FROM customer_360", "customer_360")),
    "p08b_customer_360_dedup": (q_p08b, O.sql("SELECT * FROM customer_360_dedup",
                                              "customer_360_dedup")),
    "p09_inventory_features": (q_p09_features, O.sql("SELECT * FROM inventory_features",
                                                     "inventory_features")),
    "p09_inventory_forecast": (_forecast, O.sql("SELECT * FROM inventory_forecast",
                                                "inventory_forecast")),
    "p10_catalog_enriched": (q_p10, O.sql("""
SELECT p.*, f.predicted_demand, f.recommended_stock,
  CASE WHEN p.stock < f.predicted_demand THEN 'understocked'
       WHEN p.stock > f.recommended_stock * 2 THEN 'overstocked' ELSE 'ok' END AS stock_status
FROM products_normalized p LEFT JOIN inventory_forecast f ON p.product_id = f.product_id""",
                                          "products_normalized", "inventory_forecast")),
    "p11_churn_scores": (_churn, O.sql("SELECT * FROM churn_scores", "churn_scores")),
    "p12_marketing_segments": (q_p12, O.sql("""
SELECT c.customer_id, coalesce(s.risk_level, 'unknown') AS churn_risk,
  CASE WHEN s.risk_level = 'high' THEN 'retention_call'
       WHEN s.risk_level = 'medium' THEN 'discount_email' ELSE 'upsell_push' END
    AS recommended_action,
  concat_ws('_', s.risk_level, CAST(c."year" AS VARCHAR), CAST(c."month" AS VARCHAR))
    AS campaign_code
FROM customer_360 c LEFT JOIN churn_scores s ON c.customer_id = s.customer_id""",
                                            "customer_360", "churn_scores")),
    "f04_tier_counts": (q_f04_tiers, O.sql("""
SELECT churn_risk, recommended_action, CAST(count(*) AS BIGINT) AS n FROM (
SELECT coalesce(s.risk_level, 'unknown') AS churn_risk,
  CASE WHEN s.risk_level = 'high' THEN 'retention_call'
       WHEN s.risk_level = 'medium' THEN 'discount_email' ELSE 'upsell_push' END
    AS recommended_action
FROM customer_360 c LEFT JOIN churn_scores s ON c.customer_id = s.customer_id)
GROUP BY ALL""", "customer_360", "churn_scores")),
}
