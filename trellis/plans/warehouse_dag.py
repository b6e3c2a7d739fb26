"""The twelve warehouse jobs chained through persisted tables.

Each stage is written where the reference writes it (partitioned by
year/month where it partitions) and the next stage reads it back, so
partition discovery types ``year``/``month`` exactly as in the reference.
Scores come from fitted Spark ML models (``models=True``) or from the
deterministic stand-ins used for oracle runs.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import models as M
from ..operators import warehouse as W
from ..session import cut_lineage
from ..sources.tables import write_table

PARTITIONED = ("orders_clean", "fact_sales", "product_metrics", "daily_revenue",
               "customer_360")


def run_warehouse(spark: SparkSession, raw: dict[str, DataFrame], out_dir: str,
                  as_of: _dt.date, loaded_at: _dt.datetime | None = None,
                  models: bool = False) -> dict[str, str]:
    """Run the DAG; returns table name -> path."""
    paths: dict[str, str] = {}

    def persist(name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(out_dir, name)
        write_table(df, path, by=["year", "month"] if name in PARTITIONED else None)
        paths[name] = path
        return spark.read.parquet(path)

    orders = persist("orders_clean", W.orders_clean(raw["orders"], loaded_at))
    customers = persist("customers_enriched",
                        W.customers_enrich(raw["customers"], as_of, loaded_at))
    products = persist("products_normalized", W.products_normalize(raw["products"], loaded_at))
    persist("customers_anonymized", W.gdpr_mask(customers))
    fact = persist("fact_sales", W.sales_fact(orders, customers))
    metrics = persist("product_metrics", W.product_metrics(orders, products))
    persist("daily_revenue", W.daily_revenue(fact))
    c360 = persist("customer_360", W.customer_360(fact, metrics))
    feats = W.inventory_features(metrics)
    churn_feats = W.churn_features(c360, as_of)
    if models:
        # the rows that training reads several times and the model then scores
        pairs = cut_lineage(M.demand_pairs(feats).select("product_id", "sku", *M.DEMAND_FEATURES,
                                                         "next_sold"), "demand_pairs")
        demand = M.fit_demand(pairs)
        churn_model = M.fit_churn(M.churn_snapshot(c360, M.label_cut(c360)))
        for name, model in (("demand_model", demand), ("churn_model", churn_model)):
            path = os.path.join(out_dir, "models", name)
            M.save(model, path)
            paths[name] = path
        scored = M.score_demand(M.load(paths["demand_model"]), pairs)
        churn_scored = M.score_churn(M.load(paths["churn_model"]), churn_feats)
    else:
        scored = W.given_demand(feats)
        churn_scored = W.given_churn(churn_feats)
    forecast = persist("inventory_forecast", W.inventory_forecast(scored, as_of))
    persist("catalog_enriched", W.catalog_enriched(products, forecast))
    churn = persist("churn_scores", W.churn_scores(churn_scored, scored_at=loaded_at))
    persist("marketing_segments", W.marketing_segments(c360, churn))
    return paths
