"""Model surface (M01, M02): Spark ML pipelines fitted, saved, loaded and used
to score, standing in for the reference's pre-trained artefacts."""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .warehouse import churn_features

CHURN_FEATURES = ("total_orders", "total_spent", "avg_order_value", "days_since_last_order")
DEMAND_FEATURES = ("rolling_avg_sold",)
CHURN_MONTHS = 12         # training label: no order in the twelve months after the cut
DEMAND_CONFIDENCE = 0.5   # GBT gives no interval; a fixed confidence is reported


def _month() -> Column:
    return F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))


def label_cut(monthly: DataFrame, months: int = CHURN_MONTHS, back: int = 0) -> _dt.date:
    """First day of the last ``months`` months of a table by (year, month), or of
    the period of that length ``back`` periods earlier.  One row reaches the driver."""
    shift = 1 - months * (back + 1)
    return monthly.agg(F.add_months(F.max(_month()), shift).alias("cut")).first()["cut"]


def churn_snapshot(c360: DataFrame, cut: _dt.date, months: int = CHURN_MONTHS) -> DataFrame:
    """M01 features as they stood on ``cut``, with what came later as the label:
    1.0 where the customer ordered nothing in the ``months`` months from ``cut``.
    No feature reads a row of the labelled period."""
    start = F.lit(cut)
    later = (c360.where((_month() >= start) & (_month() < F.add_months(start, months)))
             .select("customer_id").distinct().withColumn("_active", F.lit(0.0)))
    return (churn_features(c360.where(_month() < start), cut)
            .join(later, "customer_id", "left")
            .withColumn("label", F.coalesce("_active", F.lit(1.0))).drop("_active"))


def demand_pairs(features: DataFrame) -> DataFrame:
    """M02 features with the units of the product's next row as ``next_sold``
    and its month as ``next_month`` (null for the last row)."""
    w = Window.partitionBy("product_id").orderBy("year", "month")
    return (features.withColumn("next_sold", F.lead("total_sold").over(w).cast("double"))
            .withColumn("next_month", F.lead(_month()).over(w)))


def fit_churn(snapshot: DataFrame, seed: int = 42, max_iter: int = 10) -> PipelineModel:
    """M01 training: GBT classifier of ``label`` on the churn features of a
    ``churn_snapshot``.  Training reads its rows several times, so they are
    written once."""
    rows = cut_lineage(snapshot.select(*CHURN_FEATURES, "label"), "churn_training")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(CHURN_FEATURES), outputCol="features",
                        handleInvalid="keep"),
        GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter, seed=seed),
    ])
    return pipe.fit(rows)


def fit_demand(pairs: DataFrame, seed: int = 42, max_iter: int = 10) -> PipelineModel:
    """M02 training: GBT regressor of the next row's units on the rolling mean,
    over the rows of ``demand_pairs`` that have a next row."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(DEMAND_FEATURES), outputCol="features",
                        handleInvalid="keep"),
        GBTRegressor(labelCol="next_sold", featuresCol="features", maxIter=max_iter,
                     seed=seed, predictionCol="predicted_demand"),
    ])
    return pipe.fit(pairs.where(F.col("next_sold").isNotNull()))


def churn_quality(model: PipelineModel, snapshot: DataFrame) -> DataFrame:
    """One row: rows, churned, auc of the model on a snapshot it was not fitted on."""
    scored = model.transform(snapshot)
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    return snapshot.agg(F.count("*").alias("rows"),
                        F.sum("label").cast("bigint").alias("churned")) \
        .withColumn("auc", F.lit(float(auc)))


def demand_quality(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """One row: rows, root mean square error of the model and of the rolling
    mean itself, over ``pairs`` it was not fitted on."""
    def error(c):
        return F.sqrt(F.avg(F.pow(F.col(c) - F.col("next_sold"), 2)))
    return model.transform(pairs.where(F.col("next_sold").isNotNull())).agg(
        F.count("*").alias("rows"), error("predicted_demand").alias("rmse"),
        error(DEMAND_FEATURES[0]).alias("rmse_rolling_mean"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_churn(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M01 scoring: ``churn_probability`` = P(class 1)."""
    out = model.transform(features)
    if "probability" not in out.columns:
        raise ValueError("churn model output has no probability column")
    return out.withColumn("churn_probability", vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def score_demand(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M02 scoring: ``predicted_demand`` and a fixed ``confidence``."""
    return (model.transform(features).withColumn("confidence", F.lit(DEMAND_CONFIDENCE))
            .drop("features"))
