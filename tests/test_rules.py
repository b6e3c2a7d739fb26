"""Unit cases for the edge rules of the warehouse jobs and lineage naming."""

import datetime as dt

from pyspark.sql import functions as F

from trellis.functions import lineage as L
from trellis.functions.scalars import is_field_name, snake_upper, tokens, upper_trim
from trellis.operators import warehouse as W


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_norm_job_name_examples(spark):
    df = spark.createDataFrame([("job_alianzas_tnpi_dim_margen",), ("ALIANZAS-tnpi_dim_margen",),
                                ("job_job_x",), ("x_job_y",)], "n string")
    got = [r[0] for r in df.select(L.norm_job_name("n")).collect()]
    assert got == ["alianzas_tnpi_dim_margen", "alianzas_tnpi_dim_margen", "job_x", "x_job_y"]


def test_dataset_path_parse(spark):
    rows = [("a/b/t",), ("a/t",), ("/a/b/t",), ("a/b/",), ("t",)]
    df = spark.createDataFrame(rows, "p string").select(
        L.dataset_ns("p").alias("ns"), L.dataset_name("p").alias("n"), L.dataset_key("p").alias("k"))
    got = [tuple(r) for r in df.collect()]
    assert got == [("a_b", "t", "dataset::a_b/t"), ("", "a/t", "dataset::/a/t"),
                   ("_a_b", "t", "dataset::_a_b/t"), ("a_b", "", "dataset::a_b/"),
                   ("", "t", "dataset::/t")]


def test_format_inference_order(spark):
    df = spark.createDataFrame(
        [("my_delta_hudi", []), ("plain", [("_hoodie_x", "s")]), ("ice_iceberg", []),
         ("plain", [("id", "bigint")])],
        "n string, f array<struct<name:string,type:string>>")
    got = [r[0] for r in df.select(L.infer_format("n", "f")).collect()]
    assert got == ["hudi", "hudi", "iceberg", "parquet"]


def test_schema_render_hides_internal_fields_and_marks_missing_type(spark):
    df = spark.createDataFrame([([("_hoodie_a", "s"), ("id", None), ("v", "double")],)],
                               "f array<struct<name:string,type:string>>")
    assert df.select(L.render_schema("f")).first()[0] == ["id (?)", "v (double)"]


def test_first_transform_empty_list_is_question_mark(spark):
    df = spark.createDataFrame([([],), ([("DIRECT", "IDENTITY")],)],
                               "t array<struct<type:string,subtype:string>>")
    got = [tuple(r) for r in df.select(L.first_transform("t", "type"),
                                       L.first_transform("t", "subtype")).collect()]
    assert got == [("?", "?"), ("DIRECT", "IDENTITY")]


def test_scalars(spark):
    assert _one(spark, upper_trim("v"), "  es\t ") == "ES\t"        # spaces only
    assert _one(spark, snake_upper("v"), " a  b\tc ") == "A_B_C"
    assert _one(spark, is_field_name("v"), "ab_1") is True
    assert _one(spark, is_field_name("v"), "a") is False
    assert _one(spark, is_field_name("v"), "Ab") is False
    assert _one(spark, tokens("v"), "Ds_Hudi-1/x y") == ["ds", "hudi", "1", "x", "y"]


def test_orders_clean_filters(spark):
    rows = [(1, "DELIVERED", "1.00"), (2, None, "1.00"), (3, "CANCELLED", "1.00"),
            (4, "cancelled", "1.00"), (5, "CREATED", "0.00"), (6, "CREATED", None)]
    df = spark.createDataFrame(rows, "order_id int, status string, amount string") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)")) \
        .withColumn("country", F.lit(" es ")).withColumn("order_date", F.lit("2001-03-04")
                                                         .cast("date"))
    out = W.orders_clean(df, loaded_at=dt.datetime(2002, 1, 1))
    got = sorted((r.order_id, r.country, r.year, r.month) for r in out.collect())
    assert got == [(1, "ES", "2001", "03"), (4, "ES", "2001", "03")]


def test_tiers_and_null_handling(spark):
    c = spark.createDataFrame([("premium",), ("standard",), ("basic",), (None,)], "segment string")
    c = c.withColumn("customer_id", F.lit(1)).withColumn("name", F.lit("n")) \
        .withColumn("email", F.lit("e")).withColumn("country", F.lit("X")) \
        .withColumn("signup_date", F.lit("2001-12-31").cast("date"))
    got = [r.ltv_segment for r in W.customers_enrich(c, "2002-01-01").collect()]
    assert got == ["high", "medium", "low", "low"]
    p = spark.createDataFrame([(0.71,), (0.70,), (0.41,), (0.40,), (None,)],
                              "churn_probability double").withColumn("customer_id", F.lit(1))
    got = [r.risk_level for r in W.churn_scores(p, dt.datetime(2002, 1, 1)).collect()]
    assert got == ["high", "medium", "medium", "low", "low"]


def test_campaign_code_skips_null_risk(spark):
    c360 = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "customer_id int, year int, month int")
    churn = spark.createDataFrame([(1, "high")], "customer_id int, risk_level string")
    got = sorted(tuple(r) for r in W.marketing_segments(c360, churn).collect())
    assert got == [(1, "high", "retention_call", "high_2024_1"),
                   (2, "unknown", "upsell_push", "2024_2")]


def test_recommended_stock_truncates_and_overflow_is_null(spark):
    df = spark.createDataFrame([(10.0,), (3.0,), (1e12,)], "predicted_demand double") \
        .withColumn("product_id", F.lit(1)).withColumn("sku", F.lit("s")) \
        .withColumn("confidence", F.lit(0.5))
    got = [r.recommended_stock for r in W.inventory_forecast(df, "2002-01-01").collect()]
    assert got == [11, 3, None]
