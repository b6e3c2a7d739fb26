"""Adapters: the driver's tables reshaped into the inputs the reference works on.

Every adapter is a plain DataFrame plan over the given tables, so its work
grows with them.  The DuckDB text of the same adapters lives in
``trellis.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .tables import table


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw/orders`` at line grain (order_id repeats)."""
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag"))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey))
    amount = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"),
                    -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    status = (F.when(F.col("o_orderstatus") == "F", "DELIVERED")
              .when(F.col("o_orderstatus") == "O", "CREATED")
              .when(F.col("o_orderkey") % 2 == 0, "CANCELLED"))
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        amount.cast("decimal(18,2)").alias("amount"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        status.alias("status"),
        F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("country"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw/customers``: every customer."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                       "c_mktsegment"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    seg = (F.when(F.col("c_mktsegment") == "BUILDING", "premium")
           .when(F.col("c_mktsegment") == "AUTOMOBILE", "standard")
           .when(F.col("c_mktsegment") == "MACHINERY", F.lit(None).cast("string"))
           .otherwise("basic"))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("name"),
                F.concat(F.lit("c"), F.col("c_custkey").cast("string"),
                         F.lit("@example.com")).alias("email"),
                F.concat(F.lit("+34"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
                .alias("phone"),
                F.date_add(F.lit("1995-01-01").cast("date"),
                           (F.col("c_custkey") % 2000).cast("int")).alias("signup_date"),
                seg.alias("segment"),
                F.col("n_name").alias("country"),
            ))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw/products``: some null SKUs, null and zero prices."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size",
                                                   "p_retailprice"))
    price = (F.when(F.col("p_partkey") % 40 == 1, F.lit(None).cast("double"))
             .when(F.col("p_partkey") % 40 == 2, F.lit(0.0))
             .otherwise(F.col("p_retailprice")))
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 50 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string"))).alias("sku"),
        F.col("p_name").alias("name"),
        F.concat(F.lit(" "), F.lower("p_type"), F.lit("  "),
                 F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit(" "))
        .alias("category"),
        price.alias("price"),
        (F.col("p_size") * 2).alias("stock"),
    )


# Fixed header texts of the spreadsheet layouts.
SHEET_HEADER = ("Campo", "Nombre", "Descripción", "Maestro")
SUMMARY_HEADER = ("Entidad", "Tipo de entidad", "Descripción", "Dataset")


def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook cells ``(workbook, sheet, sheet_idx, row_idx, col_idx, value)``:
    one workbook per region, one sheet per nation listing its suppliers as
    field rows, and a ``Resumen`` sheet of the nations.

    Even nations declare their source systems on a row above the header as
    (TIPO, MAPEO) pairs; odd nations name them inline in the header row.
    Supplier rows sit at row ``4 + s_suppkey`` (row-major order without a
    numbering window).
    """
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey",
                                               "s_acctbal")
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lower("r_name").alias("workbook"), F.col("n_name").alias("sheet"),
        F.col("n_nationkey").cast("int").alias("sheet_idx"), "n_nationkey", "n_name")
    even = F.col("n_nationkey") % 2 == 0

    def cell(row, col, value):
        return F.struct(F.lit(row).cast("int").alias("row_idx") if isinstance(row, int)
                        else row.cast("int").alias("row_idx"),
                        F.lit(col).alias("col_idx"), value.cast("string").alias("value"))

    desc = F.concat(F.lit("Proveedores de "), F.col("n_name"),
                    F.lit(" con saldo y nombre por sistema"))
    header = [cell(3, i, F.lit(v)) for i, v in enumerate(SHEET_HEADER)]
    paired_head = [cell(2, 4, F.lit("ERP")), cell(2, 6, F.lit("CRM")), cell(2, 8, F.lit("ERP"))] \
        + [cell(3, 4 + i, F.lit("TIPO" if i % 2 == 0 else "MAPEO")) for i in range(6)]
    inline_head = [cell(3, 4, F.lit("ERP")), cell(3, 5, F.lit("CRM")), cell(3, 6, F.lit("PK")),
                   cell(3, 7, F.lit("ERP")), cell(3, 8, F.lit("notas"))]
    top = nr.select("workbook", "sheet", "sheet_idx", F.explode(F.concat(
        F.array(cell(0, 0, F.col("n_name")), cell(1, 0, desc), *header),
        F.when(even, F.array(*paired_head)).otherwise(F.array(*inline_head)),
        F.array(cell(1 << 30, 0, F.lit("Notas finales"))))).alias("c"))

    sr = s.join(nr, s.s_nationkey == nr.n_nationkey)
    row = F.col("s_suppkey") + 4
    sid = F.col("s_suppkey").cast("string")
    bal = F.col("s_acctbal").cast("decimal(12,2)").cast("string")
    common = [cell(row, 0, F.concat(F.lit("supp_"), sid)), cell(row, 1, F.col("s_name")),
              cell(row, 2, F.concat(F.lit("Saldo "), bal)),
              cell(row, 3, F.when(F.col("s_acctbal") > 0, F.lit("SI")))]
    paired_vals = [cell(row, 4, F.lit("decimal")), cell(row, 5, F.lit("s_acctbal")),
                   cell(row, 6, F.when(F.col("s_suppkey") % 3 != 0, F.lit("string"))),
                   cell(row, 7, F.col("s_name")),
                   cell(row, 9, F.when(F.col("s_suppkey") % 5 == 0,
                                       F.concat(F.lit("legacy_"), sid)))]
    inline_vals = [cell(row, 4, F.lit("s_acctbal")), cell(row, 5, F.col("s_name")),
                   cell(row, 6, F.lit("x")),
                   cell(row, 7, F.when(F.col("s_suppkey") % 3 != 0,
                                       F.concat(F.lit("erp2_"), sid)))]
    body = sr.select("workbook", "sheet", "sheet_idx", F.explode(F.concat(
        F.array(*common),
        F.when(even, F.array(*paired_vals)).otherwise(F.array(*inline_vals)))).alias("c"))

    summary_rows = nr.select("workbook", F.lit("Resumen").alias("sheet"),
                             F.lit(-1).alias("sheet_idx"), F.explode(F.array(
                                 cell(F.col("n_nationkey") + 1, 0, F.col("n_name")),
                                 cell(F.col("n_nationkey") + 1, 1, F.lit("maestro")),
                                 cell(F.col("n_nationkey") + 1, 2, desc),
                                 cell(F.col("n_nationkey") + 1, 3,
                                      F.concat(F.lit("lake/suppliers_"),
                                               F.lower("n_name"))))).alias("c"))
    summary_head = (r.select(F.lower("r_name").alias("workbook"), F.lit("Resumen").alias("sheet"),
                             F.lit(-1).alias("sheet_idx"),
                             F.explode(F.array(*[cell(0, i, F.lit(v))
                                                 for i, v in enumerate(SUMMARY_HEADER)]))
                             .alias("c")))
    allc = top.unionByName(body).unionByName(summary_rows).unionByName(summary_head)
    return (allc.select("workbook", "sheet", "sheet_idx", "c.row_idx", "c.col_idx", "c.value")
            .filter(F.col("value").isNotNull()))
