"""DuckDB text of the adapters and jobs, used as the correctness oracle.

``sql(body, *ctes)`` prefixes ``body`` with the named common table
expressions and everything they depend on, in dependency order.  The views
``region nation customer ... conversations`` are registered by the caller.
"""

from __future__ import annotations

# Fixed parameters of the oracle runs.
AS_OF = "2002-01-01"
STAMP = "2002-01-01 00:00:00"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], body: str) -> None:
    _CTES[name] = (deps, body)


def sql(body: str, *names: str, extra: tuple[tuple[str, str], ...] = (),
        recursive: bool = False) -> str:
    """``body`` prefixed with the named CTEs (and their dependencies), then
    the ``extra`` (name, text) CTEs, which may refer to all of them."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{_CTES[n][1]}\n)" for n in order]
    parts += [f"{n} AS (\n{t}\n)" for n, t in extra]
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------------- warehouse

_cte("raw_orders", (), """
SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
  CAST(CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN -l_extendedprice
            ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderstatus = 'F' THEN 'DELIVERED' WHEN o_orderstatus = 'O' THEN 'CREATED'
       WHEN o_orderkey % 2 = 0 THEN 'CANCELLED' END AS status,
  '  ' || lower(n_name) || ' ' AS country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

_cte("raw_customers", (), """
SELECT c_custkey AS customer_id, c_name AS "name", 'c' || c_custkey || '@example.com' AS email,
  '+34' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone,
  DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS signup_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'premium' WHEN 'AUTOMOBILE' THEN 'standard'
       WHEN 'MACHINERY' THEN NULL ELSE 'basic' END AS segment, n_name AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey""")

_cte("raw_products", (), """
SELECT p_partkey AS product_id,
  CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE 'SKU-' || p_partkey END AS sku, p_name AS "name",
  ' ' || lower(p_type) || '  ' || split_part(p_name, ' ', 1) || ' ' AS category,
  CASE WHEN p_partkey % 40 = 1 THEN NULL WHEN p_partkey % 40 = 2 THEN 0
       ELSE p_retailprice END AS price, p_size * 2 AS stock
FROM part""")

_cte("orders_clean", ("raw_orders",), f"""
SELECT order_id, customer_id, product_id, amount, quantity, order_date, status,
  upper(trim(country)) AS country, CAST(year(order_date) AS VARCHAR) AS "year",
  lpad(CAST(month(order_date) AS VARCHAR), 2, '0') AS "month",
  TIMESTAMP '{STAMP}' AS fecha_carga
FROM raw_orders WHERE status IS NOT NULL AND status <> 'CANCELLED' AND amount > 0""")

_cte("customers_enriched", ("raw_customers",), f"""
SELECT customer_id, "name", email, signup_date, segment, country,
  CAST(date_diff('day', signup_date, DATE '{AS_OF}') AS INTEGER) AS age_days,
  CASE WHEN segment = 'premium' THEN 'high' WHEN segment = 'standard' THEN 'medium'
       ELSE 'low' END AS ltv_segment,
  TIMESTAMP '{STAMP}' AS fecha_carga
FROM raw_customers""")

_cte("products_normalized", ("raw_products",), f"""
SELECT *, upper(regexp_replace(trim(category), '\\s+', '_', 'g')) AS category_code,
  TIMESTAMP '{STAMP}' AS fecha_carga
FROM raw_products WHERE sku IS NOT NULL AND price IS NOT NULL AND price > 0""")

_cte("fact_sales", ("orders_clean", "customers_enriched"), """
SELECT 'SF-' || CAST(o.order_id AS VARCHAR) AS sale_id, o.order_id, o.customer_id,
  o.product_id, o.amount, o.quantity, o.order_date, c.segment, c.ltv_segment, o.country,
  CAST(o."year" AS INTEGER) AS "year", CAST(o."month" AS INTEGER) AS "month"
FROM orders_clean o LEFT JOIN customers_enriched c ON o.customer_id = c.customer_id""")

_cte("product_metrics", ("orders_clean", "products_normalized"), """
SELECT o.product_id, p.sku, p."name", p.category,
  CAST(o."year" AS INTEGER) AS "year", CAST(o."month" AS INTEGER) AS "month",
  CAST(sum(o.quantity) AS BIGINT) AS total_sold,
  CAST(sum(o.amount) AS DOUBLE) AS total_revenue,
  CASE WHEN sum(o.quantity) = 0 THEN NULL
       ELSE CAST(sum(o.amount) AS DOUBLE) / CAST(sum(o.quantity) AS DOUBLE) END AS avg_price
FROM orders_clean o JOIN products_normalized p ON o.product_id = p.product_id
GROUP BY ALL""")

_cte("c360_fav_inflated", ("fact_sales", "product_metrics"), """
SELECT customer_id, "year", "month", category AS favorite_category FROM (
  SELECT customer_id, category, "year", "month", cat_qty,
    row_number() OVER (PARTITION BY customer_id, "year", "month"
                       ORDER BY cat_qty DESC, category ASC NULLS LAST) AS rn
  FROM (SELECT f.customer_id, m.category, f."year", f."month",
               CAST(sum(f.quantity) AS BIGINT) AS cat_qty
        FROM fact_sales f LEFT JOIN (SELECT product_id, category FROM product_metrics) m
          ON f.product_id = m.product_id
        GROUP BY ALL)) WHERE rn = 1""")

_cte("c360_fav_dedup", ("fact_sales", "product_metrics"), """
SELECT customer_id, "year", "month", category AS favorite_category FROM (
  SELECT customer_id, category, "year", "month", cat_qty,
    row_number() OVER (PARTITION BY customer_id, "year", "month"
                       ORDER BY cat_qty DESC, category ASC NULLS LAST) AS rn
  FROM (SELECT f.customer_id, m.category, f."year", f."month",
               CAST(sum(f.quantity) AS BIGINT) AS cat_qty
        FROM fact_sales f LEFT JOIN (SELECT DISTINCT product_id, category FROM product_metrics) m
          ON f.product_id = m.product_id
        GROUP BY ALL)) WHERE rn = 1""")

_C360_BASE = """
SELECT b.*, fav.favorite_category FROM (
  SELECT customer_id, "year", "month",
    CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
    CAST(sum(amount) AS DOUBLE) AS total_spent,
    max(order_date) AS last_order_date,
    CAST(sum(amount) AS DOUBLE) / CAST(count(amount) AS DOUBLE) AS avg_order_value
  FROM fact_sales GROUP BY ALL) b
LEFT JOIN {fav} fav USING (customer_id, "year", "month")"""

_cte("customer_360", ("fact_sales", "c360_fav_inflated"),
     _C360_BASE.format(fav="c360_fav_inflated"))
_cte("customer_360_dedup", ("fact_sales", "c360_fav_dedup"),
     _C360_BASE.format(fav="c360_fav_dedup"))

_cte("inventory_features", ("product_metrics",), """
SELECT *, avg(total_sold) OVER (PARTITION BY product_id ORDER BY "year", "month"
                                ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_avg_sold
FROM product_metrics""")

_cte("inventory_forecast", ("inventory_features",), f"""
SELECT product_id, sku, DATE '{AS_OF}' + 30 AS forecast_date,
  CAST(total_sold AS DOUBLE) AS predicted_demand, CAST(0.5 AS DOUBLE) AS confidence,
  TRY_CAST(trunc(CAST(total_sold AS DOUBLE) * CAST(1.15 AS DOUBLE)) AS INTEGER)
    AS recommended_stock
FROM inventory_features""")

_cte("churn_features", ("customer_360",), f"""
SELECT customer_id, total_orders, total_spent, avg_order_value,
  CAST(date_diff('day', last_order_date, DATE '{AS_OF}') AS INTEGER) AS days_since_last_order,
  "year", "month"
FROM customer_360""")

_cte("churn_scores", ("churn_features",), f"""
SELECT customer_id, churn_probability,
  CASE WHEN churn_probability > 0.70 THEN 'high' WHEN churn_probability > 0.40 THEN 'medium'
       ELSE 'low' END AS risk_level,
  TIMESTAMP '{STAMP}' AS predicted_at, '2.1' AS model_version
FROM (SELECT *, CAST(customer_id % 100 AS DOUBLE) / 100.0 AS churn_probability
      FROM churn_features)""")


# ------------------------------------------------------------- lineage


def _raw_name(x: str) -> str:
    return (f"CASE {x} % 4 WHEN 0 THEN 's3/lake/raw/ds_' || {x} "
            f"WHEN 1 THEN 'lake/hudi/ds_hudi_' || {x} WHEN 2 THEN 'lake/ds_' || {x} "
            f"ELSE '/lake/staging/ds_' || {x} END")


def _ns(raw: str) -> str:
    parts = f"string_split({raw}, '/')"
    return (f"CASE WHEN len({parts}) >= 3 THEN "
            f"array_to_string(({parts})[1:len({parts}) - 1], '_') ELSE '' END")


def _nm(raw: str) -> str:
    parts = f"string_split({raw}, '/')"
    return f"CASE WHEN len({parts}) >= 3 THEN ({parts})[len({parts})] ELSE {raw} END"


_cte("lin_ev", (), """
SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS event_time, user_id AS u,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
  CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL'
       WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'START' WHEN 'signup' THEN 'START' END
    AS ol_type,
  'job_etl_user_' || user_id AS job_name, 'job::shop/job_etl_user_' || user_id AS job_key
FROM events""")

_cte("lin_sight_ids", ("lin_ev",), """
SELECT seq, event_time, job_key, u, k, 0 AS io, 3 * u + k % 5 AS ds_id, CAST(NULL AS BIGINT) AS src_id
FROM lin_ev WHERE event_type IN ('view', 'click')
UNION ALL
SELECT seq, event_time, job_key, u, k, 1 AS io, 3 * u + 4 + k % 5 AS ds_id, 3 * u + k % 5
FROM lin_ev WHERE event_type = 'purchase'""")

_cte("lin_sight", ("lin_sight_ids",), f"""
SELECT *, 'dataset::' || namespace || '/' || name AS key,
  CASE WHEN lower(name) LIKE '%hudi%' THEN 'hudi' WHEN lower(name) LIKE '%delta%' THEN 'delta'
       WHEN lower(name) LIKE '%iceberg%' THEN 'iceberg'
       WHEN ds_id % 4 = 1 THEN 'hudi' ELSE 'parquet' END AS format,
  'id (bigint), value_' || (k % 3) || ' (double)' AS schema_text
FROM (SELECT *, {_ns(_raw_name('ds_id'))} AS namespace, {_nm(_raw_name('ds_id'))} AS name,
             {_nm(_raw_name('src_id'))} AS src_table
      FROM lin_sight_ids)""")

_cte("lin_datasets", ("lin_sight",), """
SELECT key, namespace, name, format, schema_text AS schema, last_seen, first_time, first_seq
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_time DESC, seq DESC, io DESC)
                  AS rn_last,
             max(event_time) OVER (PARTITION BY key) AS last_seen,
             min(event_time) OVER (PARTITION BY key) AS first_time,
             arg_min(seq, event_time) OVER (PARTITION BY key) AS first_seq
      FROM lin_sight) WHERE rn_last = 1""")

_cte("lin_jobs", ("lin_ev",), """
SELECT DISTINCT job_key AS key, 'shop' AS namespace, job_name AS name FROM lin_ev""")

_cte("lin_edges", ("lin_sight",), """
SELECT DISTINCT key AS src, job_key AS dst, 'feeds' AS relation FROM lin_sight WHERE io = 0
UNION ALL
SELECT DISTINCT job_key AS src, key AS dst, 'produces' AS relation FROM lin_sight WHERE io = 1""")

_cte("lin_nodes", ("lin_datasets", "lin_jobs"), """
SELECT key, 'dataset' AS kind, namespace, name FROM lin_datasets
UNION ALL SELECT key, 'job' AS kind, namespace, name FROM lin_jobs""")

_cte("lin_cl_rows", ("lin_sight",), """
SELECT key AS dataset_key, 'value_' || (k % 3) AS out_field, src_table,
  'value_' || ((k + 1) % 3) AS src_field, 'DIRECT' AS type,
  CASE WHEN k % 2 = 0 THEN 'IDENTITY' ELSE 'AGGREGATION' END AS subtype,
  event_time, seq, 0 AS fpos
FROM lin_sight WHERE io = 1
UNION ALL
SELECT key, 'id', src_table, 'id', 'DIRECT', 'IDENTITY', event_time, seq, 1
FROM lin_sight WHERE io = 1""")

_cte("lin_cl", ("lin_cl_rows",), """
SELECT dataset_key, out_field, src_table, src_field, type, subtype,
  event_time AS s_time, seq AS s_seq, fpos AS s_fpos,
  first_value(event_time) OVER wf AS f_time, first_value(seq) OVER wf AS f_seq,
  first_value(fpos) OVER wf AS f_fpos
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_key, out_field, src_table, src_field
                                   ORDER BY event_time, seq, fpos) AS rn
      FROM lin_cl_rows) WHERE rn = 1
WINDOW wf AS (PARTITION BY dataset_key, out_field ORDER BY event_time, seq, fpos
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")

_cte("lin_runs", ("lin_ev",), """
SELECT job_key, ol_type AS event_type, event_time, seq FROM lin_ev
WHERE ol_type IS NOT NULL AND ol_type <> '' AND event_time IS NOT NULL""")

_cte("lin_sources", ("lin_datasets", "lin_edges"), """
SELECT * FROM lin_datasets
WHERE key NOT IN (SELECT dst FROM lin_edges WHERE relation = 'produces')""")


def impact_sql(roots_sql: str, max_depth: int = 6, select: str | None = None) -> str:
    """Recursive-CTE BFS oracle over ``roots(key)``: ``impact(root_key,
    node_key, depth)`` at minimum depth, then ``select`` over it."""
    walk = f"""
  SELECT key AS root_key, key AS node_key, 0 AS d FROM roots
  UNION
  SELECT w.root_key, e.dst, w.d + 1 FROM walk w JOIN lin_edges e ON e.src = w.node_key
  WHERE w.d < {max_depth}"""
    imp = """
SELECT root_key, node_key, CAST(min(d) AS INTEGER) AS depth
FROM walk WHERE node_key <> root_key GROUP BY root_key, node_key"""
    body = select or f"""
SELECT i.root_key, i.node_key, i.depth, n.kind, n.name,
  i.depth = {max_depth} AND EXISTS (
    SELECT 1 FROM lin_edges e WHERE e.src = i.node_key AND e.dst <> i.root_key
      AND NOT EXISTS (SELECT 1 FROM impact r WHERE r.root_key = i.root_key
                      AND r.node_key = e.dst)) AS truncated
FROM impact i JOIN lin_nodes n ON n.key = i.node_key"""
    return sql(body, "lin_datasets", "lin_edges", "lin_nodes", "lin_sources",
               extra=(("roots", roots_sql), ("walk(root_key, node_key, d)", walk),
                      ("impact", imp)), recursive=True)
