"""DuckDB SQL for the registered queries, on the same parquet tables.

Each statement starts from the canonical tables as common table expressions.
"""

from __future__ import annotations

import re

from .catalog import AS_OF, BEFORE_TEST, COMPARABLE_AS_OF, CUR, PAYMENTS, PRIOR, QUARTER, TEST

ORACLE: dict[str, str] = {}


def m(e: str) -> str:
    return f"CAST({e} AS DECIMAL(18,4))"


def total(e: str) -> str:
    return f"CAST(sum({m(e)}) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) * 100.0 / nullif(CAST({b} AS DOUBLE), 0))"


def growth(a: str, b: str) -> str:
    return f"((CAST({a} AS DOUBLE) - {b}) / nullif(CAST({b} AS DOUBLE), 0) * 100.0)"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def week(e: str) -> str:
    return f"CAST(date_trunc('week', {e}) AS DATE)"


def month(e: str) -> str:
    return f"CAST(date_trunc('month', {e}) AS DATE)"


CANON = {
    "stores": """
  SELECT n_name || '|' || c_mktsegment AS store_id, n_name || '|' || c_mktsegment AS store_name, r_name AS country,
         CAST(NULL AS VARCHAR) AS city, c_mktsegment AS format, CAST(NULL AS VARCHAR) AS region,
         CAST(200 + (c_nationkey * 37 + length(c_mktsegment) * 101) % 1800 AS INTEGER) AS size_sqm,
         DATE '1994-12-01' + CAST((c_nationkey * 53 + length(c_mktsegment) * 17) % 180 AS INTEGER) AS opening_date
  FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "transactions": """
  SELECT o_orderkey AS transaction_id, n_name || '|' || c_mktsegment AS store_id,
         CASE WHEN o_custkey % 5 < 2 THEN o_custkey END AS customer_id, CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CASE WHEN o_orderstatus = 'P' THEN 'RETURNED' ELSE 'COMPLETED' END AS status,
         o_orderpriority AS payment_method, o_custkey % 5 < 2 AS loyalty_card
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "transaction_items": """
  SELECT l_orderkey * 100 + l_linenumber AS transaction_item_id, l_orderkey AS transaction_id, l_partkey AS item_id,
         l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_discount >= 0.08 AS was_on_promo
  FROM lineitem""",
    "products": """
  SELECT p_partkey AS item_id, p_name AS item_name, p_brand AS brand, p_type AS category,
         CAST(NULL AS VARCHAR) AS department,
         CASE WHEN p_size = 50 THEN CAST(-1 AS BIGINT) ELSE first_suppkey END AS vendor_id, p_retailprice AS cost
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS first_suppkey FROM lineitem GROUP BY 1)
    ON p_partkey = l_partkey""",
    "vendors": """
  SELECT s_suppkey AS vendor_id, s_name AS vendor_name, CAST(NULL AS VARCHAR) AS country,
         CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier,
         CAST(NULL AS BOOLEAN) AS is_shared_catalog
  FROM supplier""",
    "store_promotions": """
  SELECT n_name || '|' || c_mktsegment AS store_id, 'DISPLAY' AS promo_name, variant, 'EXHIBICION' AS promo_type,
         start_date, DATE '1999-08-31' AS end_date
  FROM (SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'CONTROL' ELSE 'TREATMENT' END AS variant,
               DATE '1999-03-01' AS start_date FROM customer
        UNION SELECT c_nationkey, c_mktsegment, 'TREATMENT', DATE '1999-04-01' FROM customer WHERE c_nationkey = 8)
  JOIN nation ON c_nationkey = n_nationkey""",
    "clean": """
  SELECT t.* FROM transactions t JOIN stores s USING (store_id)
  WHERE t.total_amount > 0 AND t.status = 'COMPLETED' AND t.transaction_date >= s.opening_date""",
    "base": """
  SELECT t.*, s.format, s.country, i.item_id, p.category, p.cost, i.quantity, i.quantity * i.unit_price AS revenue
  FROM clean t LEFT JOIN stores s USING (store_id) LEFT JOIN transaction_items i USING (transaction_id)
  LEFT JOIN products p ON i.item_id = p.item_id""",
    "shelf_daily": f"""
  SELECT l_suppkey AS store_id, p_brand AS item_id, CAST(l_shipdate AS DATE) AS fecha_venta,
         sum({m('l_quantity')}) AS unidades, sum({m('l_quantity * (l_extendedprice / l_quantity)')}) AS gmv_dia
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "shelf_gaps": """
  SELECT * FROM (
    SELECT store_id, item_id, CAST(lag(fecha_venta) OVER o + 1 AS DATE) AS gap_inicio,
           CAST(fecha_venta - 1 AS DATE) AS gap_fin,
           CAST(fecha_venta - lag(fecha_venta) OVER o - 1 AS INTEGER) AS duracion_dias,
           count(*) OVER p AS dias_con_venta,
           CAST(sum(unidades) OVER p AS DOUBLE) / count(*) OVER p AS avg_unidades_dia,
           CAST(sum(gmv_dia) OVER p AS DOUBLE) / count(*) OVER p AS avg_gmv_dia
    FROM shelf_daily
    WINDOW p AS (PARTITION BY store_id, item_id), o AS (PARTITION BY store_id, item_id ORDER BY fecha_venta))
  WHERE dias_con_venta >= 7 AND duracion_dias >= 3""",
    "shelf_lost": """
  SELECT g.store_id, s_name AS store_name, g.item_id, g.item_id AS item_name, category, gap_inicio, gap_fin,
         duracion_dias, avg_unidades_dia AS avg_unidades_dia_previo, avg_gmv_dia * duracion_dias AS gmv_estimado_perdido
  FROM shelf_gaps g JOIN supplier ON g.store_id = s_suppkey
  JOIN (SELECT p_brand, min(p_type) AS category FROM part GROUP BY 1) ON p_brand = g.item_id""",
    "differences": f"""
  SELECT t.transaction_id, t.store_id, {m('t.total_amount')} AS total_amount, suma_items,
         abs({m('t.total_amount')} - suma_items) AS diferencia
  FROM transactions t
  JOIN (SELECT transaction_id, sum({m('quantity * unit_price')}) AS suma_items FROM transaction_items GROUP BY 1)
    USING (transaction_id)""",
    "store_gaps": """
  SELECT store_id, gap_inicio, gap_fin, CAST(gap_fin - gap_inicio - 1 AS INTEGER) AS dias_sin_ventas
  FROM (SELECT store_id, transaction_date AS gap_fin,
               lag(transaction_date) OVER (PARTITION BY store_id ORDER BY transaction_date) AS gap_inicio
        FROM (SELECT DISTINCT store_id, transaction_date FROM transactions))
  WHERE gap_fin - gap_inicio > 1""",
    "dual": """
  SELECT store_id, promo_name, string_agg(DISTINCT variant, ' + ' ORDER BY variant) AS grupos_asignados,
         'EXCLUIR DEL AB TEST' AS accion
  FROM store_promotions GROUP BY 1, 2 HAVING count(DISTINCT variant) > 1""",
    "assign": """
  SELECT store_id, variant, promo_name FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY start_date, promo_name, variant) AS rn
    FROM store_promotions WHERE store_id NOT IN (SELECT store_id FROM dual)) WHERE rn = 1""",
    "weekly": f"""
  SELECT store_id, variant, {week('transaction_date')} AS week, {total('total_amount')} AS gmv, count(*) AS n_txn
  FROM clean JOIN assign USING (store_id)
  WHERE transaction_date BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' GROUP BY 1, 2, 3""",
    "pre_weekly": f"""
  SELECT store_id, variant, {week('transaction_date')} AS week, {total('total_amount')} AS gmv, count(*) AS n_txn
  FROM clean JOIN assign USING (store_id)
  WHERE transaction_date BETWEEN DATE '{BEFORE_TEST[0]}' AND DATE '{BEFORE_TEST[1]}' GROUP BY 1, 2, 3""",
    "store_avg": f"""
  SELECT store_id, variant, {total('gmv')} / count(*) AS avg_gmv_week, avg(n_txn) AS avg_txn_week
  FROM weekly GROUP BY 1, 2""",
    "pre_store_avg": f"""
  SELECT store_id, variant, {total('gmv')} / count(*) AS avg_gmv_week FROM pre_weekly GROUP BY 1, 2""",
    "weekly_format": f"""
  SELECT {week('transaction_date')} AS week, format, coalesce({total('revenue')}, 0.0) AS gmv FROM base GROUP BY 1, 2""",
    "pareto": f"""
  SELECT format, category, gmv, gmv / nullif(CAST(sum({m('gmv')}) OVER p AS DOUBLE), 0) * 100 AS pct,
         CAST(sum({m('gmv')}) OVER (p ORDER BY gmv DESC, category ROWS UNBOUNDED PRECEDING) AS DOUBLE)
         / nullif(CAST(sum({m('gmv')}) OVER p AS DOUBLE), 0) * 100 AS cum_pct
  FROM (SELECT format, category, coalesce({total('revenue')}, 0.0) AS gmv FROM base
        WHERE format IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2)
  WINDOW p AS (PARTITION BY format)""",
    "facts": """
  SELECT i.transaction_item_id AS fact_sale_id, transaction_id, t.transaction_date AS date_id, store_id,
         i.item_id AS product_id, t.customer_id,
         CASE WHEN t.transaction_date BETWEEN start_date AND end_date THEN pr.promo_id END AS promo_id, i.quantity, i.unit_price, p.cost AS unit_cost,
         i.quantity * i.unit_price AS gross_revenue, i.quantity * i.unit_price - i.quantity * p.cost AS gross_margin,
         i.was_on_promo, t.status = 'RETURNED' AS is_returned
  FROM transaction_items i LEFT JOIN transactions t USING (transaction_id) LEFT JOIN products p USING (item_id)
  LEFT JOIN (SELECT * FROM (
      SELECT store_id, start_date, end_date,
             sha256(store_id || '|' || promo_name || '|' || variant || '|' || start_date) AS promo_id,
             row_number() OVER (PARTITION BY store_id ORDER BY start_date, promo_name, variant) AS rn
      FROM store_promotions) WHERE rn = 1) pr
    USING (store_id)""",
    "dim_store": f"""
  SELECT store_id, store_name, country, city, format, region, size_sqm, opening_date,
         CAST(opening_date + INTERVAL 13 MONTH AS DATE) <= DATE '{COMPARABLE_AS_OF}' AS is_comparable
  FROM stores""",
    "loyal": f"""
  SELECT customer_id, store_id, transaction_date, total_amount, status, {month('transaction_date')} AS mon,
         {month('min(transaction_date) OVER (PARTITION BY customer_id)')} AS cohort,
         first_value(store_id) OVER (PARTITION BY customer_id ORDER BY transaction_date, store_id) AS home
  FROM transactions WHERE loyalty_card AND customer_id IS NOT NULL""",
    "loyal_clean": f"""
  SELECT customer_id, {month('transaction_date')} AS mon,
         {month('min(transaction_date) OVER (PARTITION BY customer_id)')} AS cohort
  FROM clean WHERE loyalty_card AND customer_id IS NOT NULL""",
}


def _uses(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def add(name: str, body: str) -> None:
    """Register a statement with the common tables it uses, directly or through others."""
    needed, text = [], body
    for cte in reversed(list(CANON)):
        if _uses(text, cte):
            needed.append(cte)
            text += CANON[cte]
    head = ",\n".join(f"{cte} AS ({CANON[cte]})" for cte in reversed(needed))
    ORACLE[name] = f"WITH {head}\n{body}" if needed else body


N_PCT = pct("count(*) FILTER (WHERE {0})", "count(*)").format
DONE = "status = 'COMPLETED'"


# --- sources, sinks, base tables -------------------------------------------------------------------------

add("load_tables", """
SELECT CAST(t.transaction_id AS VARCHAR) AS transaction_id, store_id, CAST(customer_id AS VARCHAR) AS customer_id,
       transaction_date, CAST(total_amount AS DOUBLE) AS total_amount, status, payment_method, loyalty_card,
       CAST(units AS BIGINT) AS units
FROM transactions t LEFT JOIN (SELECT transaction_id, sum(CAST(quantity AS INTEGER)) AS units
                               FROM transaction_items GROUP BY 1) i USING (transaction_id)""")
add("register_views", """
SELECT s.country, t.status, count(*) AS n, CAST(sum(t.total_amount) AS DOUBLE) AS gmv
FROM transactions t JOIN stores s USING (store_id) GROUP BY 1, 2""")
add("table_row_counts", """
SELECT 'transactions' AS tabla, count(*) AS filas, 8 AS columnas FROM transactions
UNION ALL SELECT 'transaction_items', count(*), 6 FROM transaction_items
UNION ALL SELECT 'stores', count(*), 8 FROM stores
UNION ALL SELECT 'products', count(*), 7 FROM products
UNION ALL SELECT 'vendors', count(*), 5 FROM vendors
UNION ALL SELECT 'store_promotions', count(*), 6 FROM store_promotions""")
add("clean_transactions", "SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM clean")
add("excluded_rows", """
SELECT 'transactions' AS tabla, CAST(transaction_id AS VARCHAR) AS row_id, motivo FROM (
  SELECT transaction_id, unnest([CASE WHEN total_amount <= 0 THEN 'monto_invalido' END,
    CASE WHEN s.store_id IS NULL THEN 'tienda_huerfana' END,
    CASE WHEN transaction_date < opening_date THEN 'pre_apertura' END]) AS motivo
  FROM transactions t LEFT JOIN stores s ON t.store_id = s.store_id) WHERE motivo IS NOT NULL
UNION ALL SELECT 'transaction_items', CAST(transaction_item_id AS VARCHAR), 'precio_cero_sin_promo'
FROM transaction_items WHERE unit_price = 0 AND NOT was_on_promo""")
add("sales_base", """
SELECT transaction_id, store_id, transaction_date, format, country, item_id, category, cost, quantity, revenue
FROM base""")
add("write_result", "SELECT * FROM weekly_format")
add("write_partitioned", f"""
SELECT {month('date_id')} AS month_id, count(*) AS lines, {total('gross_revenue')} AS revenue FROM facts GROUP BY 1""")
for _name, _gmv in (
    ("analysis_summary", f"(SELECT {total('revenue')} FROM base)"), ("analysis_summary_headers", total("total_amount")),
):
    add(_name, f"""
SELECT count(*) AS total_tx, {_gmv} AS total_gmv, {N_PCT('loyalty_card')} AS loyalty_rate,
       string_agg(DISTINCT country, ',' ORDER BY country) AS countries,
       string_agg(DISTINCT format, ',' ORDER BY format) AS formats
FROM clean LEFT JOIN stores USING (store_id)""")

# --- data-quality audit ----------------------------------------------------------------------------------

COMPLETENESS = f"""
SELECT count(*) AS total_transacciones, count(*) FILTER (WHERE customer_id IS NULL) AS sin_customer_id,
       {N_PCT('customer_id IS NULL')} AS pct_sin_customer, count(*) FILTER (WHERE NOT loyalty_card) AS loyalty_false,
       count(*) FILTER (WHERE loyalty_card) AS loyalty_true, {N_PCT('NOT loyalty_card')} AS pct_sin_lealtad,
       {N_PCT('loyalty_card')} AS pct_con_lealtad,
       abs(count(*) FILTER (WHERE customer_id IS NULL) - count(*) FILTER (WHERE NOT loyalty_card)) AS diferencia
FROM transactions"""
HEADER_LINES = f"""
SELECT count(*) AS transacciones_comparadas, count(*) FILTER (WHERE diferencia > 0.02) AS con_discrepancia,
       {N_PCT('diferencia > 0.02')} AS pct_discrepancia, CAST(max(diferencia) AS DOUBLE) AS diferencia_maxima,
       CAST(sum(diferencia) FILTER (WHERE diferencia > 0.02) AS DOUBLE)
         / count(*) FILTER (WHERE diferencia > 0.02) AS diferencia_promedio,
       quantile_cont(CAST(diferencia AS DOUBLE), 0.5) FILTER (WHERE diferencia > 0.02) AS diferencia_mediana
FROM differences"""
AMOUNTS = """
SELECT count(*) FILTER (WHERE total_amount <= 0) AS montos_invalidos,
       count(*) FILTER (WHERE total_amount < 0) AS montos_negativos,
       count(*) FILTER (WHERE total_amount = 0) AS montos_cero,
       CAST(min(total_amount) AS DOUBLE) AS minimo, CAST(max(total_amount) AS DOUBLE) AS maximo FROM transactions"""
ZERO_PRICE = f"""
SELECT count(*) FILTER (WHERE unit_price = 0) AS precio_cero_total,
       count(*) FILTER (WHERE unit_price = 0 AND NOT was_on_promo) AS precio_cero_sin_promo,
       count(*) FILTER (WHERE unit_price = 0 AND was_on_promo) AS precio_cero_con_promo,
       {N_PCT('unit_price = 0')} AS pct_precio_cero FROM transaction_items"""
GAP_SUMMARY = """
SELECT count(*) AS gaps, count(DISTINCT store_id) AS tiendas_con_gaps, max(dias_sin_ventas) AS gap_maximo,
       count(*) FILTER (WHERE dias_sin_ventas > 6) AS gaps_mayores_6 FROM store_gaps"""
PRE_OPENING = """
SELECT t.store_id, opening_date, min(transaction_date) AS primera_tx, count(*) AS tx_antes_apertura
FROM transactions t JOIN stores s ON t.store_id = s.store_id WHERE transaction_date < opening_date GROUP BY 1, 2"""
PRE_TOTALS = f"""
SELECT CAST(coalesce(sum(tx_antes_apertura), 0) AS BIGINT) AS transacciones_pre_apertura,
       count(*) AS tiendas_afectadas FROM ({PRE_OPENING})"""


def orphans(child: str, parent: str, fk: str, name: str) -> str:
    return f"""
SELECT c.{fk}, count(*) AS {name} FROM {child} c LEFT JOIN {parent} p ON c.{fk} = p.{fk}
WHERE p.{fk} IS NULL GROUP BY 1"""


add("audit_completeness", COMPLETENESS)
add("audit_header_vs_lines", HEADER_LINES)
add("audit_top_discrepancies", """
SELECT transaction_id, store_id, CAST(total_amount AS DOUBLE) AS total_amount, CAST(suma_items AS DOUBLE) AS suma_items,
       CAST(diferencia AS DOUBLE) AS diferencia
FROM differences WHERE diferencia > 0.02 ORDER BY differences.diferencia DESC, transaction_id LIMIT 5""")
UNIQUE = """
SELECT 'transactions' AS tabla, count(*) AS total_filas, count(DISTINCT transaction_id) AS ids_unicos,
       count(*) - count(DISTINCT transaction_id) AS duplicados,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT transaction_id FROM transactions)) AS duplicados_con_nulos
FROM transactions
UNION ALL SELECT 'tx_items', count(*), count(DISTINCT transaction_item_id),
       count(*) - count(DISTINCT transaction_item_id),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT transaction_item_id FROM transaction_items))
FROM transaction_items"""
add("audit_uniqueness", UNIQUE)
add("audit_duplicate_keys", """
SELECT transaction_item_id, count(*) AS veces FROM transaction_items GROUP BY 1 HAVING count(*) > 1
ORDER BY veces DESC, transaction_item_id LIMIT 10""")
add("dedupe_keep_last", """
SELECT transaction_item_id, sale_day, item_id, vendor_id, quantity, revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_item_id
                               ORDER BY sale_day DESC, item_id DESC, vendor_id DESC, quantity DESC, revenue DESC) AS rn
  FROM (SELECT l_orderkey * 100 + l_linenumber AS transaction_item_id, CAST(l_shipdate AS DATE) AS sale_day,
               l_partkey AS item_id, l_suppkey AS vendor_id, l_quantity AS quantity, l_extendedprice AS revenue
        FROM lineitem)) WHERE rn = 1""")
add("audit_amount_validity", AMOUNTS)
add("audit_invalid_rows", """
SELECT transaction_id, store_id, transaction_date, CAST(total_amount AS DOUBLE) AS total_amount, status, payment_method
FROM transactions WHERE total_amount <= 0""")
add("audit_zero_price", ZERO_PRICE)
add("audit_orphans", orphans("products", "vendors", "vendor_id", "productos_afectados"))
add("audit_orphan_stores", orphans("transactions", "stores", "store_id", "transacciones_huerfanas"))
add("audit_sales_gaps", """
SELECT *, CASE WHEN dias_sin_ventas BETWEEN 3 AND 7 THEN 'REVISAR' WHEN dias_sin_ventas BETWEEN 8 AND 14 THEN 'ALERTA'
               WHEN dias_sin_ventas > 14 THEN 'CRITICO' END AS severidad
FROM store_gaps WHERE dias_sin_ventas >= 3""")
add("audit_gap_summary", GAP_SUMMARY)
add("audit_pre_opening", PRE_OPENING)
add("audit_pre_opening_totals", PRE_TOTALS)
add("audit_dual_assignment", "SELECT * FROM dual")
add("audit_assignment_overlap", """
SELECT a.store_id, bool_or(a.start_date <= b.end_date AND b.start_date <= a.end_date) AS se_solapan,
       min(CASE WHEN a.start_date <= b.end_date AND b.start_date <= a.end_date
                THEN greatest(a.start_date, b.start_date) END) AS solape_desde
FROM store_promotions a JOIN store_promotions b USING (store_id)
WHERE a.variant = 'CONTROL' AND b.variant = 'TREATMENT' GROUP BY 1""")
add("audit_variant_sizes", """
SELECT variant, count(DISTINCT store_id) AS tiendas FROM store_promotions
WHERE store_id NOT IN (SELECT store_id FROM dual) GROUP BY 1""")
add("audit_scorecard", f"""
SELECT {N_PCT('customer_id IS NULL')} AS pct_sin_customer_id, {N_PCT('loyalty_card')} AS pct_con_lealtad,
       count(*) FILTER (WHERE total_amount <= 0) AS montos_invalidos,
       count(*) FILTER (WHERE status <> 'COMPLETED') AS transacciones_no_completadas,
       count(*) - count(DISTINCT transaction_id) AS transaction_id_duplicados,
       min(transaction_date) AS fecha_minima, max(transaction_date) AS fecha_maxima,
       count(DISTINCT store_id) AS tiendas_activas
FROM transactions""")


def long(dimension: str, statement: str, columns: list[str], prefix: str = "") -> str:
    cells = ", ".join(f"{{'k': '{prefix}{c}', 'v': CAST({c} AS DOUBLE)}}" for c in columns)
    return f"SELECT '{dimension}' AS dimension, unnest([{cells}]) AS c FROM ({statement})"


def orphan_totals(child: str, parent: str, fk: str) -> str:
    return f"""SELECT count(*) AS valores, CAST(coalesce(sum(n), 0) AS BIGINT) AS filas
FROM ({orphans(child, parent, fk, 'n')})"""


FINDINGS = [
    long("Completitud", COMPLETENESS, [
        "total_transacciones", "sin_customer_id", "pct_sin_customer", "loyalty_false", "loyalty_true",
        "pct_sin_lealtad", "pct_con_lealtad", "diferencia"]),
    long("Consistencia", HEADER_LINES, [
        "transacciones_comparadas", "con_discrepancia", "pct_discrepancia", "diferencia_maxima",
        "diferencia_promedio", "diferencia_mediana"]),
    f"""SELECT 'Unicidad' AS dimension,
  {{'k': 'duplicados_' || replace(tabla, 'tx_items', 'transaction_items'),
    'v': CAST(duplicados_con_nulos AS DOUBLE)}} AS c FROM ({UNIQUE})""",
    long("Validez", AMOUNTS, ["montos_invalidos", "montos_negativos", "montos_cero", "minimo", "maximo"]),
    long("Validez", ZERO_PRICE, [
        "precio_cero_total", "precio_cero_sin_promo", "precio_cero_con_promo", "pct_precio_cero"]),
    long("Integridad Referencial", orphan_totals("transactions", "stores", "store_id"), ["valores", "filas"], "store_id_"),
    long("Integridad Referencial", orphan_totals("products", "vendors", "vendor_id"), ["valores", "filas"], "vendor_id_"),
    long("Integridad Referencial", orphan_totals("transaction_items", "products", "item_id"), ["valores", "filas"],
         "item_id_"),
    long("Frescura", GAP_SUMMARY, ["gaps", "tiendas_con_gaps", "gap_maximo", "gaps_mayores_6"]),
    long("Integridad Temporal", PRE_TOTALS, ["transacciones_pre_apertura", "tiendas_afectadas"]),
    long("A/B Test", "SELECT count(*) AS asignaciones_dobles FROM dual", ["asignaciones_dobles"]),
]
add("audit_findings", """
SELECT dimension, c.k AS metrica, c.v AS valor, CASE WHEN severity IS NOT NULL AND c.v = 0 THEN 'Limpio' ELSE severity END AS severidad,
  CASE WHEN c.v = 0 THEN NULL WHEN c.k LIKE 'duplicados%' THEN 'CONSERVAR ULTIMO' WHEN severity = 'Normal' THEN 'ACEPTAR'
       WHEN c.k = 'con_discrepancia' THEN 'ALERTA' WHEN c.k = 'gaps_mayores_6' THEN 'INVESTIGAR'
       WHEN severity IS NOT NULL THEN 'EXCLUIR' END AS decision
FROM (SELECT *, CASE
    WHEN c.k IN ('sin_customer_id', 'diferencia') THEN 'Normal'
    WHEN c.k IN ('con_discrepancia', 'precio_cero_sin_promo', 'gaps_mayores_6') OR c.k LIKE '%_id_filas' THEN 'Media'
    WHEN c.k LIKE 'duplicados%' OR c.k LIKE 'montos%' OR c.k = 'transacciones_pre_apertura' THEN 'Alta'
    WHEN dimension = 'A/B Test' THEN 'Crítica' END AS severity
FROM (""" + "\nUNION ALL ".join(FINDINGS) + "))")

# --- business queries ------------------------------------------------------------------------------------


def between(day: str, period) -> str:
    return f"{day} BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


SOLD = f"""(SELECT store_id, {total('total_amount')} AS gmv, count(*) AS n FROM transactions
       WHERE {DONE} AND {between('transaction_date', CUR)} GROUP BY 1)"""

add("q1_comp_sales", f"""
SELECT *, CAST(rank() OVER (PARTITION BY format ORDER BY comp_sales_pct DESC) AS INTEGER) AS rank_en_formato FROM (
  SELECT store_id, store_name, country, format, gmv_actual, gmv_anterior,
         {growth('gmv_actual', 'gmv_anterior')} AS comp_sales_pct
  FROM stores
  JOIN (SELECT store_id, {total('total_amount')} AS gmv_actual FROM transactions
        WHERE {DONE} AND {between('transaction_date', CUR)} GROUP BY 1) USING (store_id)
  JOIN (SELECT store_id, {total('total_amount')} AS gmv_anterior FROM transactions
        WHERE {DONE} AND {between('transaction_date', PRIOR)} GROUP BY 1) USING (store_id)
  WHERE opening_date < DATE '{PRIOR[0]}' AND gmv_actual > 0 AND gmv_anterior > 0)""")
add("q2_sqm_productivity", f"""
SELECT store_id, store_name, country, format, size_sqm, gmv_total, ticket_promedio, gmv_por_m2, txn_por_m2,
       CAST(rank() OVER (PARTITION BY format ORDER BY gmv_por_m2 DESC) AS INTEGER) AS rank_en_formato,
       CASE WHEN gmv_por_m2 < quantile_cont(gmv_por_m2, 0.25) OVER (PARTITION BY format)
            THEN 'BAJO_RENDIMIENTO' ELSE 'OK' END AS estado
FROM (SELECT s.*, gmv_total, ticket_promedio, {ratio('gmv_total', 'size_sqm')} AS gmv_por_m2,
             {ratio('n', 'size_sqm')} AS txn_por_m2
      FROM stores s JOIN (SELECT store_id, {total('total_amount')} AS gmv_total, count(*) AS n,
                                 {total('total_amount')} / count(*) AS ticket_promedio FROM transactions
                          WHERE {DONE} AND {between('transaction_date', QUARTER)} GROUP BY 1) USING (store_id))""")

OFFSET = "(year(mon) * 12 + month(mon) - year(cohort) * 12 - month(cohort))"
COHORT = f"""(SELECT cohort, {OFFSET} AS k, count(DISTINCT customer_id) AS customers,
                     {total('total_amount')} / count(total_amount) AS ticket
              FROM loyal WHERE {DONE} GROUP BY 1, 2)"""
add("q3_cohort_retention", f"""
SELECT c.cohort AS cohorte_mes, n AS tamano_cohorte, max(CASE WHEN k = 0 THEN ticket END) AS ticket_m0,
       """ + ",\n       ".join(
    f"{pct(f'max(CASE WHEN k = {k} THEN customers END)', 'n')} AS ret_m{k}_pct, "
    f"max(CASE WHEN k = {k} THEN ticket END) AS ticket_m{k}" for k in (1, 2, 3, 6)) + f"""
FROM (SELECT cohort, count(DISTINCT customer_id) AS n FROM loyal GROUP BY 1) c LEFT JOIN {COHORT} r USING (cohort)
GROUP BY c.cohort, n""")
add("q4_gmroi", f"""
SELECT vendor_id, vendor_name, vendor_tier, category, gmv, costo_total, skus_activos, gmv - costo_total AS margen_bruto,
       (gmv - costo_total) / nullif(costo_total, 0) AS gmroi, units / span AS velocidad_venta_dia,
       CASE WHEN (gmv - costo_total) / nullif(costo_total, 0) < 1 THEN 'ALERTA_GMROI<1' ELSE 'OK' END AS alerta
FROM (SELECT vendor_id, vendor_name, tier AS vendor_tier, category, {total('quantity * unit_price')} AS gmv,
             {total('quantity * cost')} AS costo_total, {total('quantity')} AS units,
             count(DISTINCT item_id) AS skus_activos
      FROM transaction_items JOIN transactions USING (transaction_id) JOIN products USING (item_id)
      JOIN vendors USING (vendor_id) WHERE {DONE} GROUP BY 1, 2, 3, 4),
     (SELECT CAST(max(transaction_date) - min(transaction_date) + 1 AS DOUBLE) AS span FROM transactions)""")
TOP_LOST = "SELECT * FROM shelf_lost ORDER BY gmv_estimado_perdido DESC, store_id, item_id, gap_inicio LIMIT 200"
add("q5_stockouts", TOP_LOST)
add("q5_stockouts_all", "SELECT * FROM shelf_lost")
add("q5_stockouts_calendar", TOP_LOST)
add("q5_stockout_totals", """
SELECT count(*) AS total_gaps, round(sum(avg_gmv_dia * duracion_dias), 0) AS total_lost_gmv FROM shelf_gaps""")
add("q6_promo_uplift", f"""
SELECT *, ticket_con_promo - ticket_sin_promo AS ticket_uplift_abs,
       (ticket_con_promo / nullif(ticket_sin_promo, 0) - 1) * 100 AS ticket_uplift_pct,
       uds_por_txn_con_promo - uds_por_txn_sin_promo AS basket_uplift_uds
FROM (SELECT category, max(CASE WHEN NOT promo THEN n END) AS txn_sin_promo,
             max(CASE WHEN NOT promo THEN ticket END) AS ticket_sin_promo,
             max(CASE WHEN NOT promo THEN uds END) AS uds_por_txn_sin_promo,
             max(CASE WHEN promo THEN n END) AS txn_con_promo, max(CASE WHEN promo THEN ticket END) AS ticket_con_promo,
             max(CASE WHEN promo THEN uds END) AS uds_por_txn_con_promo
      FROM (SELECT category, promo, count(DISTINCT transaction_id) AS n, {total('total_amount')} / count(*) AS ticket,
                   {total('quantity')} / count(DISTINCT transaction_id) AS uds
            FROM transaction_items JOIN transactions USING (transaction_id) JOIN products USING (item_id)
            JOIN (SELECT transaction_id, bool_or(was_on_promo) AS promo FROM transaction_items GROUP BY 1)
              USING (transaction_id)
            WHERE {DONE} GROUP BY 1, 2) GROUP BY 1)""")
add("period_total", f"SELECT * FROM {SOLD}")
add("comparable_stores", "SELECT store_id, opening_date FROM stores WHERE opening_date < DATE '1995-02-15'")
add("rank_within", f"""
SELECT store_id, gmv, n, format, CAST(rank() OVER (PARTITION BY format ORDER BY gmv DESC) AS INTEGER) AS puesto
FROM {SOLD} JOIN stores USING (store_id)""")
add("below_percentile_flag", f"""
SELECT store_id, gmv, n, format, CASE WHEN gmv < quantile_cont(gmv, 0.25) OVER (PARTITION BY format)
       THEN 'BAJO_RENDIMIENTO' ELSE 'OK' END AS estado
FROM {SOLD} JOIN stores USING (store_id)""")
add("islands", """
SELECT store_id, min(transaction_date) AS run_start, max(transaction_date) AS run_end, count(*) AS run_days FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR transaction_date - prev > 1 THEN 1 ELSE 0 END)
            OVER (PARTITION BY store_id ORDER BY transaction_date) AS g
  FROM (SELECT *, lag(transaction_date) OVER (PARTITION BY store_id ORDER BY transaction_date) AS prev
        FROM (SELECT DISTINCT store_id, transaction_date FROM transactions))) GROUP BY store_id, g""")
add("pivot_metrics", f"""
SELECT store_id, nullif(count(*) FILTER (WHERE {DONE}), 0) AS n_done,
       CAST(sum({m('total_amount')}) FILTER (WHERE {DONE}) AS DOUBLE) AS gmv_done,
       nullif(count(*) FILTER (WHERE status = 'RETURNED'), 0) AS n_returned,
       CAST(sum({m('total_amount')}) FILTER (WHERE status = 'RETURNED') AS DOUBLE) AS gmv_returned
FROM transactions GROUP BY 1""")
add("any_flag_per_group", """
SELECT transaction_id, max(CAST(was_on_promo AS INTEGER)) AS tuvo_promo FROM transaction_items GROUP BY 1""")
add("exact_quantile", """
SELECT status, quantile_cont(CAST(total_amount AS DOUBLE), 0.9) AS p90 FROM transactions GROUP BY 1""")

# --- exploration -----------------------------------------------------------------------------------------

add("p1_weekly_gmv", "SELECT * FROM weekly_format")
add("p1_peaks_troughs", """
SELECT format, week, gmv, 'PICO' AS tipo, CAST(o AS INTEGER) AS orden FROM (
  SELECT *, row_number() OVER (PARTITION BY format ORDER BY gmv DESC, week) AS o FROM weekly_format) WHERE o <= 3
UNION ALL SELECT format, week, gmv, 'CAIDA', CAST(o AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY format ORDER BY gmv, week) AS o FROM weekly_format) WHERE o <= 3""")
add("p1_seasonality", """
SELECT format, round(cv, 6) AS cv, CAST(rank() OVER (ORDER BY cv DESC) AS INTEGER) AS rank_estacionalidad
FROM (SELECT format, stddev_samp(gmv) / avg(gmv) AS cv FROM weekly_format GROUP BY 1)""")
# Trend, sine and cosine by regressions on what the ones before leave over, row by row.
add("p1_seasonal_strength", """
SELECT * FROM (WITH w AS (SELECT format, CAST(gmv AS DOUBLE) AS y, (week - DATE '1970-01-01') / 7 AS t,
                  cos(2 * pi() * (week - DATE '1970-01-01') / 365.25) AS c,
                  sin(2 * pi() * (week - DATE '1970-01-01') / 365.25) AS s FROM weekly_format),
line AS (SELECT format, count(*) AS semanas, avg(t) AS mt, avg(y) AS my, avg(c) AS mc, avg(s) AS ms,
                regr_slope(y, t) AS ry, regr_slope(c, t) AS rc, regr_slope(s, t) AS rs FROM w GROUP BY 1),
flat AS (SELECT format, semanas, ry, rc, rs, y - my - ry * (t - mt) AS y, c - mc - rc * (t - mt) AS c,
                s - ms - rs * (t - mt) AS s FROM w JOIN line USING (format)),
sine AS (SELECT format, sum(c * s) / sum(c * c) AS sc, sum(c * y) / sum(c * c) AS yc FROM flat GROUP BY 1),
fit AS (SELECT format, semanas, ry, rc, rs, yc - sc * sum((y - yc * c) * (s - sc * c)) / sum((s - sc * c) ** 2) AS kc,
               sum((y - yc * c) * (s - sc * c)) / sum((s - sc * c) ** 2) AS ks
        FROM flat JOIN sine USING (format) GROUP BY format, semanas, ry, rc, rs, yc, sc),
done AS (SELECT format, semanas, ry - kc * rc - ks * rs AS tendencia, sqrt(kc * kc + ks * ks) AS amplitud,
                atan2(ks, kc) / (2 * pi()) AS turn, 1 - sum((y - kc * c - ks * s) ** 2) / sum(y * y) AS fuerza
         FROM flat JOIN fit USING (format, semanas, ry, rc, rs)
         GROUP BY format, semanas, ry, rc, rs, kc, ks)
SELECT format, semanas, round(tendencia, 3) AS tendencia, round(amplitud, 3) AS amplitud,
       round((turn - floor(turn)) * 365.25, 4) AS dia_pico, round(fuerza, 6) AS fuerza,
       CAST(rank() OVER (ORDER BY fuerza DESC) AS INTEGER) AS rank_fuerza FROM done)""")
add("p2_pareto", "SELECT * FROM pareto")
add("p2_pareto_core", "SELECT * FROM pareto WHERE cum_pct - pct < 80")


def matrix(offset: str) -> str:
    cells = ", ".join(f"coalesce({pct(f'max(CASE WHEN k = {k} THEN customers END)', 'n')}, 0.0) AS m{k}"
                      for k in range(7))
    return f"""
SELECT cohort, {cells}
FROM (SELECT cohort, {offset} AS k, count(DISTINCT customer_id) AS customers FROM loyal_clean GROUP BY 1, 2)
JOIN (SELECT cohort, count(DISTINCT customer_id) AS n FROM loyal_clean GROUP BY 1) USING (cohort)
WHERE cohort NOT IN (SELECT DISTINCT cohort FROM loyal_clean ORDER BY cohort DESC LIMIT 2)
GROUP BY cohort, n"""


add("p3_cohort_matrix", matrix(OFFSET))
ORACLE["p3_cohort_matrix_bits"] = ORACLE["p3_cohort_matrix"]
add("p3_cohort_matrix_days30", matrix("((mon - cohort) // 30)"))
add("p4_sales_daily", f"""
SELECT store_id, item_id, category, transaction_date AS fecha, {total('revenue')} AS revenue FROM base
WHERE store_id IS NOT NULL AND item_id IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2, 3, 4""")
ROTATION = f"""(SELECT store_id, item_id, category, count(*) AS dias, {total('gmv_dia')} AS gmv
      FROM shelf_daily JOIN (SELECT p_brand, min(p_type) AS category FROM part GROUP BY 1) ON p_brand = item_id
      GROUP BY 1, 2, 3)"""
for _name, _part in (("p4_low_rotation", ""), ("p4_low_rotation_by_store", "PARTITION BY store_id, category")):
    add(_name, f"""
SELECT category, count(*) AS sku_oos, {total('gmv')} AS gmv_perdido_est
FROM (SELECT *, CAST(sum(dias) OVER ({_part}) AS DOUBLE) / count(*) OVER ({_part}) AS usual FROM {ROTATION})
WHERE dias < usual * 0.9 GROUP BY 1""")
add("p5_payment_mix", "SELECT country, " + ", ".join(
    N_PCT(f"payment_method = '{v}'") + f" AS pct_{k}" for k, v in PAYMENTS.items()) + """
FROM clean JOIN stores USING (store_id) WHERE payment_method IS NOT NULL GROUP BY 1""")

# --- A/B test --------------------------------------------------------------------------------------------


SIMPSON = "CASE WHEN k = 0 OR k = 400 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"


def integral(point: str, lower: str, upper: str) -> str:
    """Simpson's rule with 400 steps; ``point`` is a function of x."""
    step = f"(({upper} - {lower}) / 400)"
    here = re.sub(r"\bx\b", f"({lower} + {step} * k)", point)
    return f"(list_sum(list_transform(range(0, 401), lambda k: {SIMPSON} * {here})) * {step} / 3)"


def beta_series(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function for ``x`` up to 1/2, by its series of positive terms."""
    scale = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}))"
    term = (f"exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) "
            f"+ k * ln({x}))")
    return f"({scale} * list_sum(list_transform(range(0, 200), lambda k: {term})))"


def student_p(t: str, df: str) -> str:
    """Two-sided p-value: the incomplete beta function at df / (df + t^2)."""
    x = f"({df} / ({df} + pow({t}, 2)))"
    return f"""(CASE WHEN {t} = 0 THEN 1.0 WHEN {x} <= 0.5 THEN {beta_series(x, f'({df} / 2)', '0.5')}
        ELSE 1 - {beta_series(f'(1 - {x})', '0.5', f'({df} / 2)')} END)"""


def welch(source: str, by: str = "") -> str:
    """Unrounded Welch statistics of ``avg_gmv_week`` in ``source``."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(
SELECT {keys}n_control, n_treatment, mean_control, mean_treatment, diff_abs,
       diff_abs / nullif(mean_control, 0) * 100 AS lift_pct, se, t_stat, df,
       CASE WHEN df IS NOT NULL THEN {student_p('t_stat', 'df')} END AS p_value
FROM (
  SELECT *, mean_treatment - mean_control AS diff_abs, sqrt(pc + pt) AS se,
         (mean_treatment - mean_control) / nullif(sqrt(pc + pt), 0) AS t_stat,
         pow(pc + pt, 2) / nullif(pow(pc, 2) / (n_control - 1) + pow(pt, 2) / (n_treatment - 1), 0) AS df
  FROM (SELECT *, CASE WHEN n_control > 1 AND n_treatment > 1 THEN vc / n_control END AS pc,
               CASE WHEN n_control > 1 AND n_treatment > 1 THEN vt / n_treatment END AS pt
    FROM (SELECT {keys}count(*) FILTER (WHERE variant = 'CONTROL') AS n_control,
                 count(*) FILTER (WHERE variant = 'TREATMENT') AS n_treatment,
                 avg(avg_gmv_week) FILTER (WHERE variant = 'CONTROL') AS mean_control,
                 avg(avg_gmv_week) FILTER (WHERE variant = 'TREATMENT') AS mean_treatment,
                 var_samp(avg_gmv_week) FILTER (WHERE variant = 'CONTROL') AS vc,
                 var_samp(avg_gmv_week) FILTER (WHERE variant = 'TREATMENT') AS vt
          FROM {source} {group}))))"""


WELCH_OUT = """n_control, n_treatment, round(mean_control, 4) AS mean_control, round(mean_treatment, 4) AS mean_treatment,
       round(diff_abs, 4) AS diff_abs, round(lift_pct, 4) AS lift_pct, round(se, 4) AS se, round(t_stat, 6) AS t_stat,
       round(df, 4) AS df, round(p_value, 6) AS p_value"""

add("ab_assign", "SELECT * FROM assign")
add("ab_weekly", "SELECT * FROM weekly")
add("ab_weekly_full_weeks", f"""
SELECT store_id, variant, {week('transaction_date')} AS week, {total('total_amount')} AS gmv, count(*) AS n_txn
FROM clean JOIN assign USING (store_id)
WHERE transaction_date BETWEEN DATE '1999-03-08' AND DATE '1999-08-22' GROUP BY 1, 2, 3""")
add("ab_store_avg", "SELECT * FROM store_avg")
add("ab_welch", f"SELECT {WELCH_OUT} FROM {welch('store_avg')}")
add("ab_ci", f"""
SELECT n_control, n_treatment, round(mean_control, 4) AS mean_control, round(mean_treatment, 4) AS mean_treatment,
       round(diff_abs, 4) AS diff_abs, round(lift_pct, 4) AS lift_pct, round(p_value, 6) AS p_value,
       round(diff_abs - 1.96 * se, 4) AS ci_low, round(diff_abs + 1.96 * se, 4) AS ci_high,
       p_value < 0.05 AS significativo FROM {welch('store_avg')}""")
add("ab_ci_t", f"""
SELECT n_control, n_treatment, round(diff_abs - hi * se, 2) AS ci_low, round(diff_abs + hi * se, 2) AS ci_high
FROM (WITH RECURSIVE s AS (SELECT * FROM {welch('store_avg')}),
      b AS (SELECT 0 AS i, CAST(0.0 AS DOUBLE) AS lo, 1 / tan(pi() * 0.025) AS hi, n_control, n_treatment, diff_abs, se, df FROM s
            UNION ALL SELECT i + 1, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END,
                             n_control, n_treatment, diff_abs, se, df
            FROM (SELECT *, (lo + hi) / 2 AS mid, {student_p('((lo + hi) / 2)', 'df')} AS p FROM b WHERE i < 60))
      SELECT * FROM b WHERE i = 60)""")
add("ab_box_stats", """
SELECT variant, count(*) AS n, round(min(avg_gmv_week), 4) AS minimo, round(quantile_cont(avg_gmv_week, 0.25), 4) AS q1,
       round(quantile_cont(avg_gmv_week, 0.5), 4) AS mediana, round(quantile_cont(avg_gmv_week, 0.75), 4) AS q3,
       round(max(avg_gmv_week), 4) AS maximo FROM store_avg GROUP BY 1""")
add("ab_ticket_frequency", f"""
SELECT variant, round(avg(ticket), 4) AS ticket, round(avg(freq), 6) AS frecuencia
FROM (SELECT store_id, variant, {total('total_amount')} / count(*) AS ticket, count(*) AS freq
      FROM clean JOIN assign USING (store_id) WHERE {between('transaction_date', TEST)} GROUP BY 1, 2) GROUP BY 1""")
add("ab_pre_period_check", f"SELECT {WELCH_OUT}, p_value >= 0.05 AS comparable_pre FROM {welch('pre_store_avg')}")
add("ab_by_format", f"""
SELECT format, {WELCH_OUT} FROM {welch('(SELECT a.*, s.format FROM store_avg a JOIN stores s USING (store_id))', 'format')}""")
add("ab_rank_balance", f"""
SELECT n_control, n_treatment, u, round(z, 6) AS z,
       round(greatest(1.0 - {integral('exp(-pow(x, 2) / 2)', '0.0', 'top')} * 2.0 / 2.5066282746310002, 0.0), 6) AS p_value
FROM (SELECT *, least(abs(z), 12.0) AS top FROM (
  SELECT *, (u - n_treatment * n_control / 2.0) / nullif(sqrt(CAST(n_treatment * n_control AS DOUBLE) / 12
            * (n_treatment + n_control + 1 - tied / ((n_treatment + n_control) * (n_treatment + n_control - 1)))), 0) AS z
  FROM (SELECT count(*) FILTER (WHERE variant = 'CONTROL') AS n_control,
               count(*) FILTER (WHERE variant = 'TREATMENT') AS n_treatment,
               sum(r) FILTER (WHERE variant = 'TREATMENT') - count(*) FILTER (WHERE variant = 'TREATMENT')
                 * (count(*) FILTER (WHERE variant = 'TREATMENT') + 1) / 2.0 AS u,
               CAST(sum(ties * ties - 1) AS DOUBLE) AS tied
        FROM (SELECT variant, rank() OVER (ORDER BY avg_gmv_week) + (ties - 1) / 2.0 AS r, ties
              FROM (SELECT *, count(*) OVER (PARTITION BY avg_gmv_week) AS ties FROM store_avg)))))""")
add("ab_mde", f"""
SELECT round((1.959963984540054 + 0.8416212335729143) * se, 4) AS mde_abs,
       round((1.959963984540054 + 0.8416212335729143) * se / nullif(mean_control, 0) * 100, 4) AS mde_pct
FROM {welch('store_avg')}""")

# --- star schema -----------------------------------------------------------------------------------------

add("fact_sales", "SELECT * FROM facts")
add("fact_ab_test_weekly", """
SELECT w.store_id, week AS week_start_date, w.variant, promo_name, gmv AS gmv_week, n_txn AS n_transactions,
       gmv / n_txn AS avg_ticket FROM weekly w JOIN assign a USING (store_id)""")
add("dim_date", """
SELECT CAST(d AS DATE) AS date_id, CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(weekofyear(d) AS INTEGER) AS week_number,
       CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year,
       isodow(d) >= 6 AS is_weekend, CAST(NULL AS BOOLEAN) AS is_holiday_cr, CAST(NULL AS VARCHAR) AS fiscal_period
FROM (SELECT unnest(generate_series(CAST(min(transaction_date) AS TIMESTAMP), CAST(max(transaction_date) AS TIMESTAMP),
                                    INTERVAL 1 DAY)) AS d FROM transactions)""")
add("dim_store", "SELECT * FROM dim_store")
add("dim_product", """
SELECT item_id AS product_id, item_name, brand, category, department, p.vendor_id, cost AS unit_cost,
       coalesce(vendor_name, 'PROVEEDOR_DESCONOCIDO') AS vendor_name
FROM products p LEFT JOIN vendors v ON p.vendor_id = v.vendor_id""")
add("dim_vendor", "SELECT * FROM vendors")
add("dim_customer", f"""
SELECT coalesce(CAST(customer_id AS VARCHAR), 'ANON') AS customer_id, min(transaction_date) AS first_transaction_date,
       {month('min(transaction_date)')} AS cohort_month, count(*) AS total_lifetime_transactions,
       customer_id IS NOT NULL AS is_identified
FROM transactions GROUP BY transactions.customer_id""")
add("dim_promotion", """
SELECT sha256(store_id || '|' || promo_name || '|' || variant || '|' || start_date) AS promo_id, *
FROM store_promotions""")
add("scd2_dim_store", f"""
SELECT store_id, country, CASE WHEN country = 'ASIA' AND v = 2 THEN 'EXPRESS' ELSE format END AS format, size_sqm,
       opening_date, CASE WHEN v = 1 THEN opening_date ELSE DATE '{CUR[0]}' END AS valid_from,
       CASE WHEN v = 1 AND (country = 'EUROPE' OR (country = 'ASIA' AND format <> 'EXPRESS'))
            THEN DATE '{CUR[0]}' END AS valid_to
FROM stores, (SELECT unnest([1, 2]) AS v)
WHERE (v = 1 AND country <> 'AFRICA')
   OR (v = 2 AND (country = 'AFRICA' OR (country = 'ASIA' AND format <> 'EXPRESS')))""")
add("fact_sales_asof", f"""
SELECT fact_sale_id, date_id, f.store_id, gross_revenue, format, size_sqm, country, valid_from AS store_valid_from
FROM facts f LEFT JOIN ({ORACLE["scd2_dim_store"]}) v
  ON f.store_id = v.store_id AND date_id >= valid_from AND (valid_to IS NULL OR date_id < valid_to)""")
add("fact_promo_impact", f"""
SELECT fact_sale_id, transaction_id, date_id, store_id, f.product_id, promo_id, quantity, unit_price, list_price,
       list_price * quantity - gross_revenue AS discount_value
FROM facts f LEFT JOIN (SELECT product_id, {ratio(total('gross_revenue'), total('quantity'))} AS list_price FROM facts
                        WHERE NOT was_on_promo GROUP BY 1) u ON f.product_id = u.product_id
WHERE was_on_promo""")
add("v_daily_gmv", f"""
SELECT store_id, date_id, {total('gross_revenue')} AS gmv, {total('quantity')} AS units FROM facts
WHERE NOT is_returned GROUP BY 1, 2""")

# --- incremental loads and streams -----------------------------------------------------------------------

PURCHASES = """(SELECT event_id AS transaction_item_id, user_id AS store_id, ts, value AS amount
       FROM events WHERE event_type = 'purchase')"""
add("stream_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
add("stream_dedupe", f"SELECT DISTINCT transaction_item_id, store_id, amount FROM {PURCHASES}")
add("stream_weekly_gmv", f"""
SELECT store_id, {week('ts')} AS week, {total('amount')} AS gmv, count(*) AS n_txn FROM {PURCHASES}
WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 3 DAY FROM {PURCHASES}) GROUP BY 1, 2""")
add("stream_weekly_corrected", f"""
SELECT store_id, {week('ts')} AS week, {total('amount')} AS gmv, count(*) AS n_txn FROM {PURCHASES}
WHERE transaction_item_id % 6 <= 3 GROUP BY 1, 2""")
add("stream_rescue", """
SELECT CASE WHEN bad IS NULL THEN event_id END AS event_id, CASE WHEN bad IS NULL THEN event_type END AS event_type,
       CASE WHEN bad IS NULL THEN CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE) END AS value, bad AS raw
FROM (SELECT *, CASE WHEN event_id % 70 = 0 THEN event_id || ',cut'
                     WHEN event_id % 50 = 0 THEN event_id || ',' || event_type || ',n/a' END AS bad FROM events)""")
add("route_late", f"""
SELECT transaction_item_id, store_id, CAST(ts AS DATE) AS transaction_date, amount,
       CAST(ts AS DATE) + CAST(transaction_item_id % 6 AS INTEGER) AS _ingested_at,
       CAST(transaction_item_id % 6 AS INTEGER) AS dias_retraso,
       CASE WHEN transaction_item_id % 6 <= 3 THEN 'corregir' ELSE 'cuarentena' END AS ruta FROM {PURCHASES}""")
add("load_stream", f"""
SELECT transaction_item_id, store_id, CAST(ts AS DATE) AS transaction_date, amount,
       CASE WHEN transaction_item_id % 6 <= 3 THEN 'facts' ELSE 'late' END AS destino FROM {PURCHASES}""")
add("upsert_facts", """
SELECT *, CAST(CAST(date_trunc('month', sale_day) AS DATE) AS VARCHAR) AS month_id FROM (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 35 ELSE 0 END AS sale_day,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS amount, o_orderstatus AS status
  FROM orders)""")
ORACLE["upsert_facts_indexed"] = ORACLE["upsert_facts"]
add("daily_aggregates_delta", f"""
SELECT month_id, sale_day, status, {total('amount')} AS amount, count(*) AS lines
FROM ({ORACLE["upsert_facts"]}) GROUP BY 1, 2, 3""")
LAST = f"""(SELECT store_id, last_date FROM stores LEFT JOIN (
        SELECT store_id, max(transaction_date) AS last_date FROM transactions
        WHERE transaction_date < DATE '{AS_OF}' GROUP BY 1) USING (store_id))"""
add("freshness_alerts", f"""
SELECT store_id, last_date, CAST(DATE '{AS_OF}' - last_date AS INTEGER) AS dias_sin_datos FROM {LAST}
WHERE last_date IS NULL OR last_date < DATE '{AS_OF}' - 1""")
add("freshness_status", f"""
SELECT store_id, last_date, CAST(DATE '{AS_OF}' - last_date AS INTEGER) AS dias_sin_datos,
       CASE WHEN DATE '{AS_OF}' - last_date <= 1 THEN 'VERDE' WHEN DATE '{AS_OF}' - last_date <= 3 THEN 'AMARILLO'
            ELSE 'ROJO' END AS semaforo FROM {LAST}""")
add("daily_aggregates", f"""
SELECT date_id, store_id, {total('gross_revenue')} AS gross_revenue, {total('gross_margin')} AS gross_margin,
       {total('quantity')} AS units, count(*) AS lines FROM facts WHERE NOT is_returned GROUP BY 1, 2""")
add("complete_days", f"""
SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM transactions
WHERE transaction_date < DATE '{AS_OF}'""")
add("pseudonymize", f"""
SELECT transaction_id, transaction_date,
       sha256(CAST(customer_id AS VARCHAR) || ':sal-' || {month('transaction_date')}) AS customer_key FROM transactions""")
add("anonymize_expired", f"""
SELECT transaction_id, CASE WHEN transaction_date + INTERVAL 24 MONTH > DATE '{AS_OF}' THEN customer_id END AS customer_id,
       transaction_date FROM transactions""")
ORACLE["anonymize_stored"] = ORACLE["anonymize_expired"]
add("gmv_reconciliation", f"""
SELECT store_id, transaction_date, CAST(h AS DOUBLE) AS gmv_header, CAST(hd AS DOUBLE) AS gmv_header_completed,
       CAST(l AS DOUBLE) AS gmv_lines, CAST(ld AS DOUBLE) AS gmv_lines_completed, CAST(h - hd AS DOUBLE) AS diff_returns,
       CAST(hd - ld AS DOUBLE) AS diff_header_lines
FROM (SELECT store_id, transaction_date, coalesce(sum({m('total_amount')}), 0) AS h,
             coalesce(sum({m('total_amount')}) FILTER (WHERE {DONE}), 0) AS hd, coalesce(sum(lines), 0) AS l,
             coalesce(sum(lines) FILTER (WHERE {DONE}), 0) AS ld
      FROM transactions FULL JOIN (SELECT transaction_id, sum({m('quantity * unit_price')}) AS lines
                                   FROM transaction_items GROUP BY 1) USING (transaction_id) GROUP BY 1, 2)""")

# --- KPIs ------------------------------------------------------------------------------------------------


def periods(step: str) -> str:
    """Revenue per store and period with the silent periods between first and last filled."""
    day = f"CAST(date_trunc('{step}', date_id) AS DATE)"
    return f"""(
  SELECT store_id, p, coalesce(gmv, 0.0) AS gmv
  FROM (SELECT store_id, CAST(unnest(generate_series(CAST(min({day}) AS TIMESTAMP), CAST(max({day}) AS TIMESTAMP),
                                                     INTERVAL 1 {step})) AS DATE) AS p
        FROM facts WHERE NOT is_returned GROUP BY 1)
  LEFT JOIN (SELECT store_id, {day} AS p, {total('gross_revenue')} AS gmv FROM facts WHERE NOT is_returned GROUP BY 1, 2)
    USING (store_id, p))"""


add("kpi_north_star", f"""
SELECT week, {total('gmv')} AS gmv,
       {total('gmv')} / (SELECT CAST(sum(size_sqm) AS DOUBLE) FROM dim_store WHERE is_comparable) AS comp_gmv_m2
FROM (SELECT store_id, {week('date_id')} AS week, {total('gross_revenue')} AS gmv FROM facts
      WHERE NOT is_returned GROUP BY 1, 2)
JOIN dim_store USING (store_id) WHERE is_comparable GROUP BY 1""")
KPI1 = f"""(
SELECT *, {growth('gmv', 'gmv_prior')} AS growth_pct, {growth('ytd', 'ytd_prior')} AS ytd_growth_pct
FROM (SELECT *, lag(gmv, 12) OVER s AS gmv_prior, lag(ytd, 12) OVER s AS ytd_prior
      FROM (SELECT store_id, p AS month, gmv,
                   CAST(sum({m('gmv')}) OVER (PARTITION BY store_id, year(p) ORDER BY p) AS DOUBLE) AS ytd
            FROM {periods('month')} JOIN dim_store USING (store_id) WHERE is_comparable)
      WINDOW s AS (PARTITION BY store_id ORDER BY month)))"""
add("kpi1_comp_growth", f"SELECT *, 5.0::DOUBLE AS target, growth_pct >= 5 AS cumple FROM {KPI1}")


def kpi2(step: str) -> str:
    return f"""(
SELECT store_id, {step}, gmv, format, gmv_m2,
       CASE WHEN gmv_m2 < quantile_cont(gmv_m2, 0.25) OVER w THEN 'PLAN_DE_MEJORA'
            WHEN gmv_m2 < quantile_cont(gmv_m2, 0.5) OVER w THEN 'BAJO_TARGET' ELSE 'OK' END AS estado
FROM (SELECT store_id, p AS {step}, gmv, format, {ratio('gmv', 'size_sqm')} AS gmv_m2
      FROM {periods(step)} JOIN dim_store USING (store_id)) WINDOW w AS (PARTITION BY format, {step}))"""


add("kpi2_gmv_sqm", f"SELECT * FROM {kpi2('week')}")
KPI3 = f"""(
SELECT format, week, n_transacciones, ticket, ticket_previo, {growth('ticket', 'ticket_previo')} AS variacion_pct, target,
       ticket >= target AS cumple
FROM (SELECT *, CASE WHEN week - lag(week) OVER f = 7 THEN lag(ticket) OVER f END AS ticket_previo,
             CASE format WHEN 'HIPERMERCADO' THEN 350.0::DOUBLE WHEN 'SUPERMERCADO' THEN 250.0::DOUBLE
                         WHEN 'DESCUENTO' THEN 150.0::DOUBLE WHEN 'EXPRESS' THEN 80.0::DOUBLE END AS target
      FROM (SELECT format, {week('transaction_date')} AS week, count(*) AS n_transacciones,
                   {total('total_amount')} / count(*) AS ticket
            FROM transactions JOIN stores USING (store_id) WHERE {DONE} GROUP BY 1, 2)
      WINDOW f AS (PARTITION BY format ORDER BY week)))"""
add("kpi3_ticket", f"SELECT * FROM {KPI3}")


def kpi4(by: str = "") -> str:
    keys, home, group = (f"{by}, ", "home AS store_id, ", "home, ") if by else ("", "", "")
    return f"""(
SELECT {keys}cohort, cohort_size, active_m1, {pct('active_m1', 'cohort_size')} AS retencion_m1_pct,
       35.0::DOUBLE AS target, {pct('active_m1', 'cohort_size')} >= 35 AS cumple
FROM (SELECT {home}cohort, count(DISTINCT customer_id) AS cohort_size,
             CASE WHEN cohort + INTERVAL 2 MONTH <= (SELECT max(transaction_date) + INTERVAL 1 DAY FROM transactions)
                  THEN count(DISTINCT customer_id) FILTER (WHERE {DONE} AND {OFFSET} = 1) END AS active_m1
      FROM loyal GROUP BY {group}cohort))"""


add("kpi4_retention_m1", f"SELECT * FROM {kpi4()}")
add("kpi4_retention_m1_by_store", f"SELECT * FROM {kpi4('store_id')}")
KPI5 = f"""(
SELECT store_id, {week('transaction_date')} AS week, count(*) AS n, count(*) FILTER (WHERE status = 'RETURNED') AS devueltas,
       {pct("count(*) FILTER (WHERE status = 'RETURNED')", 'count(*)')} AS tasa_devolucion_pct
FROM transactions GROUP BY 1, 2)"""
add("kpi5_return_rate", f"SELECT *, 2.5::DOUBLE AS target, tasa_devolucion_pct <= 2.5 AS cumple FROM {KPI5}")


def kpi6(step: str) -> str:
    return f"""(
SELECT store_id, CAST(date_trunc('{step}', transaction_date) AS DATE) AS {step}, count(*) AS n,
       count(*) FILTER (WHERE loyalty_card) AS con_lealtad, {N_PCT('loyalty_card')} AS penetracion_pct
FROM transactions GROUP BY 1, 2)"""


add("kpi6_loyalty_rate", f"SELECT *, 45.0::DOUBLE AS target, penetracion_pct >= 45 AS cumple FROM {kpi6('month')}")
KPI7 = f"""(
SELECT vendor_id, quarter, revenue, cost, vendor_name, tier, gmroi, target, gmroi >= target AS cumple
FROM (SELECT *, (revenue - cost) / nullif(cost, 0) AS gmroi,
             CASE tier WHEN 'A' THEN 1.5::DOUBLE WHEN 'B' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS target
      FROM (SELECT vendor_id, vendor_name, tier, CAST(date_trunc('quarter', date_id) AS DATE) AS quarter,
                   {total('gross_revenue')} AS revenue, {total('unit_cost * quantity')} AS cost
            FROM facts JOIN products ON product_id = item_id JOIN vendors USING (vendor_id)
            WHERE NOT is_returned GROUP BY 1, 2, 3, 4)))"""
add("kpi7_gmroi_vendor", f"SELECT * FROM {KPI7}")


def kpi8(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""(
SELECT {keys}month, count(*) AS activos, count(gap_pair) AS con_quiebre, {pct('count(gap_pair)', 'count(*)')} AS oos_pct
FROM (SELECT store_id, item_id, CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)),
             date_trunc('month', CAST(hi AS TIMESTAMP)), INTERVAL 1 MONTH)) AS DATE) AS month
      FROM (SELECT store_id, item_id, min(fecha_venta) AS lo, max(fecha_venta) AS hi FROM shelf_daily GROUP BY 1, 2
            HAVING count(*) >= 7))
LEFT JOIN (SELECT DISTINCT store_id, item_id, CAST(unnest(generate_series(date_trunc('month', CAST(gap_inicio AS TIMESTAMP)),
                  date_trunc('month', CAST(gap_fin AS TIMESTAMP)), INTERVAL 1 MONTH)) AS DATE) AS month, 1 AS gap_pair
           FROM shelf_gaps) USING (store_id, item_id, month)
GROUP BY {keys}month)"""


for _name, _by in (("kpi8_oos_rate", ""), ("kpi8_oos_rate_by_store", "store_id")):
    add(_name, f"SELECT *, 5.0::DOUBLE AS target, oos_pct <= 5 AS cumple FROM {kpi8(_by)}")


def z(value: str, part: str) -> str:
    over = f"OVER (PARTITION BY {part})"
    return (f"CASE WHEN max({value}) {over} > min({value}) {over} "
            f"THEN ({value} - avg({value}) {over}) / stddev_samp({value}) {over} END")


KPI9 = f"""(
SELECT *, 0.5 * z_gmv_m2 + 0.3 * z_retencion + 0.2 * z_crecimiento AS score
FROM (SELECT store_id, format, month, {z('gmv_m2', 'format, month')} AS z_gmv_m2,
             {z('retencion_m1_pct', 'month')} AS z_retencion, {z('growth_pct', 'month')} AS z_crecimiento
      FROM (SELECT k2.store_id, k2.format, k2.month, gmv_m2, retencion_m1_pct, growth_pct FROM {kpi2('month')} k2
            LEFT JOIN {kpi4('store_id')} k4 ON k2.store_id = k4.store_id AND k2.month = k4.cohort
            LEFT JOIN {KPI1} k1 ON k2.store_id = k1.store_id AND k2.month = k1.month)))"""
add("kpi9_store_score", f"""
SELECT store_id, format, month, round(z_gmv_m2, 6) AS z_gmv_m2, round(z_retencion, 6) AS z_retencion,
       round(z_crecimiento, 6) AS z_crecimiento, round(score, 6) AS score, score < -1 AS plan_intervencion FROM {KPI9}""")


def check(kpi: str, unit: str, period: str, rule: str, value: str, source: str, bad: str) -> str:
    return f"""
SELECT '{kpi}' AS kpi, CAST({unit} AS VARCHAR) AS unidad, CAST({period} AS DATE) AS periodo, '{rule}' AS regla,
       CAST({value} AS DOUBLE) AS valor, TRUE AS marcado FROM {source} WHERE {bad}"""


KPI1_NETWORK = f"""(SELECT *, growth - lag(growth) OVER (ORDER BY month) AS step
  FROM (SELECT month, {pct('count(*) FILTER (WHERE growth_pct = 0)', 'count(*)')} AS zero_pct,
               {growth(total('gmv'), total('gmv_prior'))} AS growth
        FROM {KPI1} WHERE growth_pct IS NOT NULL GROUP BY 1))"""
KPI2_PEERS = f"""(SELECT *, sum(gmv_m2) OVER w / count(gmv_m2) OVER w AS usual FROM {kpi2('week')}
  WINDOW w AS (PARTITION BY format, week))"""
KPI5_RUNS = f"""(SELECT *, count(*) OVER w AS c, min(tasa_devolucion_pct) OVER w AS lo, max(tasa_devolucion_pct) OVER w AS hi
  FROM {KPI5} WINDOW w AS (PARTITION BY store_id ORDER BY week RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND CURRENT ROW))"""


def kpi6_before(step: str) -> str:
    return f"""(SELECT *, lag(penetracion_pct) OVER (PARTITION BY store_id ORDER BY {step}) AS before FROM {kpi6(step)})"""


KPI8_RUNS = f"""(SELECT *, lag(oos_pct) OVER (ORDER BY month) AS prev, lag(month) OVER (ORDER BY month) AS prev_month
  FROM {kpi8()})"""
KPI9_MONTHS = f"(SELECT month, count(score) AS n, max(abs(score)) AS largest FROM {KPI9} GROUP BY 1)"
add("kpi_checks", "\nUNION ALL".join([
    check("kpi1", "'RED'", "month", "mas_20pct_tiendas_en_cero", "zero_pct", KPI1_NETWORK, "zero_pct > 20"),
    check("kpi1", "'RED'", "month", "sube_mas_30_en_un_mes", "step", KPI1_NETWORK, "step > 30"),
    check("kpi2", "store_id", "week", "cero_en_tienda_activa", "gmv_m2", KPI2_PEERS, "gmv_m2 = 0"),
    check("kpi2", "store_id", "week", "diez_veces_el_formato", "gmv_m2", KPI2_PEERS, "gmv_m2 > 10 * usual"),
    check("kpi3", "format", "week", "ticket_fuera_de_rango", "ticket", KPI3, "ticket < 5 OR ticket > 5000"),
    check("kpi3", "format", "week", "varia_mas_30pct", "variacion_pct", KPI3, "abs(variacion_pct) > 30"),
    check("kpi4", "'RED'", "cohort", "retencion_100_o_0", "retencion_m1_pct", kpi4(),
          "retencion_m1_pct = 100 OR retencion_m1_pct = 0 AND cohort_size >= 100"),
    check("kpi5", "store_id", "week", "devolucion_mayor_10", "tasa_devolucion_pct", KPI5, "tasa_devolucion_pct > 10"),
    check("kpi5", "store_id", "week", "igual_4_semanas", "tasa_devolucion_pct", KPI5_RUNS, "c = 4 AND lo = hi"),
    check("kpi6", "store_id", "month", "salto_a_100", "penetracion_pct", kpi6_before("month"),
          "penetracion_pct = 100 AND before < 100"),
    check("kpi6", "store_id", "day", "cero_en_un_dia", "penetracion_pct", kpi6_before("day"), "penetracion_pct = 0"),
    check("kpi6", "store_id", "day", "salto_a_100", "penetracion_pct", kpi6_before("day"),
          "penetracion_pct = 100 AND before < 100"),
    check("kpi7", "vendor_id", "quarter", "gmroi_negativo", "gmroi", KPI7, "gmroi < 0"),
    check("kpi7", "vendor_id", "quarter", "gmroi_mayor_10", "gmroi",
          f"(SELECT *, avg(revenue) OVER (PARTITION BY quarter) AS usual FROM {KPI7})", "gmroi > 10 AND revenue >= usual"),
    check("kpi8", "store_id", "month", "tienda_100pct", "oos_pct", kpi8("store_id"), "oos_pct = 100"),
    check("kpi8", "'RED'", "month", "cero_2_meses", "oos_pct", KPI8_RUNS,
          "oos_pct = 0 AND prev = 0 AND month = prev_month + INTERVAL 1 MONTH"),
    check("kpi9", "store_id", "month", "componente_nulo", "score", KPI9, "score IS NULL"),
    check("kpi9", "'RED'", "month", "todos_en_cero", "largest", KPI9_MONTHS, "n > 0 AND largest = 0"),
]))
