"""The six business queries: comparable sales, space productivity, cohorts, GMROI, stock-outs, promotions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import (
    growth_pct, is_completed, line_revenue, line_total, mean, money, month_offset, month_start, pct, ratio, total, units,
    within)
from ..functions.relational import (
    any_flag_per_group, below_percentile_flag, comparable_stores, pivot_metrics, rank_within)

# Fixed default periods of the published queries.
CURRENT_HALF = ("2025-01-01", "2025-06-30")
PRIOR_HALF = ("2024-01-01", "2024-06-30")
LAST_QUARTER = ("2025-04-01", "2025-06-30")


def q1_comp_sales(txn: DataFrame, stores: DataFrame, cur: Sequence = CURRENT_HALF,
                  prior: Sequence = PRIOR_HALF) -> DataFrame:
    """Growth of comparable stores between two periods, ranked inside each format.

    Both periods come from one pass over the transactions, combined per store before anything is joined.
    """
    in_cur, in_prior = within("transaction_date", *cur), within("transaction_date", *prior)
    totals = txn.filter(is_completed() & (in_cur | in_prior)).groupBy("store_id").agg(
        total(F.when(in_cur, F.col("total_amount"))).alias("gmv_actual"),
        total(F.when(in_prior, F.col("total_amount"))).alias("gmv_anterior"))
    both = totals.filter((F.col("gmv_actual") > 0) & (F.col("gmv_anterior") > 0))
    grown = (
        comparable_stores(stores, prior[0]).select("store_id", "store_name", "country", "format")
        .join(both, "store_id")
        .withColumn("comp_sales_pct", growth_pct(F.col("gmv_actual"), F.col("gmv_anterior"))))
    return rank_within(grown, "format", F.desc("comp_sales_pct"), "rank_en_formato").orderBy(
        "format", "rank_en_formato", "store_id")


def q2_sqm_productivity(txn: DataFrame, stores: DataFrame, period: Sequence = LAST_QUARTER) -> DataFrame:
    """Sales and transactions per square metre; stores strictly under the format's 25th percentile."""
    sold = txn.filter(is_completed() & within("transaction_date", *period)).groupBy("store_id").agg(
        total("total_amount").alias("gmv_total"), F.count("transaction_id").alias("n_transacciones"),
        mean("total_amount").alias("ticket_promedio"))
    per_store = (
        stores.select("store_id", "store_name", "country", "format", "size_sqm").join(sold, "store_id")
        .withColumn("gmv_por_m2", ratio(F.col("gmv_total"), F.col("size_sqm")))
        .withColumn("txn_por_m2", ratio(F.col("n_transacciones"), F.col("size_sqm"))))
    ranked = rank_within(per_store, "format", F.desc("gmv_por_m2"), "rank_en_formato")
    return (
        below_percentile_flag(ranked, "format", "gmv_por_m2", 0.25).drop("n_transacciones")
        .orderBy("format", F.desc("gmv_por_m2"), "store_id"))


def cohort_activity(txn: DataFrame, by: Sequence[str] = (), first: str = "any",
                    mode: str = "calendar") -> DataFrame:
    """Customers and ticket per cohort month and month offset, with the cohort size on every row.

    Loyal, identified customers only. ``first`` says whether a purchase of ``any`` status or only a
    ``completed`` one starts the cohort; activity counts completed purchases. ``by`` names attributes of the
    first purchase (for example the home store).

    Transactions shrink to one row per customer and month before the window, so a customer with very many
    purchases is a few dozen rows, and distinct customers become plain counts.
    """
    loyal = txn.filter(F.col("loyalty_card") & F.col("customer_id").isNotNull())
    if first == "completed":
        loyal = loyal.filter(is_completed())
    done = F.when(is_completed(), F.col("total_amount"))
    # Ties on the first day go to the smallest attribute values.
    home = [F.min(F.struct("transaction_date", *by)).alias("_home")] if by else []
    monthly = loyal.groupBy("customer_id", month_start("transaction_date").alias("month")).agg(
        F.count(done).alias("n"), F.sum(money(done)).alias("amount"), *home)
    person = W.partitionBy("customer_id")
    placed = monthly.withColumn("cohort", F.min("month").over(person))
    if by:
        placed = placed.withColumn("_home", F.min("_home").over(person))
        placed = placed.withColumns({c: F.col(f"_home.{c}") for c in by})
    keys = [*by, "cohort"]
    placed = placed.withColumn("month_offset", month_offset("month", "cohort", mode))
    if mode != "calendar":
        placed = placed.groupBy("customer_id", *keys, "month_offset").agg(
            F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    activity = placed.groupBy(*keys, "month_offset").agg(
        F.count(F.lit(1)).alias("_seen"), F.count_if(F.col("n") > 0).alias("customers"),
        (F.sum("amount").cast("double") / F.nullif(F.sum("n"), F.lit(0))).alias("ticket"))
    # Every customer has exactly one row at offset zero.
    size = F.max(F.when(F.col("month_offset") == 0, F.col("_seen"))).over(W.partitionBy(*keys))
    return activity.withColumn("cohort_size", size).drop("_seen")


def q3_cohort_retention(txn: DataFrame, months: Sequence[int] = (0, 1, 2, 3, 6)) -> DataFrame:
    """Cohorts by month with retention and ticket at the given month offsets; null where nobody bought."""
    cells = []
    for m in months:
        here = (F.col("month_offset") == m) & (F.col("customers") > 0)
        if m > 0:
            cells.append(pct(F.max(F.when(here, F.col("customers"))), F.max("cohort_size")).alias(f"ret_m{m}_pct"))
        cells.append(F.max(F.when(here, F.col("ticket"))).alias(f"ticket_m{m}"))
    return (
        cohort_activity(txn).groupBy(F.col("cohort").alias("cohorte_mes"))
        .agg(F.max("cohort_size").alias("tamano_cohorte"), *cells).orderBy("cohorte_mes"))


def q4_gmroi(items: DataFrame, txn: DataFrame, products: DataFrame, vendors: DataFrame,
             days: float | None = None, exclude_zero_price: bool = False) -> DataFrame:
    """Gross margin over cost of goods sold per vendor and category; below 1 raises an alert.

    Lines combine per item before products and vendors are joined. Products of unknown vendors drop out. A
    zero cost gives a null ratio, which counts as OK. ``days`` for the daily velocity defaults to the span
    of the transactions.
    """
    lines = items.filter(F.col("unit_price") != 0) if exclude_zero_price else items
    done = txn.filter(is_completed()).select("transaction_id")
    per_item = lines_with_headers(lines, done).groupBy("item_id").agg(
        line_total(line_revenue()).alias("revenue"), line_total("quantity").alias("units"))
    sold = (
        per_item.join(products.select("item_id", "category", "cost", "vendor_id"), "item_id")
        .join(vendors.select("vendor_id", "vendor_name", F.col("tier").alias("vendor_tier")), "vendor_id")
        .groupBy("vendor_id", "vendor_name", "vendor_tier", "category").agg(
            total("revenue").alias("gmv"), total(F.col("units") * F.col("cost")).alias("costo_total"),
            total("units").alias("unidades_vendidas"), F.count("item_id").alias("skus_activos")))
    span = F.lit(float(days)) if days else txn.agg(
        (F.datediff(F.max("transaction_date"), F.min("transaction_date")) + 1).cast("double")).scalar()
    return (
        sold.withColumn("margen_bruto", F.col("gmv") - F.col("costo_total"))
        .withColumn("gmroi", ratio(F.col("margen_bruto"), F.col("costo_total")))
        .withColumn("velocidad_venta_dia", F.col("unidades_vendidas") / span)
        .withColumn("alerta", F.when(F.col("gmroi") < 1, "ALERTA_GMROI<1").otherwise("OK"))
        .drop("unidades_vendidas").orderBy("gmroi", "vendor_id", "category"))


def lines_with_headers(items: DataFrame, headers: DataFrame, how: str = "inner") -> DataFrame:
    """Sale lines with their header.

    Adaptive execution chooses the join by the measured sizes: a day's few headers are broadcast, larger ones are
    merged, and a transaction that holds too many rows is split.
    """
    return items.join(headers, "transaction_id", how)


def daily_item_sales(items: DataFrame, txn: DataFrame | None = None) -> DataFrame:
    """Units and revenue per store, item and day of completed sales.

    Without ``txn`` the lines carry their header's ``store_id``, ``transaction_date`` and ``status`` themselves and no
    join is needed; a line without a ``transaction_id`` has no header.
    """
    if txn is None:
        lines = items.filter(is_completed() & F.col("transaction_id").isNotNull())
    else:
        done = txn.filter(is_completed()).select("transaction_id", "store_id", "transaction_date")
        lines = lines_with_headers(items, done)
    return lines.groupBy(
        "store_id", "item_id", F.col("transaction_date").alias("fecha_venta")
    ).agg(line_total("quantity").alias("unidades"), line_total(line_revenue()).alias("gmv_dia"))


def stockout_gaps(daily: DataFrame, min_gap: int = 3, min_days: int = 7) -> DataFrame:
    """Runs of ``min_gap`` or more days without a sale, of items with ``min_days`` sale days in the store.

    First and last day of an item's range are sale days, so every gap lies between two consecutive sale days
    and one LAG finds it; no calendar is built. Averages are over sale days of the whole range.
    """
    pair = W.partitionBy("store_id", "item_id")
    prev = F.lag("fecha_venta").over(pair.orderBy("fecha_venta"))
    days = F.count("fecha_venta").over(pair)
    return (
        daily.withColumn("_prev", prev).withColumn("dias_con_venta", days)
        .withColumn("avg_unidades_dia", F.sum(units("unidades")).over(pair).cast("double") / 10000 / F.col("dias_con_venta"))
        .withColumn("avg_gmv_dia", F.sum(units("gmv_dia")).over(pair).cast("double") / 10000 / F.col("dias_con_venta"))
        .withColumn("duracion_dias", F.datediff("fecha_venta", "_prev") - 1)
        .filter((F.col("dias_con_venta") >= min_days) & (F.col("duracion_dias") >= min_gap))
        .select("store_id", "item_id", F.date_add("_prev", 1).alias("gap_inicio"),
                F.date_sub("fecha_venta", 1).alias("gap_fin"), "duracion_dias", "dias_con_venta",
                "avg_unidades_dia", "avg_gmv_dia"))


def stockout_gaps_calendar(daily: DataFrame, min_gap: int = 3, min_days: int = 7) -> DataFrame:
    """The same gaps from one sorted array of sale days per pair, without a window; a cross-check of ``stockout_gaps``.

    The idle runs of a pair's calendar are what lies between neighbours in that array, so no calendar day is laid out.
    """
    pairs = daily.groupBy("store_id", "item_id").agg(
        F.sort_array(F.collect_set("fecha_venta")).alias("_sold"), F.count("fecha_venta").alias("dias_con_venta"),
        (line_total("unidades") / F.count("fecha_venta")).alias("avg_unidades_dia"),
        (line_total("gmv_dia") / F.count("fecha_venta")).alias("avg_gmv_dia"),
    ).filter(F.col("dias_con_venta") >= min_days)
    between = F.greatest(F.size("_sold") - 1, F.lit(0))
    runs = F.zip_with(
        F.slice("_sold", 1, between), F.slice("_sold", 2, between),
        lambda a, b: F.struct(F.date_add(a, 1).alias("gap_inicio"), F.date_sub(b, 1).alias("gap_fin"),
                              (F.datediff(b, a) - 1).alias("duracion_dias")))
    return pairs.select(
        "store_id", "item_id", F.inline(F.filter(runs, lambda r: r["duracion_dias"] >= max(min_gap, 1))),
        "dias_con_venta", "avg_unidades_dia", "avg_gmv_dia")


def _lost_sales(gaps: DataFrame, stores: DataFrame, products: DataFrame, n: int | None) -> DataFrame:
    named = (
        gaps.join(stores.select("store_id", "store_name"), "store_id")
        .join(products.select("item_id", "item_name", "category"), "item_id")
        .select("store_id", "store_name", "item_id", "item_name", "category", "gap_inicio", "gap_fin",
                "duracion_dias", F.col("avg_unidades_dia").alias("avg_unidades_dia_previo"),
                (F.col("avg_gmv_dia") * F.col("duracion_dias")).alias("gmv_estimado_perdido")))
    if n is None:
        return named
    return named.orderBy(F.desc("gmv_estimado_perdido"), "store_id", "item_id", "gap_inicio").limit(n)


def q5_stockouts(items: DataFrame, txn: DataFrame | None, stores: DataFrame, products: DataFrame,
                 min_gap: int = 3, min_days: int = 7, n: int | None = 200) -> DataFrame:
    """The ``n`` probable stock-outs with the largest estimated loss; ``n=None`` returns all."""
    return _lost_sales(stockout_gaps(daily_item_sales(items, txn), min_gap, min_days), stores, products, n)


def q5_stockouts_calendar(items: DataFrame, txn: DataFrame | None, stores: DataFrame, products: DataFrame,
                          min_gap: int = 3, min_days: int = 7, n: int | None = 200) -> DataFrame:
    return _lost_sales(stockout_gaps_calendar(daily_item_sales(items, txn), min_gap, min_days), stores, products, n)


def stockout_totals(gaps: DataFrame) -> DataFrame:
    """Number of gaps and their estimated loss."""
    return gaps.agg(
        F.count(F.lit(1)).alias("total_gaps"),
        total(F.col("avg_gmv_dia") * F.col("duracion_dias")).alias("total_lost_gmv"))


def q6_promo_uplift(items: DataFrame, txn: DataFrame, products: DataFrame,
                    dedupe_baskets: bool = False) -> DataFrame:
    """Ticket and units per basket by category, baskets with a promoted line against those without.

    The average ticket weighs a basket by its lines in the category; ``dedupe_baskets`` counts it once. Lines
    combine per basket and category, so distinct baskets are plain row counts and the flag window holds one
    row per category.
    """
    known = products.select("item_id", "category", F.lit(True).alias("_known"))
    per_cat = items.join(known, "item_id", "left").groupBy("transaction_id", "category", "_known").agg(
        F.count(F.lit(1)).alias("lines"), line_total("quantity").alias("units"),
        F.max(F.col("was_on_promo").cast("int")).alias("promo"))
    flagged = per_cat.withColumn("tuvo_promo", F.max("promo").over(W.partitionBy("transaction_id"))).filter("_known")
    weight = F.lit(1) if dedupe_baskets else F.col("lines")
    amount = F.col("amount") * weight.cast("decimal(10,0)")
    done = txn.filter(is_completed()).select("transaction_id", money("total_amount").alias("amount"))
    by_flag = (
        lines_with_headers(flagged, done)
        .groupBy("category", "tuvo_promo").agg(
            F.count(F.lit(1)).alias("txn"), (F.sum(amount).cast("double") / F.sum(weight)).alias("ticket"),
            (line_total("units") / F.count(F.lit(1))).alias("uds_por_txn")))
    wide = pivot_metrics(by_flag, ["category"], "tuvo_promo", {"sin_promo": 0, "con_promo": 1},
                         ["txn", "ticket", "uds_por_txn"])
    return (
        wide.withColumn("ticket_uplift_abs", F.col("ticket_con_promo") - F.col("ticket_sin_promo"))
        .withColumn("ticket_uplift_pct", (ratio(F.col("ticket_con_promo"), F.col("ticket_sin_promo")) - 1) * 100)
        .withColumn("basket_uplift_uds", F.col("uds_por_txn_con_promo") - F.col("uds_por_txn_sin_promo"))
        .orderBy(F.desc("ticket_uplift_pct"), "category"))


def basket_promo_flag(items: DataFrame) -> DataFrame:
    """Per transaction: did it have any promoted line."""
    return any_flag_per_group(items, ["transaction_id"], "was_on_promo", "tuvo_promo")


# Decimals of the published reports.
REPORT_DIGITS = {
    "q1_comp_sales": {"gmv_actual": 2, "gmv_anterior": 2, "comp_sales_pct": 2},
    "q2_sqm_productivity": {"gmv_total": 2, "gmv_por_m2": 4, "txn_por_m2": 6, "ticket_promedio": 2},
    "q3_cohort_retention": {
        "ticket_m0": 2, "ret_m1_pct": 1, "ticket_m1": 2, "ret_m2_pct": 1, "ticket_m2": 2, "ret_m3_pct": 1,
        "ticket_m3": 2, "ret_m6_pct": 1, "ticket_m6": 2},
    "q4_gmroi": {"gmv": 2, "costo_total": 2, "margen_bruto": 2, "gmroi": 4, "velocidad_venta_dia": 2},
    "q5_stockouts": {"avg_unidades_dia_previo": 2, "gmv_estimado_perdido": 2},
    "q6_promo_uplift": {
        "ticket_sin_promo": 2, "uds_por_txn_sin_promo": 3, "ticket_con_promo": 2, "uds_por_txn_con_promo": 3,
        "ticket_uplift_abs": 2, "ticket_uplift_pct": 2, "basket_uplift_uds": 3},
}
