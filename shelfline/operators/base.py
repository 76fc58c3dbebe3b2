"""Clean transactions, the joined sales base and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import count_when, is_completed, line_revenue, line_total, money, pct


def clean_transactions(txn: DataFrame, stores: DataFrame) -> DataFrame:
    """Completed sales with a positive amount, on or after the opening day of a known store."""
    sales = txn.filter((F.col("total_amount") > 0) & is_completed())
    opened = stores.select("store_id", F.col("opening_date").alias("_opened")).filter(F.col("_opened").isNotNull())
    return sales.join(opened, "store_id").filter(F.col("transaction_date") >= F.col("_opened")).select(*txn.columns)


def excluded_rows(txn: DataFrame, items: DataFrame, stores: DataFrame) -> DataFrame:
    """Header and line rows a quality rule removes, one row per rule broken."""
    opened = stores.select("store_id", F.col("opening_date").alias("_opened"), F.lit(True).alias("_known"))
    headers = txn.join(opened, "store_id", "left").select(
        F.lit("transactions").alias("tabla"), F.col("transaction_id").cast("string").alias("row_id"),
        F.array_compact(F.array(
            F.when(F.col("total_amount") <= 0, "monto_invalido"),
            F.when(F.col("_known").isNull(), "tienda_huerfana"),
            F.when(F.col("transaction_date") < F.col("_opened"), "pre_apertura"),
        )).alias("reasons"))
    lines = items.select(
        F.lit("transaction_items").alias("tabla"), F.col("transaction_item_id").cast("string").alias("row_id"),
        F.array_compact(F.array(
            F.when((F.col("unit_price") == 0) & ~F.col("was_on_promo"), "precio_cero_sin_promo"),
        )).alias("reasons"))
    return headers.unionByName(lines).select("tabla", "row_id", F.explode("reasons").alias("motivo"))


def sales_base(txn: DataFrame, stores: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Clean headers with their store, lines and line revenue; every header is kept.

    Pass no ``products`` when neither category nor cost is needed, which saves the join.
    """
    lines = items
    if products is not None:
        lines = items.join(products.select("item_id", "category", "cost"), "item_id", "left")
    return (
        txn.join(stores, "store_id", "left").join(lines, "transaction_id", "left")
        .withColumn("revenue", line_revenue()))


def with_line_amount(txn: DataFrame, items: DataFrame) -> DataFrame:
    """Headers whose ``total_amount`` is the sum of their lines, zero without lines.

    Operators take the header amount as GMV; pass these headers to run them on line revenue instead.
    """
    lines = items.groupBy("transaction_id").agg(line_total(line_revenue()).alias("_lines"))
    return txn.join(lines, "transaction_id", "left").select(*[
        money(F.coalesce("_lines", F.lit(0.0))).alias(c) if c == "total_amount" else F.col(c) for c in txn.columns])


def analysis_summary(txn: DataFrame, stores: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row: transactions, GMV, loyalty rate, countries and formats of clean headers.

    GMV is line revenue when ``items`` are given, else the header amount. Headers combine per store before the
    store join.
    """
    if items is not None:
        txn = with_line_amount(txn, items)
    per_store = txn.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("total_amount")).alias("amount"),
        count_when(F.col("loyalty_card")).alias("loyal"))
    return per_store.join(stores.select("store_id", "country", "format"), "store_id", "left").agg(
        F.sum("n").alias("total_tx"), F.sum("amount").cast("double").alias("total_gmv"),
        pct(F.sum("loyal"), F.sum("n")).alias("loyalty_rate"),
        F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries"),
        F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"))
