"""Star schema: facts at sale-line grain, dimensions, and views on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import RETURNED, as_date, line_revenue, line_total, month_start, ratio
from ..functions.relational import first_row
from .abtest import ab_assign, ab_weekly
from .business import lines_with_headers

ANONYMOUS = "ANON"
UNKNOWN_VENDOR = "PROVEEDOR_DESCONOCIDO"


def _promo_id() -> Column:
    """Stable surrogate key from the natural key."""
    return F.sha2(F.concat_ws("|", "store_id", "promo_name", "variant", "start_date"), 256)


def dim_promotion(promos: DataFrame) -> DataFrame:
    return promos.select(_promo_id().alias("promo_id"), "store_id", "promo_name", "variant", "promo_type",
                         "start_date", "end_date")


def reversed_promotions(promos: DataFrame) -> DataFrame:
    """Promotions that end before they start or have no start: they are in force on no day."""
    return promos.filter(F.col("start_date").isNull() | (F.col("end_date") < F.col("start_date")))


def promotion_days(promos: DataFrame, txn: DataFrame) -> DataFrame:
    """The one promotion in force per store and day: the earliest by start, name and variant.

    Ranges become store-days inside the span of the sales, so facts find their promotion by equality and cannot
    multiply. A null end is open; see ``reversed_promotions`` for ranges without days.
    """
    span = txn.agg(F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"))
    first = F.greatest("start_date", span.select("lo").scalar())
    last = F.least("end_date", span.select("hi").scalar())
    ranges = dim_promotion(promos).filter(
        F.col("start_date").isNotNull() & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("start_date"))))
    days = ranges.withColumn("_lo", first).withColumn("_hi", last).filter(F.col("_lo") <= F.col("_hi")).select(
        "store_id", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias("date_id"),
        "start_date", "promo_name", "variant", "promo_id")
    return first_row(days, ["store_id", "date_id"], ["start_date", "promo_name", "variant"]).select(
        "store_id", "date_id", "promo_id")


def fact_sales(items: DataFrame, txn: DataFrame, products: DataFrame, promos: DataFrame,
               loaded_at: Column | None = None) -> DataFrame:
    """One row per sale line with revenue, margin and the promotion in force.

    The promotion is looked up for headers, before the larger lines are joined.
    """
    headers = txn.select(
        "transaction_id", F.col("transaction_date").alias("date_id"), "store_id", "customer_id", "status",
    ).join(promotion_days(promos, txn), ["store_id", "date_id"], "left")
    costs = products.select("item_id", F.col("cost").alias("unit_cost"))
    joined = lines_with_headers(items, headers, "left").join(costs, "item_id", "left")
    revenue = line_revenue()
    return joined.select(
        F.col("transaction_item_id").alias("fact_sale_id"), "transaction_id", "date_id", "store_id",
        F.col("item_id").alias("product_id"), "customer_id", "promo_id", "quantity", "unit_price", "unit_cost",
        revenue.alias("gross_revenue"), (revenue - F.col("quantity") * F.col("unit_cost")).alias("gross_margin"),
        "was_on_promo", (F.col("status") == RETURNED).alias("is_returned"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("_loaded_at"))


def fact_ab_test_weekly(txn: DataFrame, promos: DataFrame, start, end) -> DataFrame:
    """Store, week and variant of the test with amount, transactions and ticket."""
    assign = ab_assign(promos)
    weekly = ab_weekly(txn, assign, start, end)
    return weekly.join(assign.select("store_id", "promo_name"), "store_id").select(
        "store_id", F.col("week").alias("week_start_date"), "variant", "promo_name", F.col("gmv").alias("gmv_week"),
        F.col("n_txn").alias("n_transactions"), ratio(F.col("gmv"), F.col("n_txn")).alias("avg_ticket"))


def dim_date(dates: DataFrame, day: str = "transaction_date", holidays: DataFrame | None = None) -> DataFrame:
    """Every day between the first and last of ``dates``.

    Weekdays are 1 (Monday) to 7. Holidays and fiscal periods follow a user's table (``date_id``,
    ``is_holiday_cr``, ``fiscal_period``); without one they are null.
    """
    span = dates.agg(F.min(day).cast("date").alias("lo"), F.max(day).cast("date").alias("hi"))
    d = F.col("date_id")
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_id")).select(
        d, (F.weekday(d) + 1).alias("day_of_week"), F.weekofyear(d).alias("week_number"), F.month(d).alias("month"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"), (F.weekday(d) >= 5).alias("is_weekend"))
    if holidays is None:
        return days.withColumn("is_holiday_cr", F.lit(None).cast("boolean")).withColumn(
            "fiscal_period", F.lit(None).cast("string"))
    return days.join(holidays.select("date_id", "is_holiday_cr", "fiscal_period"), "date_id", "left")


def dim_store(stores: DataFrame, as_of) -> DataFrame:
    """Stores with the comparable flag: open for 13 months at ``as_of``; rebuilt every month."""
    return stores.select(
        "store_id", "store_name", "country", "city", "format", "region", "size_sqm", "opening_date",
        (F.add_months("opening_date", 13) <= as_date(as_of)).alias("is_comparable"))


def dim_product(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Products under their star names; ``vendor_name`` marks products of an unknown vendor."""
    named = products.join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left")
    return named.select(
        F.col("item_id").alias("product_id"), "item_name", "brand", "category", "department", "vendor_id",
        F.col("cost").alias("unit_cost"), F.coalesce("vendor_name", F.lit(UNKNOWN_VENDOR)).alias("vendor_name"))


def dim_vendor(vendors: DataFrame) -> DataFrame:
    return vendors.select("vendor_id", "vendor_name", "country", "tier", "is_shared_catalog")


def dim_customer(txn: DataFrame) -> DataFrame:
    """Customers with first purchase, cohort and lifetime count, and one member for all anonymous sales.

    More than half of the sales may be anonymous; they combine to one row per task before the shuffle.
    """
    members = txn.groupBy("customer_id").agg(
        F.min("transaction_date").alias("first_transaction_date"),
        F.count(F.lit(1)).alias("total_lifetime_transactions"))
    return members.select(
        F.coalesce(F.col("customer_id").cast("string"), F.lit(ANONYMOUS)).alias("customer_id"),
        "first_transaction_date", month_start("first_transaction_date").alias("cohort_month"),
        "total_lifetime_transactions", F.col("customer_id").isNotNull().alias("is_identified"))


def scd2_dim_store(history: DataFrame, snapshot: DataFrame, as_of,
                   key: str = "store_id", tracked: Sequence[str] = ("format", "size_sqm", "country")) -> DataFrame:
    """Versioned stores: close changed and vanished versions at ``as_of``, open new ones.

    ``history`` has ``valid_from`` and ``valid_to`` (null while current). One join on the key; running it
    again with the same snapshot changes nothing.
    """
    attrs = [c for c in snapshot.columns if c != key]
    today = as_date(as_of)
    closed = history.filter(F.col("valid_to").isNotNull()).select(key, *attrs, "valid_from", "valid_to")
    current = history.filter(F.col("valid_to").isNull())
    old = current.select(F.col(key), F.struct(*attrs).alias("_old"), F.col("valid_from").alias("_from"))
    new = snapshot.select(F.col(key), F.struct(*attrs).alias("_new"))
    both = old.join(new, key, "full")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    kept = F.col("_old").isNotNull() & F.col("_new").isNotNull() & same

    def version(row: str, start: Column, end: Column) -> Column:
        return F.struct(F.col(row).alias("row"), start.alias("valid_from"), end.cast("date").alias("valid_to"))

    open_end = F.lit(None)
    versions = F.when(kept, F.array(version("_new", F.col("_from"), open_end))).otherwise(F.array_compact(F.array(
        F.when(F.col("_old").isNotNull(), version("_old", F.col("_from"), today)),
        F.when(F.col("_new").isNotNull(), version("_new", today, open_end)))))
    opened = both.select(key, F.explode(versions).alias("v")).select(
        key, *[F.col(f"v.row.{c}").alias(c) for c in attrs], "v.valid_from", "v.valid_to")
    return closed.unionByName(opened)


def fact_promo_impact(facts: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Discount given by each promoted line against the item's average price off promotion.

    The reference price is off-promotion revenue over units; it is null for items never sold off promotion. Given
    the ``items`` the facts were made of, it is taken from them alone, without headers, stores and promotions.
    """
    lines = facts if items is None else items.select(
        F.col("item_id").alias("product_id"), "quantity", line_revenue().alias("gross_revenue"), "was_on_promo")
    usual = lines.filter(~F.col("was_on_promo")).groupBy("product_id").agg(
        ratio(line_total("gross_revenue"), line_total("quantity")).alias("list_price"))
    return facts.filter(F.col("was_on_promo")).join(usual, "product_id", "left").select(
        "fact_sale_id", "transaction_id", "date_id", "store_id", "product_id", "promo_id", "quantity", "unit_price",
        "list_price", (F.col("list_price") * F.col("quantity") - F.col("gross_revenue")).alias("discount_value"))


def v_daily_gmv(facts: DataFrame) -> DataFrame:
    """Certified revenue per store and day: line revenue without returned sales."""
    return facts.filter(~F.col("is_returned")).groupBy("store_id", "date_id").agg(
        line_total("gross_revenue").alias("gmv"), line_total("quantity").alias("units"))
