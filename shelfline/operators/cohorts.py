"""Cohorts from month bitmaps: a month's load updates retention without the history of sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import month_number

# Months in one bitmap; a customer has a row for each such span with a purchase.
SPAN = 60


def month_bits(txn: DataFrame, day: str = "transaction_date") -> DataFrame:
    """customer_id, span, bits: a bit for each month with a completed sale; anonymous and undated sales are left out."""
    bought = txn.filter((F.col("status") == "COMPLETED") & F.col("customer_id").isNotNull() & F.col(day).isNotNull())
    month = month_number(day)
    bit = F.expr("shiftleft(1L, _month)")
    return bought.select("customer_id", F.floor(month / SPAN).cast("int").alias("span"),
                         (month % SPAN).cast("int").alias("_month")).groupBy("customer_id", "span") \
        .agg(F.bit_or(bit).alias("bits"))


def merged_bits(*frames: DataFrame) -> DataFrame:
    """Bitmaps of several loads as one; months loaded twice, or out of order, change nothing."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.groupBy("customer_id", "span").agg(F.bit_or("bits").alias("bits"))


def _months(spans: Column) -> Column:
    """The month numbers of all bits, in a customer's few rows."""
    return F.flatten(F.transform(spans, lambda s: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda i: F.getbit(s["bits"], i) == 1),
        lambda i: s["span"] * SPAN + i)))


def activity_of_bits(bits: DataFrame) -> DataFrame:
    """cohort, month_offset, customers, cohort_size: as counted from the sales themselves by calendar month."""
    active = bits.groupBy("customer_id").agg(F.collect_list(F.struct("span", "bits")).alias("spans")) \
        .select(_months(F.col("spans")).alias("months"))
    active = active.select(F.array_min("months").alias("first"), F.explode("months").alias("month"))
    counted = active.groupBy("first", (F.col("month") - F.col("first")).alias("month_offset")).agg(
        F.count(F.lit(1)).alias("customers"))
    # All of a cohort are active in month 0; one row per cohort and month from here on.
    size = counted.filter("month_offset = 0").select(F.col("first").alias("_first"), F.col("customers").alias("cohort_size"))
    start = F.make_date(F.floor((F.col("first") - 1) / 12).cast("int"), ((F.col("first") - 1) % 12 + 1).cast("int"), F.lit(1))
    return counted.join(size, F.col("first") == F.col("_first")).select(
        start.alias("cohort"), "month_offset", "customers", "cohort_size")
