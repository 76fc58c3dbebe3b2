"""As-of joins: facts meet the version of a dimension that was valid on their day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def disjoint_versions(history: DataFrame, key: str = "store_id") -> DataFrame:
    """Versions that never overlap: each ends at its ``valid_to`` or where the key's next one starts, if earlier.

    Versions without a start, and those left without a day, are dropped; of several with one start the last to end
    stays.
    """
    following = Window.partitionBy(key).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    ends = F.least("valid_to", F.lead("valid_from").over(following))
    known = history.filter(F.col("valid_from").isNotNull()).withColumn("valid_to", ends)
    return known.filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def join_as_of(facts: DataFrame, history: DataFrame, attributes: Sequence[str], key: str = "store_id",
               day: str = "date_id", span: DataFrame | None = None) -> DataFrame:
    """``facts`` with ``attributes`` and ``valid_from`` of the version valid on ``day``; all facts stay, once each.

    A version becomes one row for each month that it touches inside the facts' days, so that facts find it by key and
    month, and the days of a version are only compared within that month. A busy key's facts are dealt over its
    months, and adaptive execution splits what is still too large. Facts before a key's first version, in a gap, or
    without key or day have null attributes. ``span``, a frame with the same days, spares deriving ``facts`` twice.
    """
    days = (facts if span is None else span).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    low, high = days.select("lo").scalar(), days.select("hi").scalar()
    first = F.greatest("valid_from", low)
    last = F.least(F.date_sub("valid_to", 1), high)
    # The months need the versions' own starts and ends, so the bounds only limit how many there are.
    versions = disjoint_versions(history, key).withColumn("_first", first).withColumn("_last", last) \
        .filter(F.col("_first") <= F.col("_last"))
    months = versions.select(
        F.col(key).alias("_key"), F.col("valid_from"), F.col("valid_to").alias("_end"),
        *[F.col(a).alias(f"_{a}") for a in attributes],
        F.explode(F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"), F.expr("interval 1 month")))
        .alias("_month"))
    met = facts.withColumn("_of", F.trunc(day, "month")).join(months, (
        F.col(key) == F.col("_key")) & (F.col("_of") == F.col("_month")) & (F.col(day) >= F.col("valid_from"))
        & (F.col("_end").isNull() | (F.col(day) < F.col("_end"))), "left")
    return met.select(*[F.col(c) for c in facts.columns if c not in {*attributes, "valid_from"}],
                      *[F.col(f"_{a}").alias(a) for a in attributes], "valid_from")


def fact_sales_asof(facts: DataFrame, history: DataFrame, span: DataFrame | None = None,
                    attributes: Sequence[str] = ("format", "size_sqm", "country")) -> DataFrame:
    """Sale lines with what their store was on the day of the sale, and since when it had been so."""
    return join_as_of(facts, history, attributes, span=span).withColumnRenamed("valid_from", "store_valid_from")
