"""Exploratory analyses: seasonality, Pareto, cohort matrix, low rotation, payment mix."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import line_total, money, pct, ratio, week_start
from .business import cohort_activity


def _revenue_by(base: DataFrame, *keys) -> DataFrame:
    """Revenue per key; a group whose headers have no lines is worth zero, null keys are dropped."""
    grouped = base.groupBy(*keys).agg(F.coalesce(line_total("revenue"), F.lit(0.0)).alias("gmv"))
    return grouped.dropna(subset=[c for c in grouped.columns if c != "gmv"])


def p1_weekly_gmv(base: DataFrame) -> DataFrame:
    """Revenue per Monday week and store format."""
    return _revenue_by(base, week_start("transaction_date").alias("week"), "format")


def p1_peaks_troughs(weekly: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` highest and lowest weeks of each format."""
    high = W.partitionBy("format").orderBy(F.desc("gmv"), "week")
    low = W.partitionBy("format").orderBy("gmv", "week")
    ranked = weekly.withColumn("_hi", F.row_number().over(high)).withColumn("_lo", F.row_number().over(low))
    ends = F.array_compact(F.array(
        F.when(F.col("_hi") <= n, F.struct(F.lit("PICO").alias("tipo"), F.col("_hi").alias("orden"))),
        F.when(F.col("_lo") <= n, F.struct(F.lit("CAIDA").alias("tipo"), F.col("_lo").alias("orden")))))
    return ranked.select("format", "week", "gmv", F.inline(ends))


def p1_seasonality(weekly: DataFrame) -> DataFrame:
    """Formats from most to least seasonal by the coefficient of variation of weekly revenue."""
    cv = weekly.groupBy("format").agg(ratio(F.stddev_samp("gmv"), F.avg("gmv")).alias("cv"))
    # One row per format, so the ranking window is a handful of rows.
    return cv.withColumn("rank_estacionalidad", F.rank().over(W.orderBy(F.desc_nulls_last("cv"))))


def p1_seasonal_strength(weekly: DataFrame, year_days: float = 365.25) -> DataFrame:
    """How much of each format's weekly revenue a yearly wave explains beside a straight trend.

    Least squares on a constant, the week and the sine and cosine of the day of the year, solved in closed form from
    one aggregate's co-moments, so a format's weeks are never gathered. ``tendencia`` is revenue gained per week,
    ``amplitud`` half the wave's height, ``fuerza`` the share of the variance around the trend alone that the wave
    explains, ``dia_pico`` the days after 1 January on which the wave is highest. Formats with
    fewer than five weeks, or weeks that do not determine the wave, have nulls; so has the strength where nothing is
    left around the trend. A null revenue counts as no week.
    """
    days = F.datediff("week", F.lit("1970-01-01").cast("date"))
    angle = 2 * math.pi * days / year_days
    known = weekly.filter(F.col("gmv").isNotNull() & F.col("format").isNotNull()).select(
        "format", F.col("gmv").cast("double").alias("y"), (days / 7).alias("t"), F.cos(angle).alias("c"),
        F.sin(angle).alias("s"))
    pairs = ["tt", "ty", "tc", "ts", "yy", "yc", "ys", "cc", "cs", "ss"]
    sums = known.groupBy("format").agg(
        F.count(F.lit(1)).alias("semanas"), *[F.covar_pop(p[0], p[1]).alias(p) for p in pairs])
    # What is left of each co-moment once the trend is taken out.
    rest = sums.select("format", "semanas", "tt", "ty", "tc", "ts", F.col("yy").alias("_all"), *[
        (F.col(p) - ratio(F.col(f"t{p[0]}") * F.col(f"t{p[1]}"), F.col("tt"))).alias(p)
        for p in ("yy", "yc", "ys", "cc", "cs", "ss")])
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    solvable = (F.col("semanas") >= 5) & (det > 1e-9)
    waves = rest.withColumn("_c", F.when(solvable, (F.col("yc") * F.col("ss") - F.col("ys") * F.col("cs")) / det)) \
        .withColumn("_s", F.when(solvable, (F.col("ys") * F.col("cc") - F.col("yc") * F.col("cs")) / det))
    turn = F.atan2("_s", "_c") / (2 * math.pi)
    strength = waves.select(
        "format", "semanas",
        ratio(F.col("ty") - F.col("_c") * F.col("tc") - F.col("_s") * F.col("ts"), F.col("tt")).alias("tendencia"),
        F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("amplitud"),
        ((turn - F.floor(turn)) * year_days).alias("dia_pico"),
        F.when(F.col("yy") > 1e-12 * F.col("_all"),
               ratio(F.col("_c") * F.col("yc") + F.col("_s") * F.col("ys"), F.col("yy"))).alias("fuerza"))
    # One row per format, so the ranking window is a handful of rows.
    return strength.withColumn("rank_fuerza", F.rank().over(W.orderBy(F.desc_nulls_last("fuerza"))))


def p2_pareto(base: DataFrame) -> DataFrame:
    """Share and cumulative share of each category inside its format, largest first."""
    by_cat = _revenue_by(base, "format", "category")
    part = W.partitionBy("format")
    upto = part.orderBy(F.desc("gmv"), "category").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.sum(money("gmv")).over(part).cast("double")
    return (
        by_cat.withColumn("pct", ratio(F.col("gmv"), whole) * 100)
        .withColumn("cum_pct", ratio(F.sum(money("gmv")).over(upto).cast("double"), whole) * 100))


def p2_pareto_core(pareto: DataFrame, share: float = 80.0) -> DataFrame:
    """The leading categories needed to reach ``share`` percent of the format."""
    return pareto.filter(F.col("cum_pct") - F.col("pct") < share)


def p3_cohort_matrix(txn: DataFrame, max_month: int = 6, drop_last: int = 2,
                     mode: str = "calendar") -> DataFrame:
    """Retention percentages per cohort for months 0 to ``max_month``, zero where nobody came back.

    ``txn`` are clean transactions. The youngest ``drop_last`` cohorts have too little history and go.
    """
    return cohort_matrix(cohort_activity(txn, first="completed", mode=mode), max_month, drop_last)


def cohort_matrix(activity: DataFrame, max_month: int = 6, drop_last: int = 2) -> DataFrame:
    """The matrix of customers counted per cohort and month."""
    cells = [
        F.coalesce(pct(F.max(F.when(F.col("month_offset") == m, F.col("customers"))), F.max("cohort_size")), F.lit(0.0))
        .alias(f"m{m}") for m in range(max_month + 1)]
    matrix = activity.groupBy("cohort").agg(*cells)
    # One row per cohort month.
    youngest = F.dense_rank().over(W.orderBy(F.desc("cohort")))
    return matrix.withColumn("_age", youngest).filter(F.col("_age") > drop_last).drop("_age")


def p4_sales_daily(base: DataFrame) -> DataFrame:
    """Revenue per store, item, category and day; headers without lines have no item and are dropped."""
    known = base.dropna(subset=["store_id", "item_id", "category"])
    return known.groupBy("store_id", "item_id", "category", F.col("transaction_date").alias("fecha")).agg(
        line_total("revenue").alias("revenue"))


def p4_rotation(base: DataFrame) -> DataFrame:
    """Sale days and revenue per store and item."""
    return p4_sales_daily(base).groupBy("store_id", "item_id", "category").agg(
        F.count(F.lit(1)).alias("dias_con_venta"), line_total("revenue").alias("gmv_total"))


def p4_low_rotation(base: DataFrame, factor: float = 0.4, baseline: str = "global") -> DataFrame:
    """Per category: store-items selling on fewer than ``factor`` times the mean number of days.

    Store-items collapse to a table of (category, sale days) before the mean is taken, so the mean and the
    comparison come from the same small table and the sales are read once.
    """
    scope = {"global": [], "store_category": ["store_id", "category"]}[baseline]
    keys = sorted({"category", *scope})
    shape = p4_rotation(base).groupBy(*keys, "dias_con_venta").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("gmv_total")).alias("gmv"))
    # With the global baseline: categories times calendar days rows at most.
    part = W.partitionBy(*scope) if scope else W.partitionBy(F.lit(0))
    usual = F.sum(F.col("dias_con_venta") * F.col("n")).over(part) / F.sum("n").over(part)
    slow = shape.withColumn("_usual", usual).filter(F.col("dias_con_venta") < F.col("_usual") * factor)
    return slow.groupBy("category").agg(
        F.sum("n").alias("sku_oos"), F.sum("gmv").cast("double").alias("gmv_perdido_est"))


def p5_payment_mix(txn: DataFrame, stores: DataFrame,
                   methods: Sequence[str] | Mapping[str, str] = ("CASH", "CARD", "DIGITAL")) -> DataFrame:
    """Payment methods as percentages of each country's transactions, zero where unused.

    ``methods`` lists the values, or maps a column suffix to a value. Transactions combine per store first.
    """
    labels = methods if isinstance(methods, Mapping) else {m: m for m in methods}
    per_store = txn.filter(F.col("payment_method").isNotNull()).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("payment_method") == F.lit(v)).alias(k) for k, v in labels.items()])
    return (
        per_store.join(stores.select("store_id", "country"), "store_id").filter(F.col("country").isNotNull())
        .groupBy("country").agg(*[pct(F.sum(k), F.sum("n")).alias(f"pct_{k}") for k in labels]))
