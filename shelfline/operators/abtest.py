"""Store-level A/B test: assignment, weekly measures, Welch test, balance and power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import mean, ratio, total, week_start, within
from ..functions.relational import first_row
from ..functions.stats import normal_p, student_t_quantile, welch
from .quality import audit_dual_assignment


def ab_assign(promos: DataFrame, promo_type: str | None = None,
              grain: Sequence[str] = ("store_id", "promo_name")) -> DataFrame:
    """One variant per store; stores assigned to both variants are left out.

    A store with several rows takes its earliest promotion by start, name and variant.
    """
    mixed = audit_dual_assignment(promos, grain).select("store_id").distinct()
    if promo_type is not None:
        promos = promos.filter(F.col("promo_type") == promo_type)
    clean = promos.select("store_id", "start_date", "promo_name", "variant").join(mixed, "store_id", "left_anti")
    return first_row(clean, ["store_id"], ["start_date", "promo_name", "variant"]).select(
        "store_id", "variant", "promo_name")


def _in_test(txn: DataFrame, assign: DataFrame, start, end) -> DataFrame:
    return txn.filter(within("transaction_date", start, end)).join(
        assign.select("store_id", "variant"), "store_id")


def ab_weekly(txn: DataFrame, assign: DataFrame, start, end, full_weeks_only: bool = False) -> DataFrame:
    """Amount and transactions per store, variant and Monday week.

    Sales combine per store and week before the assignment is joined. ``full_weeks_only`` drops weeks that the
    test period covers in part.
    """
    per_week = txn.filter(within("transaction_date", start, end)).groupBy(
        "store_id", week_start("transaction_date").alias("week")
    ).agg(total("total_amount").alias("gmv"), F.count("transaction_id").alias("n_txn"))
    if full_weeks_only:
        per_week = per_week.filter(within("week", start, F.date_sub(F.lit(str(end)).cast("date"), 6)))
    return per_week.join(assign.select("store_id", "variant"), "store_id").select(
        "store_id", "variant", "week", "gmv", "n_txn")


def ab_store_avg(weekly: DataFrame) -> DataFrame:
    """Mean weekly amount and transactions per store, over the weeks with sales."""
    return weekly.groupBy("store_id", "variant").agg(
        mean("gmv").alias("avg_gmv_week"), F.avg("n_txn").alias("avg_txn_week"))


def ab_welch(store_avg: DataFrame, value: str = "avg_gmv_week", by: Sequence[str] = ()) -> DataFrame:
    return welch(store_avg, value, by)


def ab_ci(stats: DataFrame, ci: str = "z", z: float = 1.96, alpha: float = 0.05) -> DataFrame:
    """Confidence interval of the difference and the verdict; ``ci='t'`` uses Student's quantile."""
    width = {"z": F.lit(z), "t": student_t_quantile(alpha, F.col("df"))}[ci] * F.col("se")
    return (
        stats.withColumn("ci_low", F.col("diff_abs") - width).withColumn("ci_high", F.col("diff_abs") + width)
        .withColumn("significativo", F.col("p_value") < alpha))


def ab_box_stats(store_avg: DataFrame, value: str = "avg_gmv_week") -> DataFrame:
    """Quartiles per variant (one input row per store)."""
    cuts = F.percentile(F.col(value), F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return store_avg.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), cuts.alias("_q")).select(
        "variant", "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(("minimo", "q1", "mediana", "q3", "maximo"))])


def ab_ticket_frequency(txn: DataFrame, assign: DataFrame, start, end) -> DataFrame:
    """Mean over stores of their ticket and their number of transactions, per variant."""
    per_store = txn.filter(within("transaction_date", start, end)).groupBy("store_id").agg(
        mean("total_amount").alias("ticket"), F.count("transaction_id").alias("freq"))
    return per_store.join(assign.select("store_id", "variant"), "store_id").groupBy("variant").agg(
        F.avg("ticket").alias("ticket"), F.avg("freq").alias("frecuencia"))


def ab_pre_period_check(txn: DataFrame, assign: DataFrame, start, end, alpha: float = 0.05) -> DataFrame:
    """The same test on a window before the experiment; ``comparable_pre`` when no difference shows."""
    stats = ab_welch(ab_store_avg(ab_weekly(txn, assign, start, end)))
    return stats.withColumn("comparable_pre", F.col("p_value") >= alpha)


def ab_by_format(store_avg: DataFrame, stores: DataFrame) -> DataFrame:
    """The test inside each store format."""
    return ab_welch(store_avg.join(stores.select("store_id", "format"), "store_id"), by=["format"])


def ab_rank_balance(store_avg: DataFrame, value: str = "avg_gmv_week") -> DataFrame:
    """Mann-Whitney test of balance with mid-ranks, tie-corrected normal approximation.

    Equal values collapse to one row. Ranks inside a value bin plus the number of rows in lower bins give the
    overall rank, so no window spans all rows; bins are counted in a table of at most a few thousand rows.
    """
    v = F.col(value)
    ties = store_avg.filter(v.isNotNull()).groupBy(v.alias("_v")).agg(
        F.count_if(F.col("variant") == "TREATMENT").alias("_t"), F.count_if(F.col("variant") == "CONTROL").alias("_c"),
    ).withColumn("_n", F.col("_t") + F.col("_c")).withColumn(
        "_bin", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 64))
    bins = ties.groupBy("_bin").agg(F.sum("_n").alias("_in_bin"))
    before = F.sum("_in_bin").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_in_bin")
    inside = W.partitionBy("_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.col("_n")
    ranked = ties.join(bins.withColumn("_before", before), "_bin").withColumn(
        "_rank", F.col("_before") + F.sum(n).over(inside) - (n - 1) / 2)
    sums = ranked.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_control"), F.coalesce(F.sum("_t"), F.lit(0)).alias("n_treatment"),
        F.sum(F.col("_rank") * F.col("_t")).alias("_ranks"), F.sum(n * n * n - n).cast("double").alias("_tied"))
    n1, n2 = F.col("n_treatment").cast("double"), F.col("n_control").cast("double")
    size = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (size + 1 - ratio(F.col("_tied"), size * (size - 1))))
    return (
        sums.withColumn("u", F.col("_ranks") - n1 * (n1 + 1) / 2)
        .withColumn("z", ratio(F.col("u") - n1 * n2 / 2, spread))
        .withColumn("p_value", normal_p(F.col("z")))
        .select("n_control", "n_treatment", "u", "z", "p_value"))


def ab_mde(stats: DataFrame, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> DataFrame:
    """Smallest difference the test could detect; the defaults are 5 % two-sided and 80 % power."""
    return stats.withColumn("mde_abs", F.lit(z_alpha + z_power) * F.col("se")).withColumn(
        "mde_pct", ratio(F.col("mde_abs"), F.col("mean_control")) * 100)
