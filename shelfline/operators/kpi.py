"""KPI framework: the north star, nine KPIs and the checks that spot bad data behind them.

``facts`` are rows of ``fact_sales``; returned sales are left out of revenue. Everything is combined per store
(or item) and period before dimensions are joined, so windows see one row per store and period.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import (
    as_date, count_when, growth_pct, is_completed, line_total, money, month_number, month_start, pct, period_start,
    quarter_start, ratio, total, week_start)
from ..functions.relational import dense_periods
from .business import cohort_activity

# Fixed targets of the framework.
TICKET_TARGETS = {"HIPERMERCADO": 350.0, "SUPERMERCADO": 250.0, "DESCUENTO": 150.0, "EXPRESS": 80.0}
GMROI_TARGETS = {"A": 1.5, "B": 1.2, "C": 1.0}
GROWTH_TARGET, RETENTION_TARGET, RETURN_TARGET, LOYALTY_TARGET, OOS_TARGET = 5.0, 35.0, 2.5, 45.0, 5.0


def _against(df: DataFrame, value: str, target: float, at_least: bool = True) -> DataFrame:
    """``target`` and whether ``value`` meets it, null where there is no value."""
    met = F.col(value) >= F.lit(target) if at_least else F.col(value) <= F.lit(target)
    return df.withColumn("target", F.lit(target)).withColumn("cumple", met)


def _lookup(table: Mapping[str, float], key: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(key))


def store_periods(facts: DataFrame, period: str) -> DataFrame:
    """Revenue per store and period, without returned sales."""
    return facts.filter(~F.col("is_returned")).groupBy("store_id", period_start("date_id", period).alias(period)).agg(
        line_total("gross_revenue").alias("gmv"))


def kpi_north_star(facts: DataFrame, stores: DataFrame) -> DataFrame:
    """Weekly revenue of comparable stores over the floor space of all comparable stores."""
    comparable = stores.filter("is_comparable").select("store_id", "size_sqm")
    space = comparable.agg(F.sum("size_sqm").cast("double").alias("m2"))
    weekly = store_periods(facts, "week").join(comparable.select("store_id"), "store_id")
    return weekly.groupBy("week").agg(F.sum(money("gmv")).cast("double").alias("gmv")).withColumn(
        "comp_gmv_m2", ratio(F.col("gmv"), space.scalar()))


def kpi1_comp_growth(facts: DataFrame, stores: DataFrame, target: float = GROWTH_TARGET,
                     monthly: DataFrame | None = None) -> DataFrame:
    """Monthly and year-to-date growth of comparable stores over the year before.

    Months without sales count as zero, so twelve rows back is the same month a year ago. ``monthly``, the facts'
    ``store_periods``, saves reading the facts again.
    """
    comparable = stores.filter("is_comparable").select("store_id")
    sold = store_periods(facts, "month") if monthly is None else monthly
    monthly = dense_periods(
        sold.join(comparable, "store_id"), ["store_id"], "month", ["gmv"], "1 month")
    by_month = W.partitionBy("store_id").orderBy("month")
    ytd = W.partitionBy("store_id", F.year("month")).orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = monthly.withColumn("ytd", F.sum(money("gmv")).over(ytd).cast("double"))
    return (
        summed.withColumn("gmv_prior", F.lag("gmv", 12).over(by_month))
        .withColumn("ytd_prior", F.lag("ytd", 12).over(by_month))
        .withColumn("growth_pct", growth_pct(F.col("gmv"), F.col("gmv_prior")))
        .withColumn("ytd_growth_pct", growth_pct(F.col("ytd"), F.col("ytd_prior")))
        .transform(_against, "growth_pct", float(target)))


def kpi2_gmv_sqm(facts: DataFrame, stores: DataFrame, period: str = "week",
                 sums: DataFrame | None = None) -> DataFrame:
    """Revenue per square metre and store; under the format's median, or in its lowest quarter.

    A store's silent periods between its first and last sale appear with zero. ``sums``, the facts'
    ``store_periods``, saves reading the facts again.
    """
    sold = dense_periods(store_periods(facts, period) if sums is None else sums, ["store_id"], period, ["gmv"], f"1 {period}")
    per_m2 = sold.join(stores.select("store_id", "format", "size_sqm"), "store_id").withColumn(
        "gmv_m2", ratio(F.col("gmv"), F.col("size_sqm"))).drop("size_sqm")
    peers = W.partitionBy("format", period)
    cuts = F.percentile("gmv_m2", F.array(F.lit(0.25), F.lit(0.5))).over(peers)
    return per_m2.withColumn("_cuts", cuts).withColumn(
        "estado", F.when(F.col("gmv_m2") < F.col("_cuts")[0], "PLAN_DE_MEJORA")
        .when(F.col("gmv_m2") < F.col("_cuts")[1], "BAJO_TARGET").otherwise("OK")).drop("_cuts")


def kpi3_ticket(txn: DataFrame, stores: DataFrame, targets: Mapping[str, float] = TICKET_TARGETS) -> DataFrame:
    """Weekly average ticket of completed sales by format, against target and the week before."""
    per_store = txn.filter(is_completed()).groupBy("store_id", week_start("transaction_date").alias("week")).agg(
        F.sum(money("total_amount")).alias("amount"), F.count("transaction_id").alias("n"))
    by_format = per_store.join(stores.select("store_id", "format"), "store_id").groupBy("format", "week").agg(
        F.sum("amount").cast("double").alias("amount"), F.sum("n").alias("n_transacciones"))
    ticket = by_format.withColumn("ticket", ratio(F.col("amount"), F.col("n_transacciones"))).drop("amount")
    prev = W.partitionBy("format").orderBy("week")
    adjacent = F.datediff("week", F.lag("week").over(prev)) == 7
    return (
        ticket.withColumn("ticket_previo", F.when(adjacent, F.lag("ticket").over(prev)))
        .withColumn("variacion_pct", growth_pct(F.col("ticket"), F.col("ticket_previo")))
        .withColumn("target", _lookup(targets, "format"))
        .withColumn("cumple", F.col("ticket") >= F.col("target")))


def kpi4_retention_m1(txn: DataFrame, by: Sequence[str] = (), as_of=None, target: float = RETENTION_TARGET) -> DataFrame:
    """Share of each month's new loyal customers who buy in the month after.

    Measured once that month is over: while it ends after ``as_of``, by default the last sale day, the figures are
    null. With ``by=['store_id']`` a customer belongs to the store of the first purchase.
    """
    last = txn.agg(F.max("transaction_date")).scalar() if as_of is None else as_date(as_of)
    over = F.last_day(F.add_months("cohort", 1)) <= last
    next_month = F.max(F.when(F.col("month_offset") == 1, F.col("customers")))
    return cohort_activity(txn, by).groupBy(*by, "cohort").agg(
        F.max("cohort_size").alias("cohort_size"), F.coalesce(next_month, F.lit(0)).alias("_active"),
    ).withColumn("active_m1", F.when(over, F.col("_active"))).drop("_active").withColumn(
        "retencion_m1_pct", pct(F.col("active_m1"), F.col("cohort_size"))).transform(
        _against, "retencion_m1_pct", float(target))


def kpi5_return_rate(txn: DataFrame, by: Sequence[str] = ("store_id",), target: float = RETURN_TARGET) -> DataFrame:
    """Weekly share of returned transactions."""
    return txn.groupBy(*by, week_start("transaction_date").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), count_when(F.col("status") == "RETURNED").alias("devueltas"),
    ).withColumn("tasa_devolucion_pct", pct(F.col("devueltas"), F.col("n"))).transform(
        _against, "tasa_devolucion_pct", float(target), False)


def kpi6_loyalty_rate(txn: DataFrame, by: Sequence[str] = ("store_id",), period: str = "month",
                      target: float = LOYALTY_TARGET) -> DataFrame:
    """Share of transactions with a loyalty card, monthly or per day."""
    return txn.groupBy(*by, period_start("transaction_date", period).alias(period)).agg(
        F.count(F.lit(1)).alias("n"), count_when(F.col("loyalty_card")).alias("con_lealtad"),
    ).withColumn("penetracion_pct", pct(F.col("con_lealtad"), F.col("n"))).transform(
        _against, "penetracion_pct", float(target))


def kpi7_gmroi_vendor(facts: DataFrame, products: DataFrame, vendors: DataFrame,
                      targets: Mapping[str, float] = GMROI_TARGETS) -> DataFrame:
    """Quarterly gross margin over cost per vendor, against the target of its tier."""
    per_item = facts.filter(~F.col("is_returned")).groupBy("product_id", quarter_start("date_id").alias("quarter")).agg(
        line_total("gross_revenue").alias("revenue"),
        line_total(F.col("unit_cost") * F.col("quantity")).alias("cost"))
    per_vendor = (
        per_item.join(products.select(F.col("item_id").alias("product_id"), "vendor_id"), "product_id")
        .groupBy("vendor_id", "quarter").agg(
            total("revenue").alias("revenue"), total("cost").alias("cost"))
        .join(vendors.select("vendor_id", "vendor_name", "tier"), "vendor_id"))
    return (
        per_vendor.withColumn("gmroi", ratio(F.col("revenue") - F.col("cost"), F.col("cost")))
        .withColumn("target", _lookup(targets, "tier")).withColumn("cumple", F.col("gmroi") >= F.col("target")))


def oos_counts(daily: DataFrame, by: Sequence[str] = (), min_gap: int = 3, min_days: int = 7) -> DataFrame:
    """Active store-items per month, and those of them with a gap of ``min_gap`` days or more touching it.

    A store-item is active from the month of its first sale to that of its last. ``daily`` is the result of
    ``daily_item_sales``. Every span of months adds one where it begins and takes it off after its end, so a month's
    count is a running sum and no store-item is laid out over its months. A pair's gaps follow one another, so only the
    month in which one ends and the next begins could count twice; it is left to the earlier gap.
    """
    by_day = W.partitionBy("store_id", "item_id").orderBy("fecha_venta")
    all_days = by_day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_day.rowsBetween(W.unboundedPreceding, -1)
    sold = F.col("fecha_venta")
    long_gap = F.datediff(sold, "_prev") - 1 >= min_gap
    days = (
        daily.filter(sold.isNotNull()).select("store_id", "item_id", "fecha_venta")
        .withColumns({"_prev": F.lag(sold).over(by_day), "_next": F.lead(sold).over(by_day),
                      "_days": F.count(sold).over(all_days)})
        .withColumns({"_lo": F.when(long_gap, month_start(F.date_add("_prev", 1))),
                      "_hi": F.when(long_gap, month_start(F.date_sub(sold, 1)))})
        .withColumn("_done", F.max("_hi").over(before))
        .filter(F.col("_days") >= min_days)
        .withColumn("_lo", F.when(F.col("_lo") <= F.col("_done"), F.add_months("_done", 1)).otherwise(F.col("_lo"))))

    def change(when: Column, month: Column, active: int, broken: int) -> Column:
        return F.when(when, F.struct(
            month.alias("month"), F.lit(active).alias("_active"), F.lit(broken).alias("_broken")))

    lasting, after_gap = F.col("_lo") <= F.col("_hi"), F.add_months("_hi", 1)
    changes = days.select(*by, F.explode(F.array(
        change(F.col("_prev").isNull(), month_start(sold), 1, 0),
        change(F.col("_next").isNull(), F.add_months(month_start(sold), 1), -1, 0),
        change(lasting, F.col("_lo"), 0, 1), change(lasting, after_gap, 0, -1))).alias("_change")).filter(
        F.col("_change").isNotNull()).select(*by, "_change.*")
    upto = W.partitionBy(*by).orderBy("month")  # one row per month
    levels = changes.groupBy(*by, "month").agg(
        F.sum("_active").alias("_active"), F.sum("_broken").alias("_broken")).select(
        *by, F.sum("_active").over(upto).alias("activos"), F.sum("_broken").over(upto).alias("con_quiebre"),
        F.sequence(F.col("month"), F.add_months(F.lead("month").over(upto), -1), F.expr("interval 1 month"))
        .alias("_months")).filter(F.col("activos") > 0)
    return levels.select(*by, F.explode("_months").alias("month"), "activos", "con_quiebre")


def kpi8_oos_rate(daily: DataFrame, by: Sequence[str] = (), min_gap: int = 3, min_days: int = 7,
                  target: float = OOS_TARGET, counts: DataFrame | None = None) -> DataFrame:
    """Share of active store-items with a gap of ``min_gap`` days or more touching the month.

    ``counts``, the ``oos_counts`` of ``daily`` by the same or more columns, saves reading the sales again.
    """
    per_month = oos_counts(daily, by, min_gap, min_days) if counts is None else counts.groupBy(*by, "month").agg(
        F.sum("activos").alias("activos"), F.sum("con_quiebre").alias("con_quiebre"))
    return per_month.withColumn("oos_pct", pct(F.col("con_quiebre"), F.col("activos"))).transform(
        _against, "oos_pct", float(target), False)


def zscore(value: str, part: Sequence[str]) -> Column:
    """Standard score inside a part; null when the part has no spread."""
    over = W.partitionBy(*part)
    spread = F.max(value).over(over) > F.min(value).over(over)
    return F.when(spread, (F.col(value) - F.avg(value).over(over)) / F.stddev_samp(value).over(over))


def kpi9_store_score(kpi1: DataFrame, kpi2: DataFrame, kpi4: DataFrame) -> DataFrame:
    """Monthly store score: 0.5 z(GMV/m² in its format) + 0.3 z(retention) + 0.2 z(growth).

    ``kpi2`` is monthly and ``kpi4`` per store. A missing component makes the score null by design.
    """
    joined = (
        kpi2.select("store_id", "format", "month", "gmv_m2")
        .join(kpi4.select("store_id", F.col("cohort").alias("month"), "retencion_m1_pct"), ["store_id", "month"], "left")
        .join(kpi1.select("store_id", "month", "growth_pct"), ["store_id", "month"], "left"))
    scored = (
        joined.withColumn("z_gmv_m2", zscore("gmv_m2", ["format", "month"]))
        .withColumn("z_retencion", zscore("retencion_m1_pct", ["month"]))
        .withColumn("z_crecimiento", zscore("growth_pct", ["month"])))
    score = 0.5 * F.col("z_gmv_m2") + 0.3 * F.col("z_retencion") + 0.2 * F.col("z_crecimiento")
    return scored.select("store_id", "format", "month", "z_gmv_m2", "z_retencion", "z_crecimiento",
                         score.alias("score")).withColumn("plan_intervencion", F.col("score") < -1)


def _flagged(df: DataFrame, kpi: str, unit: Column, period: str, *rules: tuple[str, Column, Column]) -> DataFrame:
    """The rows of one frame that break any of ``rules`` (name, value, condition): the frame is run once."""
    broken = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(rule).alias("regla"), value.cast("double").alias("valor")))
        for rule, value, bad in rules]))
    return df.select(F.lit(kpi).alias("kpi"), unit.cast("string").alias("unidad"),
                     F.col(period).cast("date").alias("periodo"), F.inline(broken)).withColumn("marcado", F.lit(True))


def _network() -> Column:
    return F.lit("RED")


def kpi_checks(kpis: Mapping[str, DataFrame], large_cohort: int = 100) -> DataFrame:
    """Every sign of bad data in the given KPI frames, one row per unit, period and rule.

    No retention at all counts for cohorts of ``large_cohort`` customers or more only, a GMROI above 10 for vendors
    with at least the quarter's mean revenue.

    Recognised keys: ``kpi1`` ... ``kpi9``; ``kpi6_day`` is the daily form of KPI 6, ``kpi8_store`` the form of
    KPI 8 per store. Frames that are not given are not checked.
    """
    found: list[DataFrame] = []
    store = F.col("store_id")

    if "kpi1" in kpis:
        known = kpis["kpi1"].filter(F.col("growth_pct").isNotNull())
        monthly = known.groupBy("month").agg(
            pct(F.count_if(F.col("growth_pct") == 0), F.count(F.lit(1))).alias("zero_pct"),
            growth_pct(F.sum(money("gmv")).cast("double"), F.sum(money("gmv_prior")).cast("double")).alias("growth"))
        step = F.col("growth") - F.lag("growth").over(W.orderBy("month"))  # one row per month
        found.append(_flagged(
            monthly.withColumn("step", step), "kpi1", _network(), "month",
            ("mas_20pct_tiendas_en_cero", F.col("zero_pct"), F.col("zero_pct") > 20),
            ("sube_mas_30_en_un_mes", F.col("step"), F.col("step") > 30)))

    if "kpi2" in kpis:
        frame = kpis["kpi2"]
        period = next(p for p in ("week", "month", "day", "quarter") if p in frame.columns)
        peers = W.partitionBy("format", period)
        usual = F.sum(F.col("gmv_m2")).over(peers) / F.count("gmv_m2").over(peers)
        found.append(_flagged(
            frame.withColumn("_usual", usual), "kpi2", store, period,
            ("cero_en_tienda_activa", F.col("gmv_m2"), F.col("gmv_m2") == 0),
            ("diez_veces_el_formato", F.col("gmv_m2"), F.col("gmv_m2") > 10 * F.col("_usual"))))

    if "kpi3" in kpis:
        found.append(_flagged(
            kpis["kpi3"], "kpi3", F.col("format"), "week",
            ("ticket_fuera_de_rango", F.col("ticket"), (F.col("ticket") < 5) | (F.col("ticket") > 5000)),
            ("varia_mas_30pct", F.col("variacion_pct"), F.abs("variacion_pct") > 30)))

    if "kpi4" in kpis:
        frame, rate = kpis["kpi4"], F.col("retencion_m1_pct")
        unit = store if "store_id" in frame.columns else _network()
        found.append(_flagged(frame, "kpi4", unit, "cohort", (
            "retencion_100_o_0", rate, (rate == 100) | ((rate == 0) & (F.col("cohort_size") >= large_cohort)))))

    if "kpi5" in kpis:
        frame, rate = kpis["kpi5"], F.col("tasa_devolucion_pct")
        week = F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7)
        last4 = W.partitionBy("store_id").orderBy("_w").rangeBetween(-3, 0)
        runs = frame.withColumn("_w", week).withColumns({
            "_n": F.count(rate).over(last4), "_lo": F.min(rate).over(last4), "_hi": F.max(rate).over(last4)})
        found.append(_flagged(
            runs, "kpi5", store, "week", ("devolucion_mayor_10", rate, rate > 10),
            ("igual_4_semanas", rate, (F.col("_n") == 4) & (F.col("_lo") == F.col("_hi")))))

    for name, period in (("kpi6", "month"), ("kpi6_day", "day")):
        if name not in kpis:
            continue
        rate = F.col("penetracion_pct")
        before = F.lag("penetracion_pct").over(W.partitionBy("store_id").orderBy(period))
        rules = [("salto_a_100", rate, (rate == 100) & (F.col("_before") < 100))]
        if period == "day":
            rules.append(("cero_en_un_dia", rate, rate == 0))
        found.append(_flagged(kpis[name].withColumn("_before", before), "kpi6", store, period, *rules))

    if "kpi7" in kpis:
        gmroi = F.col("gmroi")
        found.append(_flagged(
            kpis["kpi7"].withColumn("_usual", F.avg("revenue").over(W.partitionBy("quarter"))), "kpi7",
            F.col("vendor_id"), "quarter", ("gmroi_negativo", gmroi, gmroi < 0),
            ("gmroi_mayor_10", gmroi, (gmroi > 10) & (F.col("revenue") >= F.col("_usual")))))

    if "kpi8_store" in kpis:
        found.append(_flagged(kpis["kpi8_store"], "kpi8", store, "month",
                              ("tienda_100pct", F.col("oos_pct"), F.col("oos_pct") == 100)))
    if "kpi8" in kpis:
        order = W.orderBy("month")  # one row per month
        frame = kpis["kpi8"].withColumn("_prev", F.lag("oos_pct").over(order)).withColumn(
            "_gap", month_number("month") - F.lag(month_number("month")).over(order))
        found.append(_flagged(frame, "kpi8", _network(), "month", (
            "cero_2_meses", F.col("oos_pct"), (F.col("oos_pct") == 0) & (F.col("_prev") == 0) & (F.col("_gap") == 1))))

    if "kpi9" in kpis:
        frame, score = kpis["kpi9"], F.col("score")
        monthly = frame.groupBy("month").agg(F.count("score").alias("n"), F.max(F.abs("score")).alias("largest"))
        found += [
            _flagged(frame, "kpi9", store, "month", ("componente_nulo", score, score.isNull())),
            _flagged(monthly, "kpi9", _network(), "month",
                     ("todos_en_cero", F.col("largest"), (F.col("n") > 0) & (F.col("largest") == 0)))]

    return reduce(DataFrame.unionByName, found)
