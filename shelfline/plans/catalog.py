"""The registered queries: each operator over the whole test tables seen through the adapter."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import relational as rel
from ..functions.columns import as_date, line_revenue, total
from ..operators import abtest, aggregates, base, business, cohorts, explore, incremental, kpi, quality, star, temporal
from ..session import scratch_path
from ..sources import adapter, readers, writers
from ..streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed periods on the test data.
CUR, PRIOR = ("1999-01-01", "1999-06-30"), ("1998-01-01", "1998-06-30")
QUARTER = ("1999-04-01", "1999-06-30")
TEST = ("1999-03-01", "1999-08-31")
BEFORE_TEST = ("1998-09-01", "1999-02-28")
AS_OF = "2001-07-15"
COMPARABLE_AS_OF = "1996-03-01"
PAYMENTS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "not_specified": "4-NOT SPECIFIED",
            "low": "5-LOW"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _clean(spark: SparkSession, d: str, start=None, end=None) -> DataFrame:
    return base.clean_transactions(adapter.transactions(spark, d, start, end), adapter.stores(spark, d))


def _base(spark: SparkSession, d: str, categories: bool = False) -> DataFrame:
    products = adapter.item_categories(spark, d) if categories else None
    return base.sales_base(
        _clean(spark, d), adapter.stores(spark, d), adapter.transaction_items(spark, d), products)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts without the arrival stamp; the column itself is part of ``fact_sales``."""
    return star.fact_sales(
        adapter.transaction_items(spark, d), adapter.transactions(spark, d), adapter.item_categories(spark, d),
        adapter.store_promotions(spark, d), F.lit(None).cast("timestamp"))


def _assign(spark: SparkSession, d: str) -> DataFrame:
    return abtest.ab_assign(adapter.store_promotions(spark, d))


def _store_avg(spark: SparkSession, d: str) -> DataFrame:
    return abtest.ab_store_avg(abtest.ab_weekly(_clean(spark, d, *TEST), _assign(spark, d), *TEST))


def _dim_store(spark: SparkSession, d: str) -> DataFrame:
    return star.dim_store(adapter.stores(spark, d), COMPARABLE_AS_OF)


# --- sources, sinks, base tables -------------------------------------------------------------------------


@query
def load_tables(spark, d):
    """The six tables stored as typed parquet and read back by their fixed layout."""
    root = scratch_path(spark, "tables")
    tables = adapter.load(spark, d)
    for name, df in tables.items():
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in readers.TABLES[name].fields]) \
            .write.parquet(f"{root}/{name}.parquet")
    loaded = readers.load_tables(spark, root, "parquet")
    items = loaded["transaction_items"].groupBy("transaction_id").agg(F.sum("quantity").alias("units"))
    return loaded["transactions"].join(items, "transaction_id", "left").withColumn(
        "total_amount", F.col("total_amount").cast("double"))


@query
def register_views(spark, d):
    readers.register_views(adapter.load(spark, d))
    return spark.sql("""
        SELECT s.country, t.status, count(*) AS n, CAST(sum(t.total_amount) AS double) AS gmv
        FROM transactions t JOIN stores s USING (store_id) GROUP BY s.country, t.status""")


@query
def table_row_counts(spark, d):
    return readers.table_row_counts(adapter.load(spark, d))


@query
def clean_transactions(spark, d):
    return _clean(spark, d).withColumn("total_amount", F.col("total_amount").cast("double"))


@query
def excluded_rows(spark, d):
    return base.excluded_rows(
        adapter.transactions(spark, d), adapter.transaction_items(spark, d), adapter.stores(spark, d))


@query
def sales_base(spark, d):
    return _base(spark, d, categories=True).select(
        "transaction_id", "store_id", "transaction_date", "format", "country", "item_id", "category", "cost",
        "quantity", "revenue")


@query
def write_result(spark, d):
    path = scratch_path(spark, "result")
    weekly = explore.p1_weekly_gmv(_base(spark, d))
    writers.write_result(weekly, path, "json")
    return spark.read.schema(weekly.schema).json(path)


@query
def write_partitioned(spark, d):
    path = scratch_path(spark, "facts-by-month")
    facts = _facts(spark, d).withColumn("month_id", F.trunc("date_id", "month"))
    writers.write_partitioned(facts, path, "month_id")
    return spark.read.parquet(path).groupBy("month_id").agg(F.count(F.lit(1)).alias("lines"), total("gross_revenue").alias("revenue"))


@query
def analysis_summary(spark, d):
    return base.analysis_summary(_clean(spark, d), adapter.stores(spark, d), adapter.transaction_items(spark, d))


@query
def analysis_summary_headers(spark, d):
    return base.analysis_summary(_clean(spark, d), adapter.stores(spark, d))


# --- data-quality audit ----------------------------------------------------------------------------------


@query
def audit_completeness(spark, d):
    return quality.audit_completeness(adapter.headers(spark, d))


@query
def audit_header_vs_lines(spark, d):
    return quality.audit_header_vs_lines(adapter.headers(spark, d), adapter.transaction_items(spark, d))


@query
def audit_top_discrepancies(spark, d):
    return quality.audit_top_discrepancies(adapter.transactions(spark, d), adapter.transaction_items(spark, d))


@query
def audit_uniqueness(spark, d):
    return quality.audit_uniqueness({
        "transactions": (adapter.transactions(spark, d), ["transaction_id"]),
        "tx_items": (adapter.transaction_items(spark, d), ["transaction_item_id"])})


@query
def audit_duplicate_keys(spark, d):
    return quality.audit_duplicate_keys(adapter.transaction_items(spark, d), ["transaction_item_id"])


@query
def dedupe_keep_last(spark, d):
    lines = adapter.raw(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("transaction_item_id"),
        F.col("l_shipdate").cast("date").alias("sale_day"), F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("vendor_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("revenue"))
    return quality.dedupe_keep_last(lines, ["transaction_item_id"], ["sale_day"])


@query
def audit_amount_validity(spark, d):
    return quality.audit_amount_validity(adapter.headers(spark, d))


@query
def audit_invalid_rows(spark, d):
    return quality.audit_invalid_rows(adapter.transactions(spark, d))


@query
def audit_zero_price(spark, d):
    return quality.audit_zero_price(adapter.transaction_items(spark, d))


@query
def audit_orphans(spark, d):
    return quality.audit_orphans(
        adapter.products(spark, d), adapter.vendors(spark, d), "vendor_id", "productos_afectados")


@query
def audit_orphan_stores(spark, d):
    return quality.audit_orphans(
        adapter.transactions(spark, d), adapter.stores(spark, d), "store_id", "transacciones_huerfanas")


@query
def audit_sales_gaps(spark, d):
    return quality.audit_sales_gaps(adapter.transactions(spark, d))


@query
def audit_gap_summary(spark, d):
    return quality.audit_gap_summary(adapter.transactions(spark, d))


@query
def audit_pre_opening(spark, d):
    return quality.audit_pre_opening(adapter.transactions(spark, d), adapter.stores(spark, d))


@query
def audit_pre_opening_totals(spark, d):
    return quality.audit_pre_opening_totals(adapter.transactions(spark, d), adapter.stores(spark, d))


@query
def audit_dual_assignment(spark, d):
    return quality.audit_dual_assignment(adapter.store_promotions(spark, d))


@query
def audit_assignment_overlap(spark, d):
    return quality.audit_assignment_overlap(adapter.store_promotions(spark, d))


@query
def audit_variant_sizes(spark, d):
    return quality.audit_variant_sizes(adapter.store_promotions(spark, d))


@query
def audit_scorecard(spark, d):
    return quality.audit_scorecard(adapter.transactions(spark, d))


@query
def audit_findings(spark, d):
    return quality.audit_findings(adapter.load(spark, d))


# --- business queries ------------------------------------------------------------------------------------


@query
def q1_comp_sales(spark, d):
    return business.q1_comp_sales(
        adapter.transactions(spark, d, PRIOR[0], CUR[1]), adapter.stores(spark, d), CUR, PRIOR)


@query
def q2_sqm_productivity(spark, d):
    return business.q2_sqm_productivity(adapter.transactions(spark, d, *QUARTER), adapter.stores(spark, d), QUARTER)


@query
def q3_cohort_retention(spark, d):
    return business.q3_cohort_retention(adapter.headers(spark, d))


@query
def q4_gmroi(spark, d):
    return business.q4_gmroi(
        adapter.transaction_items(spark, d), adapter.headers(spark, d), adapter.products(spark, d),
        adapter.vendors(spark, d))


def _shelf_args(spark, d):
    t = adapter.shelf(spark, d)
    return t["lines_with_header"], None, t["stores"], t["products"]


def _shelf_daily(spark, d):
    return business.daily_item_sales(adapter.shelf(spark, d)["lines_with_header"])


@query
def q5_stockouts(spark, d):
    return business.q5_stockouts(*_shelf_args(spark, d))


@query
def q5_stockouts_all(spark, d):
    return business.q5_stockouts(*_shelf_args(spark, d), n=None)


@query
def q5_stockouts_calendar(spark, d):
    return business.q5_stockouts_calendar(*_shelf_args(spark, d))


@query
def q5_stockout_totals(spark, d):
    totals = business.stockout_totals(business.stockout_gaps(_shelf_daily(spark, d)))
    return rel.rounded(totals, total_lost_gmv=0)


@query
def q6_promo_uplift(spark, d):
    return business.q6_promo_uplift(
        adapter.transaction_items(spark, d), adapter.headers(spark, d), adapter.item_categories(spark, d))


@query
def period_total(spark, d):
    return rel.period_total(adapter.transactions(spark, d, *CUR), *CUR)


@query
def comparable_stores(spark, d):
    return rel.comparable_stores(adapter.stores(spark, d), "1995-02-15").select("store_id", "opening_date")


@query
def rank_within(spark, d):
    sold = rel.period_total(adapter.transactions(spark, d, *CUR), *CUR)
    stores = adapter.stores(spark, d).select("store_id", "format")
    return rel.rank_within(sold.join(stores, "store_id"), "format", F.desc("gmv"), "puesto")


@query
def below_percentile_flag(spark, d):
    sold = rel.period_total(adapter.transactions(spark, d, *CUR), *CUR)
    stores = adapter.stores(spark, d).select("store_id", "format")
    return rel.below_percentile_flag(sold.join(stores, "store_id"), "format", "gmv", 0.25)


@query
def islands(spark, d):
    days = adapter.transactions(spark, d).select("store_id", "transaction_date").distinct()
    return rel.islands(days, ["store_id"], "transaction_date")


@query
def pivot_metrics(spark, d):
    counts = adapter.transactions(spark, d).groupBy("store_id", "status").agg(
        F.count(F.lit(1)).alias("n"), total("total_amount").alias("gmv"))
    return rel.pivot_metrics(
        counts, ["store_id"], "status", {"done": "COMPLETED", "returned": "RETURNED"}, ["n", "gmv"])


@query
def any_flag_per_group(spark, d):
    return business.basket_promo_flag(adapter.transaction_items(spark, d))


@query
def exact_quantile(spark, d):
    amounts = adapter.headers(spark, d).select("status", F.col("total_amount").cast("double").alias("amount"))
    return rel.exact_quantile(rel.value_counts(amounts, "amount", ["status"]), "amount", 0.9, ["status"], "p90")


# --- exploration -----------------------------------------------------------------------------------------


@query
def p1_weekly_gmv(spark, d):
    return explore.p1_weekly_gmv(_base(spark, d))


@query
def p1_peaks_troughs(spark, d):
    return explore.p1_peaks_troughs(explore.p1_weekly_gmv(_base(spark, d)))


@query
def p1_seasonality(spark, d):
    return rel.rounded(explore.p1_seasonality(explore.p1_weekly_gmv(_base(spark, d))), cv=6)


@query
def p1_seasonal_strength(spark, d):
    strength = explore.p1_seasonal_strength(explore.p1_weekly_gmv(_base(spark, d)))
    return rel.rounded(strength, tendencia=3, amplitud=3, dia_pico=4, fuerza=6)


@query
def p2_pareto(spark, d):
    return explore.p2_pareto(_base(spark, d, categories=True))


@query
def p2_pareto_core(spark, d):
    return explore.p2_pareto_core(explore.p2_pareto(_base(spark, d, categories=True)))


@query
def p3_cohort_matrix(spark, d):
    return explore.p3_cohort_matrix(_clean(spark, d))


@query
def p3_cohort_matrix_bits(spark, d):
    """Bitmaps of all months but the last, then those of the last two loaded into them."""
    sales = _clean(spark, d)
    until = sales.agg(F.trunc(F.max("transaction_date"), "month").alias("m")).select("m").scalar()
    before = _stored(spark, cohorts.month_bits(sales.filter(F.col("transaction_date") < until)))
    last = cohorts.month_bits(sales.filter(F.col("transaction_date") >= F.add_months(until, -1)))
    return explore.cohort_matrix(cohorts.activity_of_bits(cohorts.merged_bits(before, last)))


@query
def p3_cohort_matrix_days30(spark, d):
    return explore.p3_cohort_matrix(_clean(spark, d), mode="days30")


@query
def p4_sales_daily(spark, d):
    return explore.p4_sales_daily(_base(spark, d, categories=True))


@query
def p4_low_rotation(spark, d):
    lines = _shelf_lines(spark, d)
    return explore.p4_low_rotation(lines, factor=0.9)


@query
def p4_low_rotation_by_store(spark, d):
    return explore.p4_low_rotation(_shelf_lines(spark, d), factor=0.9, baseline="store_category")


def _shelf_lines(spark, d):
    """Supplier and brand sales with the brand's category: dense enough for sale days to vary."""
    t = adapter.shelf(spark, d)
    return (
        business.lines_with_headers(t["transaction_items"], t["transactions"])
        .join(t["products"].select("item_id", "category"), "item_id").withColumn("revenue", line_revenue()))


@query
def p5_payment_mix(spark, d):
    return explore.p5_payment_mix(_clean(spark, d), adapter.stores(spark, d), PAYMENTS)


# --- A/B test --------------------------------------------------------------------------------------------


@query
def ab_assign(spark, d):
    return _assign(spark, d)


@query
def ab_weekly(spark, d):
    return abtest.ab_weekly(_clean(spark, d, *TEST), _assign(spark, d), *TEST)


@query
def ab_weekly_full_weeks(spark, d):
    return abtest.ab_weekly(_clean(spark, d, *TEST), _assign(spark, d), "1999-03-02", "1999-08-27", full_weeks_only=True)


@query
def ab_store_avg(spark, d):
    return _store_avg(spark, d)


_WELCH_DIGITS = dict(mean_control=4, mean_treatment=4, diff_abs=4, lift_pct=4, se=4, t_stat=6, df=4, p_value=6)


@query
def ab_welch(spark, d):
    return rel.rounded(abtest.ab_welch(_store_avg(spark, d)), **_WELCH_DIGITS)


@query
def ab_ci(spark, d):
    both = abtest.ab_ci(abtest.ab_welch(_store_avg(spark, d)))
    return rel.rounded(both.select("n_control", "n_treatment", "mean_control", "mean_treatment", "diff_abs",
                                   "lift_pct", "p_value", "ci_low", "ci_high", "significativo"),
                       mean_control=4, mean_treatment=4, diff_abs=4, lift_pct=4, p_value=6, ci_low=4, ci_high=4)


@query
def ab_ci_t(spark, d):
    both = abtest.ab_ci(abtest.ab_welch(_store_avg(spark, d)), ci="t")
    return rel.rounded(both.select("n_control", "n_treatment", "ci_low", "ci_high"), ci_low=2, ci_high=2)


@query
def ab_box_stats(spark, d):
    return rel.rounded(abtest.ab_box_stats(_store_avg(spark, d)), minimo=4, q1=4, mediana=4, q3=4, maximo=4)


@query
def ab_ticket_frequency(spark, d):
    return rel.rounded(abtest.ab_ticket_frequency(_clean(spark, d, *TEST), _assign(spark, d), *TEST),
                       ticket=4, frecuencia=6)


@query
def ab_pre_period_check(spark, d):
    return rel.rounded(
        abtest.ab_pre_period_check(_clean(spark, d, *BEFORE_TEST), _assign(spark, d), *BEFORE_TEST), **_WELCH_DIGITS)


@query
def ab_by_format(spark, d):
    return rel.rounded(abtest.ab_by_format(_store_avg(spark, d), adapter.stores(spark, d)), **_WELCH_DIGITS)


@query
def ab_rank_balance(spark, d):
    return rel.rounded(abtest.ab_rank_balance(_store_avg(spark, d)), z=6, p_value=6)


@query
def ab_mde(spark, d):
    return rel.rounded(abtest.ab_mde(abtest.ab_welch(_store_avg(spark, d))).select("mde_abs", "mde_pct"),
                       mde_abs=4, mde_pct=4)


# --- star schema -----------------------------------------------------------------------------------------


@query
def fact_sales(spark, d):
    return _facts(spark, d).drop("_loaded_at")


@query
def fact_ab_test_weekly(spark, d):
    return star.fact_ab_test_weekly(_clean(spark, d, *TEST), adapter.store_promotions(spark, d), *TEST)


@query
def dim_date(spark, d):
    return star.dim_date(adapter.headers(spark, d))


@query
def dim_store(spark, d):
    return _dim_store(spark, d)


@query
def dim_product(spark, d):
    return star.dim_product(adapter.products(spark, d), adapter.vendors(spark, d))


@query
def dim_vendor(spark, d):
    return star.dim_vendor(adapter.vendors(spark, d))


@query
def dim_customer(spark, d):
    return star.dim_customer(adapter.headers(spark, d))


@query
def dim_promotion(spark, d):
    return star.dim_promotion(adapter.store_promotions(spark, d))


@query
def scd2_dim_store(spark, d):
    """Stores outside AFRICA known since opening; the new snapshot converts ASIA and closes EUROPE."""
    stores = adapter.stores(spark, d).select("store_id", "country", "format", "size_sqm", "opening_date")
    history = stores.filter(F.col("country") != "AFRICA").withColumn("valid_from", F.col("opening_date")).withColumn(
        "valid_to", F.lit(None).cast("date"))
    snapshot = stores.filter(F.col("country") != "EUROPE").withColumn(
        "format", F.when(F.col("country") == "ASIA", F.lit("EXPRESS")).otherwise(F.col("format")))
    return star.scd2_dim_store(history, snapshot, CUR[0])


@query
def fact_sales_asof(spark, d):
    """All lines with the store's version of ``scd2_dim_store`` on their day."""
    history = _stored(spark, scd2_dim_store(spark, d))
    return temporal.fact_sales_asof(
        _facts(spark, d).select("fact_sale_id", "date_id", "store_id", "gross_revenue"), history,
        span=adapter.headers(spark, d).select(F.col("transaction_date").alias("date_id")))


@query
def fact_promo_impact(spark, d):
    return star.fact_promo_impact(_facts(spark, d), adapter.transaction_items(spark, d))


@query
def v_daily_gmv(spark, d):
    return star.v_daily_gmv(_facts(spark, d))


# --- incremental loads and streams -----------------------------------------------------------------------

EVENTS = adapter.RAW["events"]


def _sales_stream(spark, d):
    """Purchase events as the live feed of sales."""
    raw = feed.stream_ingest(spark, d, EVENTS, glob="events.parquet").filter(F.col("event_type") == "purchase")
    return feed.event_time(raw, "ts").select(
        F.col("event_id").alias("transaction_item_id"), F.col("user_id").alias("store_id"),
        F.col("ts").alias("event_time"), F.col("value").alias("amount"))


def _drain(spark, stream, name):
    root = scratch_path(spark, name)
    feed.write_stream(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query
def stream_ingest(spark, d):
    raw = _drain(spark, feed.stream_ingest(spark, d, EVENTS, glob="events.parquet"), "ingest")
    return raw.drop("_ingested_at")


@query
def stream_dedupe(spark, d):
    """Every sale sent twice."""
    stream = _sales_stream(spark, d)
    return _drain(spark, feed.stream_dedupe(stream.unionByName(_sales_stream(spark, d))), "dedupe").select(
        "transaction_item_id", "store_id", "amount")


@query
def stream_weekly_gmv(spark, d):
    return _drain(spark, feed.stream_weekly_gmv(_sales_stream(spark, d)), "weekly")


@query
def stream_weekly_corrected(spark, d):
    """The feed of ``_late_feed`` in two runs: rows of weeks already summed arrive after a restart."""
    root = scratch_path(spark, "weekly-corrected")
    files = "transaction_item_id long, store_id long, event_time timestamp, amount double, _ingested_at timestamp"
    sales = adapter.raw(spark, d, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("transaction_item_id"), F.col("user_id").alias("store_id"),
        F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("amount"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 6).cast("int")).cast("timestamp")
        .alias("_ingested_at"))
    for part in ("transaction_item_id % 6 < 2", "transaction_item_id % 6 >= 2"):
        sales.filter(part).write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(files).parquet(f"{root}/feed")
        feed.weekly_partials(stream, f"{root}/sums", f"{root}/late", f"{root}/checkpoint").awaitTermination()
    return feed.weekly_totals(spark.read.schema("store_id long, week date, gmv decimal(38,4), n_txn long")
                              .parquet(f"{root}/sums"))


@query
def stream_rescue(spark, d):
    """Events sent as CSV, every 50th without a number for its value and every 70th cut off; both sinks together."""
    root = scratch_path(spark, "rescue")
    key = F.col("event_id")
    value = F.when(key % 50 == 0, "n/a").otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    line = F.concat_ws(",", key.cast("string"), F.col("event_type"), value)
    adapter.raw(spark, d, "events").select(F.when(key % 70 == 0, F.concat(key.cast("string"), F.lit(",cut")))
                                           .otherwise(line)).write.text(f"{root}/feed")
    schema = T.StructType.fromDDL("event_id long, event_type string, value decimal(18,4)")
    feed.rescue_stream(spark, f"{root}/feed", schema, f"{root}/good", f"{root}/bad", f"{root}/checkpoint",
                       header=False).awaitTermination()
    good = spark.read.schema(schema).parquet(f"{root}/good").select(
        "event_id", "event_type", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("raw"))
    bad = spark.read.schema("_raw string").parquet(f"{root}/bad").select(
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("double").alias("value"), F.col("_raw").alias("raw"))
    return good.unionByName(bad)


def _late_feed(spark, d):
    """Purchases arriving zero to five days after the sale."""
    events = adapter.raw(spark, d, "events").filter(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").alias("transaction_item_id"), F.col("user_id").alias("store_id"),
        F.col("ts").cast("date").alias("transaction_date"), F.col("value").alias("amount"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 6).cast("int")).alias("_ingested_at"))


@query
def route_late(spark, d):
    return incremental.route_late(_late_feed(spark, d))


@query
def load_stream(spark, d):
    """The feed with both sinks: what came in time is in the facts, what came too late in quarantine."""
    root = scratch_path(spark, "load-stream")
    raw = feed.stream_ingest(spark, d, EVENTS, glob="events.parquet").filter(F.col("event_type") == "purchase")
    day = F.col("ts").cast("date")
    stream = raw.select(
        F.col("event_id").alias("transaction_item_id"), F.col("user_id").alias("store_id"),
        day.alias("transaction_date"), F.col("value").alias("amount"),
        F.trunc(day, "month").cast("string").alias("month_id"),
        F.date_add(day, (F.col("event_id") % 6).cast("int")).cast("timestamp").alias("_ingested_at"))
    feed.load_stream(stream, f"{root}/facts", f"{root}/late", f"{root}/checkpoint", by="month_id").awaitTermination()
    kept = [spark.read.schema(stream.schema).parquet(f"{root}/{name}").select(
        "transaction_item_id", "store_id", "transaction_date", "amount", F.lit(name).alias("destino"))
        for name in ("facts", "late")]
    return kept[0].unionByName(kept[1])


def _order_rows(spark, d):
    orders = adapter.raw(spark, d, "orders")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("sale_day"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"))


@query
def upsert_facts(spark, d):
    """Orders O and P are loaded; then F arrives new and P again, dearer and 35 days later, twice over."""
    def staged(df, batch):
        return df.withColumn("month_id", F.trunc("sale_day", "month").cast("string")).withColumn(
            "_ingested_at", F.lit(batch).cast("timestamp"))

    path = scratch_path(spark, "upsert-target")
    rows = _order_rows(spark, d)
    first = staged(rows.filter(F.col("status") != "F"), "2001-09-01")
    moved = F.when(F.col("status") == "P", F.date_add("sale_day", 35)).otherwise(F.col("sale_day"))
    dearer = F.when(F.col("status") == "P", F.col("amount") + 1).otherwise(F.col("amount"))
    second = staged(rows.filter(F.col("status") != "O").withColumns({"sale_day": moved, "amount": dearer}), "2001-09-02")
    for batch in (first, second, second):
        incremental.upsert_facts(spark, path, batch, "transaction_id", "month_id")
    return spark.read.schema(second.schema).parquet(path).drop("_ingested_at")


def _corrections(spark, d):
    """The batches of ``upsert_facts``: a first load, then new and corrected orders, some on another day."""
    rows = _order_rows(spark, d)
    moved = F.when(F.col("status") == "P", F.date_add("sale_day", 35)).otherwise(F.col("sale_day"))
    dearer = F.when(F.col("status") == "P", F.col("amount") + 1).otherwise(F.col("amount"))
    second = rows.filter(F.col("status") != "O").withColumns({"sale_day": moved, "amount": dearer})
    return [df.withColumn("month_id", F.trunc("sale_day", "month").cast("string"))
            .withColumn("_ingested_at", F.lit(at).cast("timestamp"))
            for df, at in ((rows.filter(F.col("status") != "F"), "2001-09-01"), (second, "2001-09-02"))]


@query
def upsert_facts_indexed(spark, d):
    """The batches of ``upsert_facts`` with the old dates of corrected orders found in a bucketed key index."""
    path, index = scratch_path(spark, "indexed-target"), f"keys_{uuid.uuid4().hex}"
    try:
        first, second = _corrections(spark, d)
        for batch in (first, second, second):
            incremental.upsert_facts(spark, path, batch, "transaction_id", "month_id", index=index)
        return spark.read.schema(second.schema).parquet(path).drop("_ingested_at")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index}")


@query
def daily_aggregates_delta(spark, d):
    """Stored daily sums after a load, its corrections and a repeat of these, by deltas alone."""
    root = scratch_path(spark, "delta")
    group, (first, second) = ("sale_day", "status"), _corrections(spark, d)
    for run, batch in (("load", first), ("correct", second), ("correct", second), ("again", second)):
        aggregates.upsert_with_aggregates(
            spark, f"{root}/facts", f"{root}/sums", batch, "transaction_id", "month_id", group, ("amount",), run)
    return spark.read.schema("month_id string, sale_day date, status string, amount decimal(38,4), lines long") \
        .parquet(f"{root}/sums").withColumn("amount", F.col("amount").cast("double"))


@query
def freshness_alerts(spark, d):
    facts = incremental.complete_days(adapter.transactions(spark, d), AS_OF)
    return incremental.freshness_alerts(facts, adapter.stores(spark, d), AS_OF, "transaction_date")


@query
def freshness_status(spark, d):
    facts = incremental.complete_days(adapter.transactions(spark, d), AS_OF)
    return incremental.freshness_status(facts, adapter.stores(spark, d), AS_OF, "transaction_date")


@query
def daily_aggregates(spark, d):
    return incremental.daily_aggregates(_facts(spark, d))


@query
def complete_days(spark, d):
    return incremental.complete_days(adapter.transactions(spark, d, end=AS_OF), AS_OF).withColumn(
        "total_amount", F.col("total_amount").cast("double"))


@query
def pseudonymize(spark, d):
    txn = adapter.headers(spark, d).select("transaction_id", "customer_id", "transaction_date")
    months = txn.select(F.trunc("transaction_date", "month").alias("month")).distinct()
    # A stored table has a known size: Spark sends it to the headers instead of shuffling them by month.
    salts = months.withColumn("salt", F.concat(F.lit("sal-"), F.col("month")))
    return incremental.pseudonymize(txn, _stored(spark, salts))


@query
def anonymize_expired(spark, d):
    txn = adapter.headers(spark, d).select("transaction_id", "customer_id", "transaction_date")
    return incremental.anonymize_expired(txn, AS_OF)


@query
def anonymize_stored(spark, d):
    """The stored months of all headers after two runs."""
    path = scratch_path(spark, "anonymized")
    txn = adapter.headers(spark, d).select("transaction_id", "customer_id", "transaction_date").withColumn(
        "month_id", F.trunc("transaction_date", "month").cast("string"))
    writers.write_partitioned(txn, path, "month_id")
    for _ in range(2):
        incremental.anonymize_stored(spark, path, txn.schema, AS_OF)
    return spark.read.schema(txn.schema).parquet(path).drop("month_id")


@query
def gmv_reconciliation(spark, d):
    return incremental.gmv_reconciliation(adapter.transactions(spark, d), adapter.transaction_items(spark, d))


# --- KPIs ------------------------------------------------------------------------------------------------


@query
def kpi_north_star(spark, d):
    return kpi.kpi_north_star(_facts(spark, d), _dim_store(spark, d))


@query
def kpi1_comp_growth(spark, d):
    return kpi.kpi1_comp_growth(_facts(spark, d), _dim_store(spark, d))


@query
def kpi2_gmv_sqm(spark, d):
    return kpi.kpi2_gmv_sqm(_facts(spark, d), _dim_store(spark, d))


@query
def kpi3_ticket(spark, d):
    return kpi.kpi3_ticket(adapter.transactions(spark, d), adapter.stores(spark, d))


@query
def kpi4_retention_m1(spark, d):
    return kpi.kpi4_retention_m1(adapter.headers(spark, d))


@query
def kpi4_retention_m1_by_store(spark, d):
    return kpi.kpi4_retention_m1(adapter.transactions(spark, d), ["store_id"])


@query
def kpi5_return_rate(spark, d):
    return kpi.kpi5_return_rate(adapter.transactions(spark, d))


@query
def kpi6_loyalty_rate(spark, d):
    return kpi.kpi6_loyalty_rate(adapter.transactions(spark, d))


@query
def kpi7_gmroi_vendor(spark, d):
    return kpi.kpi7_gmroi_vendor(_facts(spark, d), adapter.products(spark, d), adapter.vendors(spark, d))


@query
def kpi8_oos_rate(spark, d):
    return kpi.kpi8_oos_rate(_shelf_daily(spark, d))


@query
def kpi8_oos_rate_by_store(spark, d):
    return kpi.kpi8_oos_rate(_shelf_daily(spark, d), ["store_id"])


def _stored(spark, df):
    """The frame written to the shared scratch folder and read back."""
    path = scratch_path(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _score(spark, facts, stores, txn):
    monthly = _stored(spark, kpi.store_periods(facts, "month"))
    return kpi.kpi9_store_score(
        kpi.kpi1_comp_growth(facts, stores, monthly=monthly), kpi.kpi2_gmv_sqm(facts, stores, "month", monthly),
        kpi.kpi4_retention_m1(txn, ["store_id"]))


@query
def kpi9_store_score(spark, d):
    score = _score(spark, _facts(spark, d), _dim_store(spark, d), adapter.transactions(spark, d))
    return rel.rounded(score, z_gmv_m2=6, z_retencion=6, z_crecimiento=6, score=6)


@query
def kpi_checks(spark, d):
    """Facts, headers and stock-out counts are read many times, so they are written once first, as in a daily load."""
    facts, txn = _stored(spark, _facts(spark, d)), _stored(spark, adapter.transactions(spark, d))
    daily = _shelf_daily(spark, d)
    oos = _stored(spark, kpi.oos_counts(daily, ["store_id"]))
    stores = _dim_store(spark, d)
    return kpi.kpi_checks({
        "kpi1": kpi.kpi1_comp_growth(facts, stores),
        "kpi2": kpi.kpi2_gmv_sqm(facts, stores),
        "kpi3": kpi.kpi3_ticket(txn, stores),
        "kpi4": kpi.kpi4_retention_m1(txn),
        "kpi5": kpi.kpi5_return_rate(txn),
        "kpi6": kpi.kpi6_loyalty_rate(txn),
        "kpi6_day": kpi.kpi6_loyalty_rate(txn, period="day"),
        "kpi7": kpi.kpi7_gmroi_vendor(facts, adapter.products(spark, d), adapter.vendors(spark, d)),
        "kpi8": kpi.kpi8_oos_rate(daily, counts=oos),
        "kpi8_store": kpi.kpi8_oos_rate(daily, ["store_id"], counts=oos),
        "kpi9": _score(spark, facts, stores, txn),
    })
