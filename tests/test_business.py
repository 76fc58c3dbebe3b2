import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfline.operators import business, explore
from shelfline.functions.relational import rounded


def _items(make, *lines):
    names = ("transaction_item_id", "transaction_id", "item_id", "quantity", "unit_price", "was_on_promo")
    return make("transaction_items", *[dict(zip(names, x)) for x in lines])


def test_comp_sales_excludes_new_and_silent_stores(make, sales):
    stores = make("stores", *[dict(store_id=s, format="F", opening_date=o) for s, o in (
        ("A", "2023-06-01"), ("B", "2023-12-31"), ("cut", "2024-01-01"), ("silent", "2020-01-01"))])
    lines = []
    for s, prior, cur in (("A", 100, 150), ("B", 100, 110), ("cut", 100, 200), ("silent", 0, 50)):
        lines += [(f"{s}p", s, "2024-06-30", prior), (f"{s}c", s, "2025-06-30", cur)]
    lines += [("back", "A", "2025-01-01", 999, {"status": "RETURNED"}), ("outside", "A", "2025-07-01", 999)]
    got = business.q1_comp_sales(sales(*lines), stores).collect()
    assert [(r.store_id, r.comp_sales_pct, r.rank_en_formato) for r in got] == [("A", 50.0, 1), ("B", 10.0, 2)]


def test_sqm_lowest_quarter_is_strict(make, sales):
    stores = make("stores", *[dict(store_id=f"S{i}", format="F", size_sqm=10) for i in range(1, 6)])
    txn = sales(*[(f"T{i}", f"S{i}", "2025-04-01", i * 100) for i in range(1, 6)])
    got = {r.store_id: (r.estado, r.rank_en_formato) for r in business.q2_sqm_productivity(txn, stores).collect()}
    assert got["S1"] == ("BAJO_RENDIMIENTO", 5) and got["S2"] == ("OK", 4) and got["S5"] == ("OK", 1)


def test_cohorts_start_with_any_status_in_q3_but_completed_in_the_matrix(sales):
    loyal = dict(loyalty_card=True)
    txn = sales(
        ("1", "S", "2024-01-31", 10, dict(loyal, customer_id="back", status="RETURNED")),
        ("2", "S", "2024-03-01", 20, dict(loyal, customer_id="back")),
        ("3", "S", "2024-01-05", 30, dict(loyal, customer_id="keen")),
        ("4", "S", "2024-02-05", 50, dict(loyal, customer_id="keen")),
        ("5", "S", "2024-02-06", 70, dict(loyal, customer_id="keen")),
        ("6", "S", "2024-02-07", 70, dict(loyalty_card=True)), ("7", "S", "2024-02-07", 70, dict(customer_id="none")))
    got = business.q3_cohort_retention(txn).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.cohorte_mes, row.tamano_cohorte, row.ticket_m0) == (day("2024-01-01"), 2, 30.0)
    assert (row.ret_m1_pct, row.ticket_m1, row.ret_m2_pct, row.ticket_m2) == (50.0, 60.0, 50.0, 20.0)
    assert row.ret_m3_pct is None and row.ticket_m6 is None
    base = business.cohort_activity(txn).filter("month_offset = 0").first()
    assert (base.customers, base.cohort_size) == (1, 2)  # the returned first purchase is no activity
    matrix = rows(explore.p3_cohort_matrix(txn, max_month=2, drop_last=0))
    assert matrix == [(day("2024-01-01"), 100.0, 100.0, 0.0), (day("2024-03-01"), 100.0, 0.0, 0.0)]
    assert explore.p3_cohort_matrix(txn, drop_last=2).count() == 0


def test_days30_counts_a_customer_once_per_offset(sales):
    txn = sales(*[(str(i), "S", d, 10, dict(loyalty_card=True, customer_id="c")) for i, d in enumerate(
        ("2024-02-01", "2024-03-01", "2024-04-01"))])
    got = explore.p3_cohort_matrix(txn, max_month=2, drop_last=0, mode="days30").first()
    assert (got.m0, got.m1, got.m2) == (100.0, 0.0, 100.0)


def test_gmroi_null_ratio_is_ok_and_orphans_drop(make, sales):
    products = make("products", dict(item_id="free", category="c", vendor_id="V", cost=0),
                    dict(item_id="thin", category="d", vendor_id="V", cost=8),
                    dict(item_id="lost", category="c", vendor_id="gone", cost=1))
    vendors = make("vendors", dict(vendor_id="V", vendor_name="v", tier="A"))
    txn = sales(("T", "S", "2024-01-01", 1), ("R", "S", "2024-01-10", 1, {"status": "RETURNED"}))
    items = _items(make, ("1", "T", "free", 2, 5, False), ("2", "T", "thin", 1, 10, False), ("3", "T", "thin", 1, 0, False),
                   ("4", "T", "lost", 1, 10, False), ("5", "R", "thin", 9, 10, False))
    got = {r.category: r for r in business.q4_gmroi(items, txn, products, vendors).collect()}
    assert got["c"].gmroi is None and got["c"].alerta == "OK"
    assert got["d"].gmroi == pytest.approx(-6 / 16) and got["d"].alerta == "ALERTA_GMROI<1"
    assert got["d"].velocidad_venta_dia == pytest.approx(2 / 10)
    kept = {r.category: r for r in business.q4_gmroi(items, txn, products, vendors, 547.0, True).collect()}
    assert kept["d"].costo_total == 8.0 and kept["d"].velocidad_venta_dia == pytest.approx(1 / 547)


def _random_daily(spark, partitions):
    rnd = random.Random(3)
    start = datetime.date(2024, 1, 1)
    data = []
    for store in ("A", "B"):
        for item in range(6):
            for offset in sorted(rnd.sample(range(120), rnd.randint(3, 60))):
                data.append((store, str(item), start + datetime.timedelta(days=offset), float(rnd.randint(1, 9)),
                             rnd.randint(100, 9999) / 100))
    rnd.shuffle(data)
    return spark.createDataFrame(
        data, "store_id string, item_id string, fecha_venta date, unidades double, gmv_dia double").repartition(partitions)


def test_lag_gaps_equal_calendar_gaps_for_any_partitioning(spark):
    lag = rows(business.stockout_gaps(_random_daily(spark, 1)))
    assert lag and lag == rows(business.stockout_gaps(_random_daily(spark, 13)))
    assert lag == rows(business.stockout_gaps_calendar(_random_daily(spark, 5)))
    assert min(r[4] for r in lag) == 3


def test_stockouts_name_and_rank(make, sales):
    days = ["2024-01-%02d" % d for d in (1, 2, 3, 4, 5, 6, 10)]
    txn = sales(*[(f"T{i}", "S", d, 1) for i, d in enumerate(days)])
    items = _items(make, *[(f"L{i}", f"T{i}", "I", 2, 5, False) for i in range(7)])
    stores, products = make("stores", dict(store_id="S", store_name="s")), make("products", dict(item_id="I", item_name="i"))
    got = business.q5_stockouts(items, txn, stores, products).first()
    assert (got.gap_inicio, got.gap_fin, got.duracion_dias) == (day("2024-01-07"), day("2024-01-09"), 3)
    assert (got.avg_unidades_dia_previo, got.gmv_estimado_perdido) == (2.0, 30.0)
    assert business.q5_stockouts(items, txn, stores, products, min_gap=4).count() == 0
    assert business.q5_stockouts(items, txn, stores, products, min_days=8).count() == 0


def test_promo_uplift_weighs_baskets_by_lines(make, sales):
    products = make("products", dict(item_id="a", category="c"), dict(item_id="b", category="c"), dict(item_id="d", category="d"))
    txn = sales(("big", "S", "2024-01-01", 100), ("small", "S", "2024-01-01", 20), ("promo", "S", "2024-01-01", 90))
    items = _items(make, ("1", "big", "a", 1, 1, False), ("2", "big", "b", 1, 1, False), ("3", "big", "a", 1, 1, None),
                   ("4", "small", "a", 5, 1, False), ("5", "promo", "a", 2, 1, False), ("6", "promo", "unknown", 1, 1, True))
    got = business.q6_promo_uplift(items, txn, products).first()
    assert (got.txn_sin_promo, got.txn_con_promo) == (2, 1)
    assert got.ticket_sin_promo == 80.0  # (3 * 100 + 20) / 4
    assert (got.uds_por_txn_sin_promo, got.ticket_con_promo, got.ticket_uplift_abs) == (4.0, 90.0, 10.0)
    assert business.q6_promo_uplift(items, txn, products, dedupe_baskets=True).first().ticket_sin_promo == 60.0


def test_pareto_ties_and_core(spark):
    base = spark.createDataFrame([("F", "b", 40.0), ("F", "a", 40.0), ("F", "c", 20.0), ("F", None, 9.0), (None, "a", 9.0)],
                                 "format string, category string, revenue double")
    got = explore.p2_pareto(base).orderBy("cum_pct").collect()
    assert [(r.category, r.pct, r.cum_pct) for r in got] == [("a", 40.0, 40.0), ("b", 40.0, 80.0), ("c", 20.0, 100.0)]
    assert sorted(r.category for r in explore.p2_pareto_core(explore.p2_pareto(base)).collect()) == ["a", "b"]


def test_low_rotation_drops_nulls_and_takes_either_mean(spark):
    start = datetime.date(2024, 1, 1)
    data = [("S", "fast", "c", start + datetime.timedelta(days=i), 10.0) for i in range(10)]
    data += [("S", "slow", "c", start, 10.0), ("S", "slow", "c", start, 5.0), ("R", "only", "d", start, 7.0),
             ("S", None, "c", start, 1.0), ("S", "x", None, start, 1.0)]
    base = spark.createDataFrame(data, "store_id string, item_id string, category string, transaction_date date, revenue double")
    assert rows(explore.p4_low_rotation(base)) == [("c", 1, 15.0), ("d", 1, 7.0)]
    assert rows(explore.p4_low_rotation(base, baseline="store_category")) == [("c", 1, 15.0)]


def test_payment_mix_fills_zero(make, sales):
    stores = make("stores", dict(store_id="S", country="CR"), dict(store_id="R", country="GT"))
    txn = sales(("1", "S", "2024-01-01", 1), ("2", "S", "2024-01-01", 1, {"payment_method": "CARD"}),
                ("3", "R", "2024-01-01", 1), ("4", "R", "2024-01-01", 1, {"payment_method": None}))
    assert rows(explore.p5_payment_mix(txn, stores)) == [("CR", 50.0, 50.0, 0.0), ("GT", 100.0, 0.0, 0.0)]


def test_report_digits_round_the_published_columns(make, sales):
    stores = make("stores", dict(store_id="A", format="F", opening_date="2023-06-01"))
    txn = sales(("p", "A", "2024-06-30", 3), ("c", "A", "2025-06-30", 4))
    digits = business.REPORT_DIGITS["q1_comp_sales"]
    assert rounded(business.q1_comp_sales(txn, stores), **digits).first().comp_sales_pct == 33.33


def test_weekly_revenue_of_headers_without_lines_is_zero(spark):
    base = spark.createDataFrame([(day("2024-01-03"), "F", None), (day("2024-01-10"), "F", 5.0), (day("2024-01-10"), None, 5.0)],
                                 "transaction_date date, format string, revenue double")
    weekly = explore.p1_weekly_gmv(base)
    assert rows(weekly) == [(day("2024-01-01"), "F", 0.0), (day("2024-01-08"), "F", 5.0)]
    ends = explore.p1_peaks_troughs(weekly, 1)
    assert rows(ends, "tipo", "gmv") == [("CAIDA", 0.0), ("PICO", 5.0)]
    assert explore.p1_seasonality(weekly).filter(F.col("cv") > 1).count() == 1


def test_seasonal_strength_finds_a_wave_on_a_trend(spark):
    """A pure trend and wave is explained whole; a pure trend and short series have no wave."""
    first = datetime.date(2022, 1, 3)
    rows = []
    for k in range(120):
        week = first + datetime.timedelta(weeks=k)
        turn = 2 * math.pi * ((week - datetime.date(1970, 1, 1)).days / 365.25 - 100 / 365.25)
        rows += [("A", week, 1000.0 + 5 * k + 200 * math.cos(turn)), ("B", week, 50.0 + 2 * k)]
        rows += [("C", week, 1.0 * k)] * (k < 4) + [("A", week, None)]
    weekly = spark.createDataFrame(rows, "format string, week date, gmv double")
    got = {r.format: r for r in explore.p1_seasonal_strength(weekly).collect()}
    assert [round(x, 4) for x in (got["A"].tendencia, got["A"].amplitud, got["A"].dia_pico, got["A"].fuerza)] == [
        5.0, 200.0, 100.0, 1.0]
    assert got["B"].tendencia == pytest.approx(2.0) and got["B"].fuerza is None and got["B"].amplitud == pytest.approx(0, abs=1e-6)
    assert got["C"].semanas == 4 and got["C"].fuerza is None
    assert explore.p1_seasonal_strength(weekly.limit(0)).count() == 0
