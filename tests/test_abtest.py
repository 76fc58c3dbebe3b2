import math

import pytest

from conftest import day, rows
from shelfline.operators import abtest


def _promos(make, *rows_):
    names = ("store_id", "promo_name", "variant", "start_date", "promo_type")
    return make("store_promotions", *[dict(zip(names, r), end_date="2024-12-31") for r in rows_])


def test_assignment_takes_the_earliest_and_drops_mixed_stores(make):
    promos = _promos(
        make, ("A", "Q", "CONTROL", "2024-02-01", "EXHIBICION"), ("A", "P", "CONTROL", "2024-01-01", "PRECIO"),
        ("B", "P", "CONTROL", "2024-01-01", "EXHIBICION"), ("B", "P", "TREATMENT", "2024-01-01", "EXHIBICION"),
        ("C", "P", "TREATMENT", "2024-01-01", "EXHIBICION"))
    assert rows(abtest.ab_assign(promos)) == [("A", "CONTROL", "P"), ("C", "TREATMENT", "P")]
    assert rows(abtest.ab_assign(promos, "EXHIBICION")) == [("A", "CONTROL", "Q"), ("C", "TREATMENT", "P")]


def test_weeks_of_the_test_window(spark, sales):
    days = ["2024-09-01", "2024-09-02", "2024-09-09", "2024-09-16", "2024-09-23", "2024-09-30", "2024-10-13", "2024-10-14"]
    txn = sales(*[(f"T{i}", "A", d, 10) for i, d in enumerate(days)])
    assign = spark.createDataFrame([("A", "CONTROL")], "store_id string, variant string")
    weekly = abtest.ab_weekly(txn, assign, "2024-09-01", "2024-10-13")
    assert weekly.count() == 7 and weekly.agg({"week": "min"}).first()[0] == day("2024-08-26")
    full = abtest.ab_weekly(txn, assign, "2024-09-01", "2024-10-13", full_weeks_only=True)
    assert full.count() == 6 and full.agg({"week": "min"}).first()[0] == day("2024-09-02")
    assert abtest.ab_store_avg(weekly).first().avg_gmv_week == 10.0


@pytest.fixture(scope="module")
def store_avg(spark):
    control, treatment = [10.0, 12.0, 9.0, 15.0, 11.0], [8.0, 12.0, 7.0, 10.0]
    data = [(f"c{i}", "CONTROL", v, 1.0) for i, v in enumerate(control)]
    data += [(f"t{i}", "TREATMENT", v, 1.0) for i, v in enumerate(treatment)]
    return spark.createDataFrame(data, "store_id string, variant string, avg_gmv_week double, avg_txn_week double")


def test_welch_and_interval(store_avg):
    row = abtest.ab_ci(abtest.ab_welch(store_avg)).first()
    # By hand: means 11.4 and 9.25, variances 5.3 and 59/12.
    assert row.mean_control == pytest.approx(11.4) and row.mean_treatment == pytest.approx(9.25)
    se = math.sqrt(5.3 / 5 + 59 / 12 / 4)
    assert row.se == pytest.approx(se) and row.t_stat == pytest.approx(-2.15 / se)
    df = se ** 4 / ((5.3 / 5) ** 2 / 4 + (59 / 12 / 4) ** 2 / 3)
    assert row.df == pytest.approx(df)
    assert row.lift_pct == pytest.approx(-2.15 / 11.4 * 100)
    assert row.ci_low == pytest.approx(-2.15 - 1.96 * se) and row.significativo is False
    wide = abtest.ab_ci(abtest.ab_welch(store_avg), ci="t").first()
    assert wide.ci_low < row.ci_low and wide.ci_high > row.ci_high
    mde = abtest.ab_mde(abtest.ab_welch(store_avg)).first()
    assert mde.mde_abs == pytest.approx(2.8015852 * se, rel=1e-6)


def test_rank_balance_by_brute_force(store_avg):
    data = [(r.variant, r.avg_gmv_week) for r in store_avg.collect()]
    t = [v for g, v in data if g == "TREATMENT"]
    c = [v for g, v in data if g == "CONTROL"]
    u = sum((x > y) + 0.5 * (x == y) for x in t for y in c)
    row = abtest.ab_rank_balance(store_avg).first()
    assert (row.n_control, row.n_treatment, row.u) == (5, 4, u)
    n = len(data)
    tied = sum(k ** 3 - k for k in [[v for _, v in data].count(x) for x in {v for _, v in data}])
    assert row.z == pytest.approx((u - 10) / math.sqrt(20 / 12 * (n + 1 - tied / (n * (n - 1)))))


def test_box_format_and_frequency(make, spark, sales, store_avg):
    box = {r.variant: r for r in abtest.ab_box_stats(store_avg).collect()}
    assert (box["CONTROL"].minimo, box["CONTROL"].mediana, box["CONTROL"].maximo) == (9.0, 11.0, 15.0)
    stores = make("stores", *[dict(store_id=s, format="X" if s in ("c0", "c1", "t0", "t1") else "Y") for s in
                              [r.store_id for r in store_avg.collect()]], dict(store_id="c9", format="Z"))
    by = {r.format: r for r in abtest.ab_by_format(store_avg, stores).collect()}
    assert (by["X"].n_control, by["X"].n_treatment) == (2, 2) and by["X"].p_value is not None
    txn = sales(("1", "c0", "2024-09-02", 10), ("2", "c0", "2024-09-02", 30), ("3", "c1", "2024-09-03", 40))
    assign = store_avg.select("store_id", "variant")
    got = abtest.ab_ticket_frequency(txn, assign, "2024-09-01", "2024-09-30").first()
    assert (got.ticket, got.frecuencia) == (30.0, 1.5)
    pre = abtest.ab_pre_period_check(txn, assign, "2024-09-01", "2024-09-30").first()
    assert pre.comparable_pre is None and pre.n_treatment == 0
