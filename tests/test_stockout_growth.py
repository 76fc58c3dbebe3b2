"""Stock-out gaps and rates against brute force, without a row per idle day or per month of a pair."""

import datetime as dt
import random

import pytest

from shelfline.operators import business, kpi

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def sales():
    rng = random.Random(7)
    rows = [(f"s{p % 4}", f"i{p}", START + dt.timedelta(days=d))
            for p in range(40) for d in sorted(rng.sample(range(400), rng.choice([1, 6, 7, 20, 60])))]
    return rows + [(None, "i0", START + dt.timedelta(days=9 * k)) for k in range(8)] + [("s1", "i1", None)]


@pytest.fixture(scope="module")
def daily(spark, sales):
    return spark.createDataFrame([(*r, 1.0, 2.0) for r in sales], "store_id string, item_id string, fecha_venta date, "
                                 "unidades double, gmv_dia double")


def pairs(sales):
    out = {}
    for s, i, d in sales:
        if d:
            out.setdefault((s, i), []).append(d)
    return {k: sorted(v) for k, v in out.items()}


def months(lo, hi):
    return {dt.date(n // 12, n % 12 + 1, 1) for n in range(lo.year * 12 + lo.month - 1, hi.year * 12 + hi.month)}


def gaps(days, least):
    one = dt.timedelta(days=1)
    return [(a + one, b - one) for a, b in zip(days, days[1:]) if (b - a).days - 1 >= least]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("by", [[], ["store_id"]])
@pytest.mark.parametrize("least", [3, 20])
def test_monthly_counts(daily, sales, by, least):
    want = {}
    for (store, _), days in pairs(sales).items():
        if len(days) < 7:
            continue
        broken = set().union(*[months(*g) for g in gaps(days, least)])
        for m in months(days[0], days[-1]):
            cell = want.setdefault((*([store] if by else []), m), [0, 0])
            cell[0] += 1
            cell[1] += m in broken
    counts = kpi.oos_counts(daily, by, least)
    got = {(*[r[c] for c in by], r["month"]): [r["activos"], r["con_quiebre"]] for r in counts.collect()}
    assert got == want
    assert "collect_list" not in plan(counts)  # pairs were laid out over their months with all their gaps
    finer = kpi.oos_counts(daily, ["store_id"], least)
    assert sorted(map(str, kpi.kpi8_oos_rate(daily, by, least, counts=finer).collect())) == sorted(
        map(str, kpi.kpi8_oos_rate(daily, by, least).collect()))


@pytest.mark.parametrize("least", [0, 3, 20])
def test_calendar_gaps(daily, sales, least):
    found = business.stockout_gaps_calendar(daily, least)
    got = sorted((str(r["store_id"]), r["item_id"], r["gap_inicio"], r["gap_fin"], r["duracion_dias"])
                 for r in found.collect())
    assert got == sorted((str(s), i, a, b, (b - a).days + 1) for (s, i), days in pairs(sales).items() if len(days) >= 7
                         for a, b in gaps(days, max(least, 1)))
    assert "sequence(" not in plan(found)  # every calendar day was a row


def test_lines_with_header(spark):
    lines = spark.createDataFrame(
        [(1, "s", "a", 2.0, 3.0), (1, "s", "a", 1.0, 3.0), (2, "s", "b", 1.0, 5.0), (None, "s", "a", 9.0, 9.0)],
        "transaction_id long, store_id string, item_id string, quantity double, unit_price double").selectExpr(
        "*", "date'2024-01-01' AS transaction_date", "if(transaction_id = 2, 'RETURNED', 'COMPLETED') AS status")
    got = business.daily_item_sales(lines).collect()
    headers = lines.where("transaction_id IS NOT NULL").select(
        "transaction_id", "store_id", "transaction_date", "status").distinct()
    joined = business.daily_item_sales(lines.drop("store_id", "transaction_date", "status"), headers).collect()
    assert len(got) == 1 and got == joined
