"""A third of all rows on one key: results equal brute force in plain Python, whatever the partitioning."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfline.operators import business, quality, star

START = datetime.date(2024, 1, 1)
CATEGORY = {f"I{i}": f"c{i % 4}" for i in range(20)}


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    txn, items = [], []
    for n in range(3000):
        hot = rnd.random() < 1 / 3
        loyal = rnd.random() < 0.6
        txn.append(dict(
            transaction_id=f"T{n}", store_id="HOT" if hot else f"S{rnd.randint(1, 40)}",
            customer_id=("HOT" if hot else f"C{rnd.randint(1, 200)}") if loyal else None, loyalty_card=loyal,
            transaction_date=str(START + datetime.timedelta(days=rnd.randint(0, 400))),
            total_amount=rnd.randint(1, 99999) / 100, status="COMPLETED" if rnd.random() < 0.9 else "RETURNED"))
    for n in range(6000):
        items.append(dict(
            transaction_item_id=f"L{0 if rnd.random() < 1 / 3 else n}",
            transaction_id="T0" if rnd.random() < 1 / 3 else f"T{rnd.randint(0, 2999)}",
            item_id="I0" if rnd.random() < 1 / 3 else f"I{rnd.randint(0, 22)}", quantity=rnd.randint(1, 5),
            unit_price=rnd.randint(1, 999) / 100, was_on_promo=rnd.random() < 0.05))
    return txn, items


@pytest.fixture(scope="module", params=[1, 16])
def tables(request, data, make):
    txn, items = data
    return (make("transactions", *txn, partitions=request.param), make("transaction_items", *items, partitions=request.param),
            make("products", *[dict(item_id=i, category=c) for i, c in CATEGORY.items()]))


def _mean(xs):
    return sum(xs) / len(xs)


def test_promo_uplift(tables, data):
    txn, items = data
    done = {t["transaction_id"]: t["total_amount"] for t in txn if t["status"] == "COMPLETED"}
    flag = collections.defaultdict(bool)
    for i in items:
        flag[i["transaction_id"]] |= i["was_on_promo"]
    groups = collections.defaultdict(list)
    for i in items:
        if i["transaction_id"] in done and i["item_id"] in CATEGORY:
            groups[CATEGORY[i["item_id"]], flag[i["transaction_id"]]].append(i)
    got = {r.category: r for r in business.q6_promo_uplift(tables[1], tables[0], tables[2]).collect()}
    assert set(got) == {c for c, _ in groups}
    for (category, promo), lines in groups.items():
        name = "con_promo" if promo else "sin_promo"
        row = got[category]
        assert row[f"txn_{name}"] == len({i["transaction_id"] for i in lines})
        assert row[f"ticket_{name}"] == pytest.approx(_mean([done[i["transaction_id"]] for i in lines]))
        assert row[f"uds_por_txn_{name}"] == pytest.approx(
            sum(i["quantity"] for i in lines) / len({i["transaction_id"] for i in lines}))


def test_cohorts(tables, data):
    loyal = [t for t in data[0] if t["customer_id"]]
    first = {}
    for t in loyal:
        first[t["customer_id"]] = min(first.get(t["customer_id"], "9"), t["transaction_date"])
    size = collections.Counter(d[:7] for d in first.values())
    active = collections.defaultdict(set)
    for t in loyal:
        a, b = first[t["customer_id"]], t["transaction_date"]
        offset = (int(b[:4]) - int(a[:4])) * 12 + int(b[5:7]) - int(a[5:7])
        if t["status"] == "COMPLETED":
            active[a[:7], offset].add(t["customer_id"])
    got = business.cohort_activity(tables[0]).filter(F.col("customers") > 0).collect()
    assert {(str(r.cohort)[:7], r.month_offset): r.customers for r in got} == {k: len(v) for k, v in active.items()}
    assert {str(r.cohort)[:7]: r.cohort_size for r in got} == dict(size)


def test_audit_of_hot_ids(tables, data):
    txn, items = data
    row = quality.audit_uniqueness({"items": (tables[1], ["transaction_item_id"])}).first()
    ids = {i["transaction_item_id"] for i in items}
    assert (row.total_filas, row.duplicados) == (6000, 6000 - len(ids))
    assert quality.dedupe_keep_last(tables[1], ["transaction_item_id"], ["transaction_id"]).count() == len(ids)
    sums = collections.defaultdict(float)
    for i in items:
        sums[i["transaction_id"]] += i["quantity"] * i["unit_price"]
    diffs = sorted(round(abs(t["total_amount"] - sums[t["transaction_id"]]), 2) for t in txn if t["transaction_id"] in sums)
    off = [d for d in diffs if d > 0.02]
    row = quality.audit_header_vs_lines(tables[0], tables[1]).first()
    assert (row.transacciones_comparadas, row.con_discrepancia) == (len(diffs), len(off))
    assert row.diferencia_mediana == pytest.approx((off[(len(off) - 1) // 2] + off[len(off) // 2]) / 2)
    assert row.diferencia_promedio == pytest.approx(_mean(off))


def test_facts_keep_every_line(tables, make):
    promos = make("store_promotions", *[
        dict(store_id="HOT", promo_name=f"P{n}", variant="CONTROL", start_date="2024-01-01", end_date="2024-12-31")
        for n in range(30)])
    facts = star.fact_sales(tables[1], tables[0], tables[2], promos)
    assert facts.count() == 6000
    assert facts.filter(F.col("store_id") == "HOT").select("promo_id").distinct().count() <= 2


def test_customers(tables, data):
    counts = collections.Counter(t["customer_id"] or "ANON" for t in data[0])
    got = {r.customer_id: r.total_lifetime_transactions for r in star.dim_customer(tables[0]).collect()}
    assert got == dict(counts)
