import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfline.operators import business, kpi, star


def _items(make, *lines):
    names = ("transaction_item_id", "transaction_id", "item_id", "quantity", "unit_price", "was_on_promo")
    return make("transaction_items", *[dict(zip(names, x)) for x in lines])


def test_promotions_never_multiply_facts(make, sales):
    promos = make("store_promotions", *[
        dict(store_id="S", promo_name=n, variant=v, promo_type="E", start_date=a, end_date=b) for n, v, a, b in (
            ("P", "CONTROL", "2024-01-01", "2024-01-31"), ("Q", "TREATMENT", "2024-01-10", "2024-02-10"))])
    txn = sales(("1", "S", "2024-01-15", 1), ("2", "S", "2024-02-05", 1, {"status": "RETURNED"}), ("3", "S", "2024-03-01", 1))
    products = make("products", dict(item_id="I", cost=3))
    items = _items(make, ("a", "1", "I", 2, 5, False), ("b", "2", "I", 1, 5, True), ("c", "3", "J", 1, 5, False),
                   ("d", "none", "I", 1, 5, False))
    facts = star.fact_sales(items, txn, products, promos)
    assert facts.count() == 4
    ids = {(r.promo_name): r.promo_id for r in star.dim_promotion(promos).collect()}
    by = {r.fact_sale_id: r for r in facts.collect()}
    assert by["a"].promo_id == ids["P"] and by["b"].promo_id == ids["Q"] and by["c"].promo_id is None
    assert (by["a"].gross_revenue, by["a"].gross_margin, by["b"].is_returned) == (10.0, 4.0, True)
    assert by["c"].unit_cost is None and by["d"].date_id is None and by["a"]._loaded_at is not None
    assert rows(star.v_daily_gmv(facts)) == [("S", day("2024-01-15"), 10.0, 2.0), ("S", day("2024-03-01"), 5.0, 1.0)]
    impact = star.fact_promo_impact(facts).first()
    assert (impact.list_price, impact.discount_value) == (5.0, 0.0)


def test_dimensions(make, sales, spark):
    stores = make("stores", dict(store_id="old", opening_date="2023-05-31"), dict(store_id="new", opening_date="2023-06-01"))
    assert rows(star.dim_store(stores, "2024-06-30"), "store_id", "is_comparable") == [("new", False), ("old", True)]
    products = make("products", dict(item_id="I", vendor_id="V"), dict(item_id="J", vendor_id="gone"))
    vendors = make("vendors", dict(vendor_id="V", vendor_name="v"))
    assert rows(star.dim_product(products, vendors), "product_id", "vendor_name") == [("I", "v"), ("J", "PROVEEDOR_DESCONOCIDO")]
    txn = sales(("1", "S", "2024-01-15", 1, {"customer_id": "C"}), ("2", "S", "2024-02-15", 1, {"customer_id": "C"}),
                ("3", "S", "2024-01-01", 1))
    assert rows(star.dim_customer(txn)) == [
        ("ANON", day("2024-01-01"), day("2024-01-01"), 1, False), ("C", day("2024-01-15"), day("2024-01-01"), 2, True)]
    dates = star.dim_date(txn)
    assert dates.count() == 46 and dates.filter("is_weekend").count() == 12
    holidays = spark.createDataFrame([(day("2024-01-01"), True, "P01")], "date_id date, is_holiday_cr boolean, fiscal_period string")
    assert star.dim_date(txn, holidays=holidays).filter("is_holiday_cr").count() == 1


def test_scd2_closes_opens_and_is_idempotent(make):
    cols = ["store_id", "country", "format", "size_sqm"]
    v1 = make("stores", dict(store_id="same", format="A", country="CR"), dict(store_id="moved", format="A", country="CR"),
              dict(store_id="closed", format="A", country="CR")).select(*cols)
    history = v1.withColumn("valid_from", F.lit("2024-01-01").cast("date")).withColumn("valid_to", F.lit(None).cast("date"))
    snap = make("stores", dict(store_id="same", format="A", country="CR"), dict(store_id="moved", format="B", country="CR"),
                dict(store_id="opened", format="A", country="GT")).select(*cols)
    once = star.scd2_dim_store(history, snap, "2024-06-01")
    june = day("2024-06-01")
    assert rows(once, "store_id", "format", "valid_from", "valid_to") == [
        ("closed", "A", day("2024-01-01"), june), ("moved", "A", day("2024-01-01"), june), ("moved", "B", june, None),
        ("opened", "A", june, None), ("same", "A", day("2024-01-01"), None)]
    assert rows(star.scd2_dim_store(once, snap, "2024-07-01")) == rows(once)


@pytest.fixture(scope="module")
def facts(spark):
    def build(*lines):
        return spark.createDataFrame(
            [(s, day(d), float(r), False) for s, d, r in lines],
            "store_id string, date_id date, gross_revenue double, is_returned boolean")
    return build


def test_north_star_counts_space_once(make, facts):
    stores = make("stores", dict(store_id="A", size_sqm=10), dict(store_id="B", size_sqm=30), dict(store_id="N", size_sqm=99))
    stores = stores.withColumn("is_comparable", F.col("store_id") != "N")
    f = facts(("A", "2024-01-01", 100), ("A", "2024-01-02", 100), ("B", "2024-01-03", 200), ("N", "2024-01-03", 999))
    assert rows(kpi.kpi_north_star(f, stores), "gmv", "comp_gmv_m2") == [(400.0, 10.0)]


def test_comp_growth_by_month_and_ytd(make, facts):
    stores = make("stores", dict(store_id="A")).withColumn("is_comparable", F.lit(True))
    f = facts(("A", "2023-01-05", 100), ("A", "2023-03-05", 50), ("A", "2024-01-05", 150), ("A", "2024-03-05", 50))
    got = {r.month: r for r in kpi.kpi1_comp_growth(f, stores).collect()}
    assert got[day("2024-01-01")].growth_pct == 50.0 and got[day("2024-02-01")].growth_pct is None
    assert got[day("2024-03-01")].growth_pct == 0.0 and got[day("2024-03-01")].ytd_growth_pct == pytest.approx(100 / 3)
    assert got[day("2023-01-01")].gmv_prior is None


def test_ticket_change_needs_the_week_before(make, sales):
    stores = make("stores", dict(store_id="A", format="EXPRESS"))
    txn = sales(("1", "A", "2024-01-01", 100), ("2", "A", "2024-01-08", 50), ("3", "A", "2024-01-22", 90))
    got = rows(kpi.kpi3_ticket(txn, stores), "week", "ticket_previo", "variacion_pct", "cumple")
    assert got == [(day("2024-01-01"), None, None, True), (day("2024-01-08"), 100.0, -50.0, False),
                   (day("2024-01-22"), None, None, True)]


def test_retention_belongs_to_the_first_store(sales):
    loyal = dict(loyalty_card=True, customer_id="c")
    txn = sales(("1", "A", "2024-01-20", 1, loyal), ("2", "B", "2024-02-20", 1, loyal), ("3", "B", "2024-01-21", 1, loyal))
    assert rows(kpi.kpi4_retention_m1(txn, ["store_id"], as_of="2024-02-29")) == [
        ("A", day("2024-01-01"), 1, 1, 100.0, 35.0, True)]


def test_retention_waits_for_the_end_of_the_next_month(sales):
    loyal = dict(loyalty_card=True)
    txn = sales(("1", "A", "2024-04-03", 1, loyal | {"customer_id": "a"}), ("2", "A", "2024-05-20", 1, loyal | {"customer_id": "b"}),
                ("3", "A", "2024-06-20", 1, loyal | {"customer_id": "c"}))
    got = rows(kpi.kpi4_retention_m1(txn), "cohort", "active_m1", "retencion_m1_pct", "cumple")
    assert got == [(day("2024-04-01"), 0, 0.0, False), (day("2024-05-01"), None, None, None), (day("2024-06-01"), None, None, None)]
    got = rows(kpi.kpi4_retention_m1(txn, as_of="2024-06-30"), "cohort", "active_m1")
    assert got == [(day("2024-04-01"), 0), (day("2024-05-01"), 0), (day("2024-06-01"), None)]


def test_open_reversed_and_endless_promotions(make, sales):
    promos = make("store_promotions", *[
        dict(store_id=s, promo_name="P", variant="CONTROL", promo_type="E", start_date=a, end_date=b) for s, a, b in (
            ("open", "2024-01-05", None), ("reversed", "2024-01-05", "2024-01-01"), ("endless", "1900-01-01", "9999-12-31"),
            ("later", "2024-02-01", None), ("unknown", None, "2024-01-03"))])
    txn = sales(("1", "open", "2024-01-04", 1), ("2", "open", "2024-01-06", 1))
    days = rows(star.promotion_days(promos, txn), "store_id", "date_id")
    assert days == [("endless", day(f"2024-01-0{d}")) for d in (4, 5, 6)] + [("open", day("2024-01-05")), ("open", day("2024-01-06"))]
    assert rows(star.reversed_promotions(promos), "store_id") == [("reversed",), ("unknown",)]


def test_oos_rate_by_month(spark):
    days = ["2024-01-%02d" % d for d in range(1, 8)] + ["2024-02-10", "2024-03-01", "2024-03-02"]
    data = [("S", "gap", day(d), 1.0, 1.0) for d in days]
    data += [("S", "ok", day("2024-01-%02d" % d), 1.0, 1.0) for d in range(1, 9)] + [("S", "rare", day("2024-01-01"), 1.0, 1.0)]
    daily = spark.createDataFrame(data, "store_id string, item_id string, fecha_venta date, unidades double, gmv_dia double")
    assert rows(kpi.kpi8_oos_rate(daily), "month", "activos", "con_quiebre", "oos_pct") == [
        (day("2024-01-01"), 2, 1, 50.0), (day("2024-02-01"), 1, 1, 100.0), (day("2024-03-01"), 1, 0, 0.0)]


def test_score_of_a_single_store_format_is_null(spark):
    month = day("2024-01-01")
    k2 = spark.createDataFrame([("A", "X", month, 1.0), ("B", "X", month, 3.0), ("C", "Y", month, 2.0)],
                               "store_id string, format string, month date, gmv_m2 double")
    k4 = spark.createDataFrame([("A", month, 50.0), ("B", month, 70.0), ("C", month, 60.0)],
                               "store_id string, cohort date, retencion_m1_pct double")
    k1 = spark.createDataFrame([("A", month, 1.0), ("B", month, 2.0), ("C", month, 3.0)],
                               "store_id string, month date, growth_pct double")
    score = kpi.kpi9_store_score(k1, k2, k4)
    got = {r.store_id: r.score for r in score.collect()}
    assert got["C"] is None
    half = 1 / 2 ** 0.5
    assert got["A"] == pytest.approx(0.5 * -half + 0.3 * -1 + 0.2 * -1)
    assert got["B"] == pytest.approx(0.5 * half + 0.3 * 1 + 0.2 * 0)
    flags = kpi.kpi_checks({"kpi9": score})
    assert rows(flags, "unidad", "regla") == [("C", "componente_nulo")]


def test_checks_find_planted_faults(spark):
    w = [day(f"2024-01-{d:02d}") for d in (1, 8, 15, 22)]
    k5 = spark.createDataFrame([("A", x, 20, 1, 5.0) for x in w] + [("B", w[0], 10, 5, 50.0), ("B", w[1], 10, 1, 5.0)],
                               "store_id string, week date, n long, devueltas long, tasa_devolucion_pct double")
    assert rows(kpi.kpi_checks({"kpi5": k5}), "unidad", "periodo", "regla") == [
        ("A", w[3], "igual_4_semanas"), ("B", w[0], "devolucion_mayor_10")]
    k6 = spark.createDataFrame([("A", w[0], 0.0), ("A", w[1], 100.0), ("A", w[2], 100.0)],
                               "store_id string, day date, penetracion_pct double")
    assert rows(kpi.kpi_checks({"kpi6_day": k6}), "periodo", "regla") == [
        (w[0], "cero_en_un_dia"), (w[1], "salto_a_100")]
    months = [day("2024-01-01"), day("2024-02-01"), day("2024-04-01")]
    k8 = spark.createDataFrame([(m, 0.0) for m in months], "month date, oos_pct double")
    assert rows(kpi.kpi_checks({"kpi8": k8}), "periodo") == [(months[1],)]
    k1 = spark.createDataFrame([(s, m, 10.0 if s == "A" else 30.0 * i + 10, 10.0, 0.0 if s == "A" else 1.0)
                                for s in "AB" for i, m in enumerate(months[:2])],
                               "store_id string, month date, gmv double, gmv_prior double, growth_pct double")
    assert rows(kpi.kpi_checks({"kpi1": k1}), "periodo", "regla") == [
        (months[0], "mas_20pct_tiendas_en_cero"), (months[1], "mas_20pct_tiendas_en_cero"), (months[1], "sube_mas_30_en_un_mes")]


def test_vendor_targets_follow_the_tier(make, spark):
    facts = spark.createDataFrame([("I", day("2024-02-01"), 20.0, 10.0, 1.0, False)],
                                  "product_id string, date_id date, gross_revenue double, unit_cost double, quantity double, is_returned boolean")
    products = make("products", dict(item_id="I", vendor_id="V"))
    for tier, ok in (("A", False), ("C", True)):
        vendors = make("vendors", dict(vendor_id="V", tier=tier))
        row = kpi.kpi7_gmroi_vendor(facts, products, vendors).first()
        assert (row.gmroi, row.cumple, row.quarter) == (1.0, ok, day("2024-01-01"))
