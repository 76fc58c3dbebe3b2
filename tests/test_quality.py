from conftest import day, rows
from shelfline.operators import base, quality


def _items(make, *lines):
    names = ("transaction_item_id", "transaction_id", "item_id", "quantity", "unit_price", "was_on_promo")
    return make("transaction_items", *[dict(zip(names, x)) for x in lines])


def test_header_differences_are_strict_and_inner(make, sales):
    cents = ["0.005", "0.01", "0.015", "0.02", "0.03"]
    txn = sales(*[(f"T{i}", "S", "2024-01-01", "10.00") for i in range(6)])
    items = _items(make, *[(f"L{i}", f"T{i}", "I", 1, 10 + float(c), False) for i, c in enumerate(cents)])
    loose = quality.audit_header_vs_lines(txn, items, 0.02).first()
    assert (loose.transacciones_comparadas, loose.con_discrepancia) == (5, 1)
    strict = quality.audit_header_vs_lines(txn, items, 0.01).first()
    assert strict.con_discrepancia == 3 and strict.diferencia_mediana == 0.02
    assert round(strict.diferencia_promedio, 10) == round((0.015 + 0.02 + 0.03) / 3, 10)
    assert strict.diferencia_maxima == 0.03
    none = quality.audit_header_vs_lines(txn, items, 5).first()
    assert none.con_discrepancia == 0 and none.diferencia_promedio is None and none.diferencia_mediana is None
    assert [r.transaction_id for r in quality.audit_top_discrepancies(txn, items, 0.01, 2).collect()] == ["T4", "T3"]


def test_uniqueness_counts_null_keys_both_ways(sales):
    txn = sales(("A", "S", "2024-01-01", 1), ("A", "S", "2024-01-01", 1), (None, "S", "2024-01-01", 1),
                (None, "S", "2024-01-01", 1))
    row = quality.audit_uniqueness({"t": (txn, ["transaction_id"])}).first()
    assert (row.total_filas, row.ids_unicos, row.duplicados, row.duplicados_con_nulos) == (4, 1, 3, 2)
    assert rows(quality.audit_duplicate_keys(txn, ["transaction_id"])) == [("A", 2), (None, 2)]
    assert quality.dedupe_keep_last(txn, ["transaction_id"], ["transaction_date"]).count() == 2


def test_amounts(sales):
    txn = sales(("A", "S", "2024-01-01", -1), ("B", "S", "2024-01-01", 0), ("C", "S", "2024-01-01", "0.01"))
    assert tuple(quality.audit_amount_validity(txn).first()) == (2, 1, 1, -1.0, 0.01)
    assert sorted(r.transaction_id for r in quality.audit_invalid_rows(txn).collect()) == ["A", "B"]


def test_zero_price_with_unknown_promo_is_in_neither_part(make):
    items = _items(make, ("1", "T", "I", 1, 0, True), ("2", "T", "I", 1, 0, False), ("3", "T", "I", 1, 0, None),
                   ("4", "T", "I", 1, 5, False))
    assert tuple(quality.audit_zero_price(items).first()) == (3, 1, 1, 75.0)


def test_completeness_and_scorecard(sales):
    txn = sales(("A", "S", "2024-01-01", 1, {"customer_id": "C", "loyalty_card": True}),
                ("B", "S", "2024-01-02", 1), ("C", "R", "2024-01-03", 0, {"status": "RETURNED", "loyalty_card": None}))
    row = quality.audit_completeness(txn).first()
    assert (row.sin_customer_id, row.loyalty_false, row.loyalty_true, row.diferencia) == (2, 1, 1, 1)
    card = quality.audit_scorecard(txn).first()
    assert (card.montos_invalidos, card.transacciones_no_completadas, card.tiendas_activas) == (1, 1, 2)
    assert (card.transaction_id_duplicados, card.fecha_maxima) == (0, day("2024-01-03"))


def test_orphans_include_null_keys(make, sales):
    txn = sales(("A", "S", "2024-01-01", 1), ("B", "X", "2024-01-01", 1), ("C", None, "2024-01-01", 1))
    stores = make("stores", {"store_id": "S"})
    assert rows(quality.audit_orphans(txn, stores, "store_id")) == [("X", 1), (None, 1)]


def test_gap_bands(sales):
    starts, lines, at = [2, 3, 7, 8, 14, 15], [], 0
    import datetime
    first = datetime.date(2024, 1, 1)
    lines.append(("T0", "S", str(first), 1))
    for i, idle in enumerate(starts, 1):
        at += idle + 1
        lines.append((f"T{i}", "S", str(first + datetime.timedelta(days=at)), 1))
    txn = sales(*lines)
    got = [(r.dias_sin_ventas, r.severidad) for r in quality.audit_sales_gaps(txn).orderBy("gap_inicio").collect()]
    assert got == [(3, "REVISAR"), (7, "REVISAR"), (8, "ALERTA"), (14, "ALERTA"), (15, "CRITICO")]
    assert tuple(quality.audit_gap_summary(txn).first()) == (6, 1, 15, 4)


def test_pre_opening_and_cleaning(make, sales):
    stores = make("stores", {"store_id": "S", "opening_date": "2024-01-10"}, {"store_id": "N"})
    txn = sales(("before", "S", "2024-01-09", 5), ("on", "S", "2024-01-10", 5), ("after", "S", "2024-01-11", 5),
                ("zero", "S", "2024-01-11", 0), ("back", "S", "2024-01-11", 5, {"status": "RETURNED"}),
                ("lost", "X", "2024-01-11", 5), ("undated", "N", "2024-01-11", 5))
    assert rows(quality.audit_pre_opening(txn, stores)) == [("S", day("2024-01-10"), day("2024-01-09"), 1)]
    assert tuple(quality.audit_pre_opening_totals(txn, stores).first()) == (1, 1)
    assert sorted(r.transaction_id for r in base.clean_transactions(txn, stores).collect()) == ["after", "on"]
    items = _items(make, ("L", "on", "I", 1, 0, False), ("M", "on", "I", 1, 0, None))
    assert rows(base.excluded_rows(txn, items, stores), "row_id", "motivo") == [
        ("L", "precio_cero_sin_promo"), ("before", "pre_apertura"), ("lost", "tienda_huerfana"), ("zero", "monto_invalido")]


def _promos(make, *rows_):
    names = ("store_id", "promo_name", "variant", "start_date", "end_date")
    return make("store_promotions", *[dict(zip(names, r), promo_type="EXHIBICION") for r in rows_])


def test_dual_assignment_grain_and_overlap(make):
    promos = _promos(
        make, ("same", "P", "CONTROL", "2024-01-01", "2024-02-01"), ("same", "P", "TREATMENT", "2024-01-15", "2024-03-01"),
        ("two", "P", "CONTROL", "2024-01-01", "2024-01-31"), ("two", "Q", "TREATMENT", "2024-02-01", "2024-02-28"),
        ("edge", "P", "TREATMENT", "2024-01-01", "2024-01-31"), ("edge", "P", "CONTROL", "2024-01-31", "2024-02-28"),
        ("clean", "P", "CONTROL", "2024-01-01", "2024-02-01"))
    fine = quality.audit_dual_assignment(promos)
    assert rows(fine, "store_id", "grupos_asignados") == [("edge", "CONTROL + TREATMENT"), ("same", "CONTROL + TREATMENT")]
    assert quality.audit_dual_assignment(promos, ["store_id"]).count() == 3
    assert rows(quality.audit_assignment_overlap(promos)) == [
        ("edge", True, day("2024-01-31")), ("same", True, day("2024-01-15")), ("two", False, None)]
    assert rows(quality.audit_variant_sizes(promos)) == [("CONTROL", 2), ("TREATMENT", 1)]


def test_findings_cover_all_dimensions(make, sales):
    txn = sales(("A", "S", "2024-01-01", 10, {"customer_id": "C", "loyalty_card": True}))
    tables = {
        "transactions": txn, "transaction_items": _items(make, ("1", "A", "I", 1, 10, False)),
        "stores": make("stores", {"store_id": "S", "opening_date": "2023-01-01"}),
        "products": make("products", {"item_id": "I", "vendor_id": "V9"}), "vendors": make("vendors", {"vendor_id": "V"}),
        "store_promotions": _promos(make, ("S", "P", "CONTROL", "2024-01-01", "2024-02-01"))}
    found = quality.audit_findings(tables).collect()
    assert {f.dimension for f in found} == {"Completitud", "Consistencia", "Unicidad", "Validez", "Integridad Referencial",
                                            "Frescura", "Integridad Temporal", "A/B Test"}
    by = {f.metrica: f for f in found}
    assert by["vendor_id_filas"].valor == 1.0 and by["vendor_id_filas"].decision == "EXCLUIR"
    assert by["con_discrepancia"].severidad == "Limpio" and by["con_discrepancia"].decision is None
    measures = [f for f in found if f.metrica not in quality.FINDINGS]
    assert measures and all(f.severidad is None and f.decision is None for f in measures)
    assert set(quality.FINDINGS) <= by.keys()
