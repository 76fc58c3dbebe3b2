"""Data-quality audit: completeness, consistency, uniqueness, validity, references, freshness, experiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import count_when, line_revenue, line_total, money, pct
from ..functions.relational import exact_quantile, first_row, gaps, value_counts


def audit_completeness(txn: DataFrame) -> DataFrame:
    """Missing customers against loyalty-card use."""
    rows = F.count(F.lit(1))
    missing = count_when(F.col("customer_id").isNull())
    without, with_card = count_when(~F.col("loyalty_card")), count_when(F.col("loyalty_card"))
    return txn.agg(
        rows.alias("total_transacciones"), missing.alias("sin_customer_id"),
        pct(missing, rows).alias("pct_sin_customer"), without.alias("loyalty_false"),
        with_card.alias("loyalty_true"), pct(without, rows).alias("pct_sin_lealtad"),
        pct(with_card, rows).alias("pct_con_lealtad"), F.abs(missing - without).alias("diferencia"))


def header_line_differences(txn: DataFrame, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Header amount, line sum and their absolute difference for every header with lines."""
    lines = items.groupBy("transaction_id").agg(
        money(line_total(line_revenue())).alias("suma_items"))
    headers = txn.select("transaction_id", *keep, money("total_amount").alias("total_amount"))
    return headers.join(lines, "transaction_id").withColumn(
        "diferencia", F.abs(F.col("total_amount") - F.col("suma_items")).cast("decimal(24,4)"))


def _tolerance(tol) -> Column:
    return F.lit(Decimal(str(tol)))


def audit_header_vs_lines(txn: DataFrame, items: DataFrame, tol=0.02) -> DataFrame:
    """Headers that differ from their lines by more than ``tol``: count, share, max, mean, median.

    Everything is taken from one table of distinct differences and their counts, so the join runs once and
    the median needs no task that holds all differences.
    """
    diff = F.col("diferencia")
    counts = value_counts(header_line_differences(txn, items), "diferencia")
    off = diff > _tolerance(tol)
    median = exact_quantile(counts.filter(off), "diferencia", 0.5, name="diferencia_mediana")
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("transacciones_comparadas"),
        F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)).alias("con_discrepancia"),
        pct(F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)), F.sum("n")).alias("pct_discrepancia"),
        F.max("diferencia").cast("double").alias("diferencia_maxima"),
        (F.sum(F.when(off, diff * F.col("n"))).cast("double") / F.sum(F.when(off, F.col("n"))))
        .alias("diferencia_promedio"),
    ).withColumn("diferencia_mediana", median.scalar())


def audit_top_discrepancies(txn: DataFrame, items: DataFrame, tol=0.02, n: int | None = 5) -> DataFrame:
    """The ``n`` largest discrepancies; all of them for None."""
    found = (
        header_line_differences(txn, items, ["store_id"]).filter(F.col("diferencia") > _tolerance(tol))
        .orderBy(F.desc("diferencia"), "transaction_id")
        .select("transaction_id", "store_id",
                *[F.col(c).cast("double").alias(c) for c in ("total_amount", "suma_items", "diferencia")]))
    return found if n is None else found.limit(n)


def audit_uniqueness(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, distinct keys and duplicates per table, both ways of treating null keys.

    ``duplicados`` follows COUNT(DISTINCT), which skips nulls; ``duplicados_con_nulos`` counts a repeated null
    key as a duplicate. Counting per key first lets a much repeated key combine before the shuffle.
    """
    def one(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        rows, distinct = F.coalesce(F.sum("n"), F.lit(0)), count_when(known)
        return per_key.agg(
            F.lit(name).alias("tabla"), rows.alias("total_filas"), distinct.alias("ids_unicos"),
            (rows - distinct).alias("duplicados"), (rows - F.count(F.lit(1))).alias("duplicados_con_nulos"))
    return reduce(DataFrame.unionByName, [one(name, df, keys) for name, (df, keys) in tables.items()])


def audit_duplicate_keys(df: DataFrame, keys: Sequence[str], n: int | None = 10) -> DataFrame:
    """The ``n`` keys seen most often, more than once; all of them for None."""
    found = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("veces")).filter(F.col("veces") > 1)
        .orderBy(F.desc("veces"), *keys))
    return found if n is None else found.limit(n)


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key by ``order``."""
    return first_row(df, keys, order, last=True)


def audit_amount_validity(txn: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    return txn.agg(
        count_when(amount <= 0).alias("montos_invalidos"), count_when(amount < 0).alias("montos_negativos"),
        count_when(amount == 0).alias("montos_cero"), F.min(amount).cast("double").alias("minimo"),
        F.max(amount).cast("double").alias("maximo"))


def audit_invalid_rows(txn: DataFrame) -> DataFrame:
    return txn.filter(F.col("total_amount") <= 0).select(
        "transaction_id", "store_id", "transaction_date", F.col("total_amount").cast("double").alias("total_amount"),
        "status", "payment_method")


def audit_zero_price(items: DataFrame) -> DataFrame:
    """Zero-price lines; a line whose promotion flag is unknown is in neither of the two parts."""
    zero, promo = F.col("unit_price") == 0, F.col("was_on_promo")
    return items.agg(
        count_when(zero).alias("precio_cero_total"), count_when(zero & ~promo).alias("precio_cero_sin_promo"),
        count_when(zero & promo).alias("precio_cero_con_promo"),
        pct(count_when(zero), F.count(F.lit(1))).alias("pct_precio_cero"))


def audit_orphans(child: DataFrame, parent: DataFrame, key: str, name: str = "filas_huerfanas") -> DataFrame:
    """Foreign-key values without a parent and the rows they affect; a null key is an orphan.

    Child rows are combined per key first: the anti join sees one row per key value.
    """
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return per_key.join(parent.select(key), key, "left_anti")


def audit_sales_gaps(txn: DataFrame, min_days: int = 3) -> DataFrame:
    """Stretches of ``min_days`` or more days without a sale per store, with a severity band."""
    idle = F.col("idle_days")
    return gaps(txn, ["store_id"], "transaction_date").filter(idle >= min_days).select(
        "store_id", F.col("prev_day").alias("gap_inicio"), F.col("next_day").alias("gap_fin"),
        idle.alias("dias_sin_ventas"),
        F.when(idle.between(3, 7), "REVISAR").when(idle.between(8, 14), "ALERTA").when(idle > 14, "CRITICO")
        .alias("severidad"))


def audit_gap_summary(txn: DataFrame) -> DataFrame:
    """Gaps of a day or more over all stores; large ones have more than six idle days."""
    return gaps(txn, ["store_id"], "transaction_date").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("idle_days").alias("m"), count_when(F.col("idle_days") > 6).alias("big"),
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("gaps"), F.count(F.lit(1)).alias("tiendas_con_gaps"),
        F.max("m").alias("gap_maximo"), F.coalesce(F.sum("big"), F.lit(0)).alias("gaps_mayores_6"))


def audit_pre_opening(txn: DataFrame, stores: DataFrame) -> DataFrame:
    """Per store: opening day, first sale and the number of sales before opening.

    Sales are counted per store and day first, so the join sees calendar rows instead of transactions.
    """
    per_day = txn.groupBy("store_id", "transaction_date").agg(F.count(F.lit(1)).alias("n"))
    opened = stores.select("store_id", "opening_date")
    early = per_day.join(opened, "store_id").filter(F.col("transaction_date") < F.col("opening_date"))
    return early.groupBy("store_id", "opening_date").agg(
        F.min("transaction_date").alias("primera_tx"), F.sum("n").alias("tx_antes_apertura"))


def audit_pre_opening_totals(txn: DataFrame, stores: DataFrame) -> DataFrame:
    return audit_pre_opening(txn, stores).agg(
        F.coalesce(F.sum("tx_antes_apertura"), F.lit(0)).alias("transacciones_pre_apertura"),
        F.count(F.lit(1)).alias("tiendas_afectadas"))


def audit_dual_assignment(promos: DataFrame, grain: Sequence[str] = ("store_id", "promo_name")) -> DataFrame:
    """Units assigned to more than one variant, in one promotion or, with a coarser grain, in any."""
    labels = F.sort_array(F.collect_set("variant"))
    return (
        promos.groupBy(*grain).agg(labels.alias("_v")).filter(F.size("_v") > 1)
        .select(*grain, F.array_join("_v", " + ").alias("grupos_asignados"),
                F.lit("EXCLUIR DEL AB TEST").alias("accion")))


def audit_assignment_overlap(promos: DataFrame) -> DataFrame:
    """Do the CONTROL and TREATMENT date ranges of a store overlap, and from which day.

    Ranges overlap when, at the start of one, the other variant has a range begun no later and not yet
    ended. Starting days are combined first and a running maximum of end days answers it, so no pairs of
    ranges are formed.
    """
    starts = promos.filter(F.col("variant").isin("CONTROL", "TREATMENT")).groupBy("store_id", "start_date").agg(
        F.max(F.when(F.col("variant") == "CONTROL", F.col("end_date"))).alias("control_end"),
        F.max(F.when(F.col("variant") == "TREATMENT", F.col("end_date"))).alias("treatment_end"))
    upto = W.partitionBy("store_id").orderBy("start_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = (
        (F.col("control_end").isNotNull() & (F.max("treatment_end").over(upto) >= F.col("start_date")))
        | (F.col("treatment_end").isNotNull() & (F.max("control_end").over(upto) >= F.col("start_date"))))
    marked = starts.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return (
        marked.groupBy("store_id").agg(
            F.count("control_end").alias("_c"), F.count("treatment_end").alias("_t"),
            F.min(F.when(F.col("_hit"), F.col("start_date"))).alias("solape_desde"))
        .filter((F.col("_c") > 0) & (F.col("_t") > 0))
        .select("store_id", F.col("solape_desde").isNotNull().alias("se_solapan"), "solape_desde"))


def audit_variant_sizes(promos: DataFrame, grain: Sequence[str] = ("store_id", "promo_name")) -> DataFrame:
    """Stores per variant once stores with two variants are left out."""
    mixed = audit_dual_assignment(promos, grain).select("store_id").distinct()
    return promos.join(mixed, "store_id", "left_anti").groupBy("variant").agg(
        F.countDistinct("store_id").alias("tiendas"))


def audit_scorecard(txn: DataFrame) -> DataFrame:
    """One row summarising completeness, validity, uniqueness and the period.

    The distinct counts come from grouped frames rather than two distincts in one aggregate, which would
    double every row.
    """
    rows, amount = F.count(F.lit(1)), F.col("total_amount")
    per_store = txn.groupBy("store_id").agg(
        rows.alias("n"), count_when(F.col("customer_id").isNull()).alias("anon"),
        count_when(F.col("loyalty_card")).alias("loyal"), count_when(amount <= 0).alias("bad"),
        count_when(F.col("status") != "COMPLETED").alias("open"),
        F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"))
    ids = txn.agg(F.countDistinct("transaction_id").alias("ids"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return per_store.agg(
        pct(F.sum("anon"), n).alias("pct_sin_customer_id"), pct(F.sum("loyal"), n).alias("pct_con_lealtad"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("montos_invalidos"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("transacciones_no_completadas"), n.alias("_n"),
        F.min("lo").alias("fecha_minima"), F.max("hi").alias("fecha_maxima"),
        F.count("store_id").alias("tiendas_activas"),
    ).withColumn("transaction_id_duplicados", F.col("_n") - ids.scalar()).drop("_n")


# Fixed severities and decisions of the faults; every other metric of the audit is a measure and has neither.
FINDINGS = {
    "sin_customer_id": ("Normal", "ACEPTAR"),
    "diferencia": ("Normal", "ACEPTAR"),
    "con_discrepancia": ("Media", "ALERTA"),
    "duplicados_transactions": ("Alta", "CONSERVAR ULTIMO"),
    "duplicados_transaction_items": ("Alta", "CONSERVAR ULTIMO"),
    "montos_invalidos": ("Alta", "EXCLUIR"),
    "montos_negativos": ("Alta", "EXCLUIR"),
    "montos_cero": ("Alta", "EXCLUIR"),
    "precio_cero_sin_promo": ("Media", "EXCLUIR"),
    "store_id_filas": ("Media", "EXCLUIR"),
    "vendor_id_filas": ("Media", "EXCLUIR"),
    "item_id_filas": ("Media", "EXCLUIR"),
    "gaps_mayores_6": ("Media", "INVESTIGAR"),
    "transacciones_pre_apertura": ("Alta", "EXCLUIR"),
    "asignaciones_dobles": ("Crítica", "EXCLUIR"),
}


def _long(df: DataFrame, dimension: str, prefix: str = "") -> DataFrame:
    """One-row check to (dimension, metric, value) rows."""
    cells = [F.struct(F.lit(prefix + c).alias("metrica"), F.col(c).cast("double").alias("valor")) for c in df.columns]
    return df.select(F.lit(dimension).alias("dimension"), F.inline(F.array(*cells)))


def audit_findings(tables: Mapping[str, DataFrame], tol=0.02) -> DataFrame:
    """All eight checks as one long table; faults that were found have a severity and a decision."""
    txn, items = tables["transactions"], tables["transaction_items"]
    stores, products, vendors = tables["stores"], tables["products"], tables["vendors"]

    def orphan_totals(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        return audit_orphans(child, parent, key, "n").agg(
            F.count(F.lit(1)).alias("valores"), F.coalesce(F.sum("n"), F.lit(0)).alias("filas"))

    unique = audit_uniqueness({
        "transactions": (txn, ["transaction_id"]), "transaction_items": (items, ["transaction_item_id"])})
    parts = [
        _long(audit_completeness(txn), "Completitud"),
        _long(audit_header_vs_lines(txn, items, tol), "Consistencia"),
        unique.select(F.lit("Unicidad").alias("dimension"),
                      F.concat(F.lit("duplicados_"), F.col("tabla")).alias("metrica"),
                      F.col("duplicados_con_nulos").cast("double").alias("valor")),
        _long(audit_amount_validity(txn), "Validez"),
        _long(audit_zero_price(items), "Validez"),
        _long(orphan_totals(txn, stores, "store_id"), "Integridad Referencial", "store_id_"),
        _long(orphan_totals(products, vendors, "vendor_id"), "Integridad Referencial", "vendor_id_"),
        _long(orphan_totals(items, products, "item_id"), "Integridad Referencial", "item_id_"),
        _long(audit_gap_summary(txn), "Frescura"),
        _long(audit_pre_opening_totals(txn, stores), "Integridad Temporal"),
        _long(audit_dual_assignment(tables["store_promotions"]).agg(F.count(F.lit(1)).alias("asignaciones_dobles")),
              "A/B Test"),
    ]
    found = reduce(DataFrame.unionByName, parts)
    fault, clean = F.col("metrica").isin(*FINDINGS), F.col("valor") == 0

    def graded(place: int) -> Column:
        table = F.create_map(*[F.lit(x) for name, entry in FINDINGS.items() for x in (name, entry[place])])
        return F.try_element_at(table, F.col("metrica"))

    return found.select(
        "dimension", "metrica", "valor", F.when(fault & clean, "Limpio").otherwise(graded(0)).alias("severidad"),
        F.when(~(fault & clean), graded(1)).alias("decision"))
