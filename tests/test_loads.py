import datetime

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfline.operators import incremental
from shelfline.sources import readers, writers
from shelfline.streaming import feed

FACTS = "transaction_item_id string, date_id date, amount double, transaction_date date, _ingested_at timestamp"


@pytest.fixture(scope="module")
def staged(spark):
    def build(*lines):
        return spark.createDataFrame([
            (k, day(d), float(a), day(d), datetime.datetime.fromisoformat(t)) for k, d, a, t in lines], FACTS)
    return build


def _read(spark, path):
    return rows(spark.read.schema(FACTS).parquet(path), "transaction_item_id", "date_id", "amount")


def test_upsert_moves_corrects_and_repeats(spark, staged, tmp_path):
    path = str(tmp_path / "facts")
    incremental.upsert_facts(spark, path, staged(
        ("a", "2024-01-01", 1, "2024-01-02T00:00"), ("b", "2024-01-01", 2, "2024-01-02T00:00"),
        ("c", "2024-01-05", 3, "2024-01-06T00:00"), ("c", "2024-01-05", 2.5, "2024-01-05T00:00")))
    assert _read(spark, path) == [("a", day("2024-01-01"), 1.0), ("b", day("2024-01-01"), 2.0), ("c", day("2024-01-05"), 3.0)]
    batch = staged(("c", "2024-01-07", 9, "2024-01-08T00:00"), ("a", "2024-01-01", 5, "2024-01-08T00:00"),
                   ("n", "2024-01-07", 4, "2024-01-08T00:00"))
    expected = [("a", day("2024-01-01"), 5.0), ("b", day("2024-01-01"), 2.0), ("c", day("2024-01-07"), 9.0),
                ("n", day("2024-01-07"), 4.0)]
    for _ in range(2):
        touched = incremental.upsert_facts(spark, path, batch)
        assert _read(spark, path) == expected
    assert "2024-01-07" in touched
    assert not (tmp_path / "facts" / "date_id=2024-01-05").exists()
    stale = staged(("a", "2024-01-01", -1, "2024-01-03T00:00"))
    incremental.upsert_facts(spark, path, stale)
    assert _read(spark, path) == expected


def test_upsert_finishes_a_run_that_died_before_the_swap(spark, staged, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    incremental.upsert_facts(spark, path, staged(("a", "2024-01-01", 1, "2024-01-02T00:00"), ("b", "2024-01-02", 2, "2024-01-02T00:00")))
    batch = staged(("a", "2024-01-02", 7, "2024-01-03T00:00"))
    with monkeypatch.context() as m:
        def die(*_):
            raise RuntimeError("executor lost")
        m.setattr(incremental, "drop_partitions", die)
        with pytest.raises(RuntimeError):
            incremental.upsert_facts(spark, path, batch, run_id="batch-7")
    incremental.upsert_facts(spark, path, batch, run_id="batch-7")
    assert _read(spark, path) == [("a", day("2024-01-02"), 7.0), ("b", day("2024-01-02"), 2.0)]


def test_late_rows_are_split_before_the_load(spark, staged, tmp_path):
    source, facts, late = (str(tmp_path / n) for n in ("in", "facts", "late"))
    staged(("three", "2024-01-01", 1, "2024-01-04T00:00"), ("four", "2024-01-01", 1, "2024-01-05T00:00"),
           ("now", "2024-01-04", 1, "2024-01-04T00:00")).write.parquet(source)
    routed = incremental.route_late(spark.read.parquet(source))
    assert rows(routed, "transaction_item_id", "ruta") == [("four", "cuarentena"), ("now", "corregir"), ("three", "corregir")]
    stream = spark.readStream.schema(FACTS).parquet(source)
    feed.load_stream(stream, facts, late, str(tmp_path / "cp")).awaitTermination()
    assert [r[0] for r in _read(spark, facts)] == ["now", "three"]
    assert rows(spark.read.parquet(late), "transaction_item_id") == [("four",)]


def test_streams_never_meet_each_others_files(spark, staged, tmp_path):
    """Checkpoints that share their last folder name, and a fresh checkpoint at the same path for the same tables."""
    def load(name, n, checkpoint, table=None):
        table = table or name
        source = str(tmp_path / "in" / f"{name}{n}")
        staged((f"{name}{n}", "2024-01-04", n, "2024-01-04T00:00"), (f"late-{name}{n}", "2024-01-01", n, "2024-01-09T00:00")) \
            .write.parquet(source)
        stream = spark.readStream.schema(FACTS).parquet(source)
        feed.load_stream(stream, str(tmp_path / f"facts-{table}"), str(tmp_path / f"late-{table}"), str(checkpoint)).awaitTermination()

    for n in (0, 1):
        for name in "ab":
            load(name, n, tmp_path / name / str(n) / "checkpoint")
    load("c", 2, tmp_path / "fresh" / "checkpoint", "b")
    for table, want in (("a", ["a0", "a1"]), ("b", ["b0", "b1", "c2"])):
        assert [r[0] for r in _read(spark, str(tmp_path / f"facts-{table}"))] == want
        late = spark.read.parquet(str(tmp_path / f"late-{table}"))
        assert rows(late, "transaction_item_id") == [(f"late-{k}",) for k in want]


def test_missing_columns_are_named(spark, tmp_path):
    from shelfline.sources import schemas
    for name, schema in schemas.TABLES.items():
        names = ["store" if (name, f.name) == ("transactions", "store_id") else f.name for f in schema.fields
                 if f.name not in schemas.OPTIONAL.get(name, ())]
        (tmp_path / f"{name}.csv").write_text(",".join(names) + "\n" + ",".join("x" for _ in names) + "\n")
    with pytest.raises(ValueError, match="transactions.store_id"):
        readers.load_tables(spark, str(tmp_path))
    bad = {(r.tabla, r.columna): r.n for r in readers.malformed_values(spark, str(tmp_path)).collect()}
    assert bad["transactions", "total_amount"] == 1 and bad["transactions", "transaction_id"] == 0
    assert bad["transactions", "loyalty_card"] == 1


def test_freshness_sees_silent_stores(make, sales):
    stores = make("stores", *[dict(store_id=s) for s in ("fresh", "yesterday", "old", "silent")])
    txn = sales(("1", "fresh", "2024-01-10", 1), ("2", "yesterday", "2024-01-09", 1), ("3", "old", "2024-01-07", 1))
    alerts = incremental.freshness_alerts(txn, stores, "2024-01-10", "transaction_date")
    assert rows(alerts) == [("old", day("2024-01-07"), 3), ("silent", None, None)]
    lights = incremental.freshness_status(txn, stores, "2024-01-10", "transaction_date")
    assert rows(lights, "store_id", "semaforo") == [
        ("fresh", "VERDE"), ("old", "AMARILLO"), ("silent", "ROJO"), ("yesterday", "VERDE")]
    assert incremental.complete_days(txn, "2024-01-10").count() == 2


def test_privacy(spark, sales):
    txn = sales(("1", "S", "2024-01-10", 1, {"customer_id": "C"}), ("2", "S", "2024-01-20", 1, {"customer_id": "C"}),
                ("3", "S", "2024-02-20", 1, {"customer_id": "C"}), ("4", "S", "2024-03-20", 1, {"customer_id": "C"}),
                ("5", "S", "2024-01-20", 1))
    salts = spark.createDataFrame([(day("2024-01-01"), "x"), (day("2024-02-01"), "y")], "month date, salt string")
    keyed = incremental.pseudonymize(txn, salts)
    assert "customer_id" not in keyed.columns
    got = {r.transaction_id: r.customer_key for r in keyed.collect()}
    assert got["1"] == got["2"] != got["3"] and len(got["1"]) == 64 and got["4"] is None and got["5"] is None
    kept = incremental.anonymize_expired(txn, "2026-01-15")
    assert rows(kept.filter("customer_id is null"), "transaction_id") == [("1",), ("5",)]


def test_reconciliation_explains_the_difference(make, sales):
    txn = sales(("1", "S", "2024-01-10", 10), ("2", "S", "2024-01-10", 5, {"status": "RETURNED"}), ("3", "S", "2024-01-10", 2))
    items = make("transaction_items", dict(transaction_id="1", quantity=1, unit_price=9), dict(transaction_id="2", quantity=1, unit_price=5),
                 dict(transaction_id="x", quantity=1, unit_price=4))
    got = {r.store_id: r for r in incremental.gmv_reconciliation(txn, items).collect()}
    assert (got["S"].gmv_header, got["S"].gmv_lines, got["S"].diff_returns, got["S"].diff_header_lines) == (17.0, 14.0, 5.0, 3.0)
    assert got[None].gmv_lines == 4.0


def test_daily_aggregates_refresh_only_the_given_days(spark, tmp_path):
    path = str(tmp_path / "agg")
    schema = "store_id string, date_id date, gross_revenue double, gross_margin double, quantity double, is_returned boolean"
    old = spark.createDataFrame([("S", day("2024-01-01"), 1.0, 1.0, 1.0, False), ("S", day("2024-01-02"), 2.0, 1.0, 1.0, False)], schema)
    incremental.refresh_daily_aggregates(old, path)
    new = old.withColumn("gross_revenue", F.col("gross_revenue") * 10)
    incremental.refresh_daily_aggregates(new, path, ["2024-01-02"])
    assert rows(spark.read.parquet(path), "date_id", "gross_revenue") == [(day("2024-01-01"), 1.0), (day("2024-01-02"), 20.0)]


def test_streams_equal_batch_once_the_watermark_has_passed(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, 12)
    data = [(f"i{n}", f"S{n % 3}", start + datetime.timedelta(hours=7 * n), float(n)) for n in range(150)]
    src = str(tmp_path / "in")
    schema = "transaction_item_id string, store_id string, event_time timestamp_ntz, amount double"
    spark.createDataFrame(data + data[:40], schema).repartition(4).write.parquet(src)
    stream = feed.event_time(feed.stream_ingest(spark, src, schema, files_per_trigger=10), "event_time")
    unique = feed.stream_dedupe(stream)
    feed.write_stream(unique, str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 150
    weekly = feed.stream_weekly_gmv(feed.event_time(feed.stream_ingest(spark, str(tmp_path / "d"), stream.schema), "event_time"))
    feed.write_stream(weekly, str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    got = spark.read.schema(weekly.schema).parquet(str(tmp_path / "w"))
    last = data[-1][2] - datetime.timedelta(days=3)
    expected = {}
    for _, store, ts, amount in data:
        monday = (ts - datetime.timedelta(days=ts.weekday())).date()
        if datetime.datetime.combine(monday, datetime.time()) + datetime.timedelta(days=7) <= last:
            g, n = expected.get((store, monday), (0.0, 0))
            expected[(store, monday)] = (g + amount, n + 1)
    assert expected and {(r.store_id, r.week): (r.gmv, r.n_txn) for r in got.collect()} == expected


def test_tables_from_csv_with_and_without_optional_columns(spark, tmp_path):
    (tmp_path / "transactions.csv").write_text(
        "transaction_id,store_id,customer_id,transaction_date,total_amount,status,payment_method,loyalty_card\n"
        "T1,S1,,2024-01-02,10.50,COMPLETED,CASH,false\nT2,S1,C1,2024-01-03,-1,RETURNED,CARD,true\n")
    (tmp_path / "transaction_items.csv").write_text(
        "transaction_item_id,transaction_id,item_id,quantity,unit_price,was_on_promo\nL1,T1,I1,2,5.25,False\n")
    (tmp_path / "stores.csv").write_text("store_id,opening_date,format,size_sqm,store_name,country\nS1,2020-01-01,EXPRESS,50,Uno,CR\n")
    (tmp_path / "products.csv").write_text("item_id,item_name,category,vendor_id,cost\nI1,Pan,Alimentos,V1,1.5\n")
    (tmp_path / "vendors.csv").write_text("vendor_id,vendor_name,tier\nV1,Proveedor,A\n")
    (tmp_path / "store_promotions.csv").write_text(
        "store_id,promo_name,variant,promo_type,start_date,end_date\nS1,P,CONTROL,E,2024-01-01,2024-02-01\n")
    tables = readers.load_tables(spark, str(tmp_path))
    first = tables["transactions"].orderBy("transaction_id").first()
    assert first.customer_id is None and str(first.total_amount) == "10.50" and first.transaction_date == day("2024-01-02")
    store = tables["stores"].first()
    assert (store.opening_date, store.size_sqm, store.city) == (day("2020-01-01"), 50, None)
    assert tables["products"].first().cost == 1.5 and tables["transaction_items"].first().was_on_promo is False
    readers.register_views(tables)
    assert spark.sql("SELECT count(*) FROM stores JOIN transactions USING (store_id)").first()[0] == 2
    assert ("transactions", 2, 8) in rows(readers.table_row_counts(tables))


def test_results_in_every_format(spark, tmp_path):
    df = spark.createDataFrame([(18, 14449.7231, None)], "n_control int, mean_control double, note string")
    for fmt in ("json", "parquet", "csv", "text"):
        writers.write_result(df, str(tmp_path / fmt), fmt)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == [
        "mean_control=14449.7231", "n_control=18", "note="]
    assert spark.read.json(str(tmp_path / "json")).first().n_control == 18


def test_bucketed_headers_and_lines_join_without_a_shuffle(spark):
    headers = spark.range(1000).select(F.col("id").alias("transaction_id"), F.lit("S").alias("store_id"))
    lines = spark.range(3000).select((F.col("id") % 1000).alias("transaction_id"), F.col("id").alias("item_id"))
    writers.write_bucketed(headers, "bucketed_headers", "transaction_id", 4)
    writers.write_bucketed(lines, "bucketed_lines", "transaction_id", 4)
    joined = spark.table("bucketed_lines").join(spark.table("bucketed_headers").hint("merge"), "transaction_id")
    assert joined.count() == 3000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
