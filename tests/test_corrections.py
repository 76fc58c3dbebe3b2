"""Corrections after the fact: versions as of the sale, weekly sums, stored sums by deltas, key index, privacy."""

import datetime
import os

import pytest
from pyspark.sql import functions as F, types as T

from conftest import day, rows
from shelfline.operators import aggregates, cohorts, incremental, temporal
from shelfline.sources import writers
from shelfline.streaming import feed

VERSIONS = "store_id string, format string, size_sqm int, country string, valid_from date, valid_to date"
SALES = "fact_sale_id string, store_id string, date_id date, gross_revenue double, format string"


def versions(spark, *lines):
    return spark.createDataFrame([(s, f, 100, "CR", a and day(a), b and day(b)) for s, f, a, b in lines], VERSIONS)


def sold(spark, *lines):
    return spark.createDataFrame([(k, s, d and day(d), 1.0, "now") for k, s, d in lines], SALES)


def brute(lines, history):
    """Of each line the version with the latest start that has begun and not ended, and that no later one replaced."""
    out = []
    for k, s, d in lines:
        begun = [v for v in history if s is not None and v[0] == s and v[2] and d and v[2] <= d]
        latest = max(begun, key=lambda v: (v[2], v[3] is None, v[3] or ""), default=None)
        live = latest if latest and (latest[3] is None or d < latest[3]) else None
        out.append((k, live and live[1], live and day(live[2])))
    return sorted(out)


def test_each_line_meets_the_version_of_its_day(spark):
    history = [("a", "old", "2024-01-01", "2024-02-15"), ("a", "new", "2024-02-15", None),
               ("b", "one", "2024-01-10", "2024-01-20"), ("b", "two", "2024-03-01", None),
               ("c", "long", "2023-01-01", None), ("c", "cut in", "2024-02-10", None),
               ("d", "lost", None, None), ("d", "empty", "2024-02-01", "2024-02-01"), ("z", "unsold", "2024-01-01", None)]
    lines = [(f"{s}{d}", s, d) for s in ("a", "b", "c", "d", "e", None) for d in (
        "2023-12-31", "2024-01-01", "2024-01-10", "2024-01-19", "2024-01-20", "2024-02-01", "2024-02-09", "2024-02-10",
        "2024-02-14", "2024-02-15", "2024-03-01", "2024-05-31", None)]
    out = temporal.fact_sales_asof(sold(spark, *lines), versions(spark, *history))
    got = sorted(tuple(r) for r in out.select("fact_sale_id", "format", "store_valid_from").collect())
    assert got == brute([(f"{s}{d}", s, d) for _, s, d in lines], history)
    assert temporal.fact_sales_asof(sold(spark), versions(spark, *history)).count() == 0
    assert temporal.fact_sales_asof(sold(spark, *lines), versions(spark)).filter("format IS NULL").count() == len(lines)


def test_a_hot_store_is_joined_by_key_and_month(spark):
    facts = spark.range(60_000).select(
        F.col("id").cast("string").alias("fact_sale_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(
            F.concat(F.lit("s"), F.col("id") % 50)).alias("store_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("date_id"),
        F.lit(1.0).alias("gross_revenue"))
    history = versions(spark, *[("hot", f"v{k}", f"2024-{k:02}-15", None) for k in range(1, 13)])
    out = temporal.fact_sales_asof(facts, history)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 60_000 and out.filter("store_id = 'hot' AND format IS NULL").select("date_id").distinct().count() == 14


ROW = "id long, month_id string, sale_day date, kind string, amount double, _ingested_at timestamp"


def batch(spark, *lines):
    return spark.createDataFrame([(k, d[:7] + "-01", day(d), kind, a, datetime.datetime.fromisoformat(t))
                                  for k, d, kind, a, t in lines], ROW)


def load(spark, root, staging, run):
    return aggregates.upsert_with_aggregates(spark, f"{root}/facts", f"{root}/sums", staging, "id", "month_id",
                                             ("sale_day", "kind"), ("amount",), run)


def check_sums(spark, root):
    facts = spark.read.schema(ROW).parquet(f"{root}/facts")
    stored = spark.read.schema("month_id string, sale_day date, kind string, amount decimal(38,4), lines long").parquet(
        f"{root}/sums")
    assert rows(stored, "month_id", "sale_day", "kind", "amount", "lines") == rows(
        aggregates.summed(facts, "month_id", ("sale_day", "kind"), ("amount",)),
        "month_id", "sale_day", "kind", "amount", "lines")


FIRST = [(1, "2024-01-05", "x", 10.1, "2024-01-06"), (2, "2024-01-05", None, 5.0, "2024-01-06"),
         (3, "2024-02-01", "y", None, "2024-02-02"), (4, "2024-03-01", "y", 4.0, "2024-03-02"),
         (4, "2024-03-01", "y", 3.0, "2024-03-01")]
SECOND = [(1, "2024-01-05", "x", 0.2, "2024-03-05"), (2, "2024-02-09", "z", 5.0, "2024-03-05"),
          (3, "2024-02-01", "y", 9.0, "2024-01-01"), (5, "2024-01-31", "x", 7.0, "2024-03-05"),
          (5, "2024-01-31", "x", 6.0, "2024-03-04")]


def files(root, month):
    folder = f"{root}/sums/month_id={month}"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else None


def test_deltas_equal_a_recompute(spark, tmp_path):
    load(spark, tmp_path, batch(spark, *FIRST), "a")
    check_sums(spark, tmp_path)
    before = files(tmp_path, "2024-03-01")
    for run in ("b", "b", "c"):     # a repeat of the run, and the same rows sent again
        load(spark, tmp_path, batch(spark, *SECOND), run)
        check_sums(spark, tmp_path)
    assert files(tmp_path, "2024-03-01") == before
    assert load(spark, tmp_path, batch(spark), "d") == []
    assert load(spark, tmp_path, batch(spark, (4, "2024-04-01", "y", 4.0, "2024-04-02")), "e") == [
        "2024-03-01", "2024-04-01"]
    check_sums(spark, tmp_path)
    assert files(tmp_path, "2024-03-01") is None


@pytest.mark.parametrize("where", ["upsert_facts", "apply_deltas", "drop_partitions"])
def test_a_run_that_died_is_finished(spark, tmp_path, monkeypatch, where):
    load(spark, tmp_path, batch(spark, *FIRST), "a")
    real = getattr(aggregates, where)
    with monkeypatch.context() as m:
        def die(*args, **kw):
            if where == "upsert_facts":
                real(*args, **kw)       # the facts are in place, the sums are not
            raise RuntimeError("driver lost")
        m.setattr(aggregates, where, die)
        with pytest.raises(RuntimeError):
            load(spark, tmp_path, batch(spark, *SECOND), "b")
    load(spark, tmp_path, batch(spark, *SECOND), "b")
    check_sums(spark, tmp_path)


def test_the_key_index_finds_old_dates_without_the_facts(spark, tmp_path):
    path, table = str(tmp_path / "facts"), "keys_of_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for staging in (FIRST, SECOND, SECOND):
        incremental.upsert_facts(spark, path, batch(spark, *staging), "id", "month_id", index=table)
    plain = str(tmp_path / "plain")
    for staging in (FIRST, SECOND, SECOND):
        incremental.upsert_facts(spark, plain, batch(spark, *staging), "id", "month_id")
    assert rows(spark.read.schema(ROW).parquet(path)) == rows(spark.read.schema(ROW).parquet(plain))
    keys = spark.range(2000).select("id")
    found = incremental.indexed(spark, table, keys, "id", "month_id", "_ingested_at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "facts" not in plan and plan.count("Exchange hashpartitioning") <= 1
    scan = plan[:plan.index("FileScan")].splitlines()
    assert "Bucketed: true" in plan and not any("Exchange" in x for x in scan)
    assert {(r["id"], r["_old"][0]) for r in found.collect()} == {
        (1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-02-01"), (4, "2024-03-01"), (5, "2024-01-01")}
    spark.sql(f"DROP TABLE {table}")


def test_expired_customers_go_for_good(spark, tmp_path):
    path = str(tmp_path / "stored")
    schema = T.StructType.fromDDL("transaction_id long, customer_id long, transaction_date date, month_id string")
    lines = [(1, 7, "2022-01-10"), (2, 8, "2022-02-20"), (3, 9, "2022-02-21"), (4, None, "2021-12-01"), (5, 5, "2022-03-01")]
    writers.write_partitioned(spark.createDataFrame(
        [(k, c, day(d), d[:7] + "-01") for k, c, d in lines], schema), path, "month_id")
    shown = lambda: {m: sorted(os.listdir(f"{path}/month_id={m}")) for m in ("2021-12-01", "2022-03-01")}
    before = shown()
    assert incremental.anonymize_stored(spark, path, schema, "2024-02-20") == ["2022-01-01", "2022-02-01"]
    assert incremental.anonymize_stored(spark, path, schema, "2024-02-20") == []
    got = {r.transaction_id: r.customer_id for r in spark.read.schema(schema).parquet(path).collect()}
    assert got == {1: None, 2: None, 3: 9, 4: None, 5: 5} and shown() == before


def test_late_rows_correct_their_week_after_a_restart(spark, tmp_path):
    schema = "store_id long, event_time timestamp, amount double, _ingested_at timestamp"
    at = datetime.datetime.fromisoformat

    def run(*lines):
        spark.createDataFrame([(s, t and at(t), a, at(i)) for s, t, a, i in lines], schema).write.mode("append").parquet(
            str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
        feed.weekly_partials(stream, str(tmp_path / "sums"), str(tmp_path / "late"),
                             str(tmp_path / "checkpoint")).awaitTermination()
        return rows(feed.weekly_totals(spark.read.parquet(str(tmp_path / "sums"))), "store_id", "week", "gmv", "n_txn")

    first = run((1, "2024-01-07T23:00", 1.0, "2024-01-08"), (1, "2024-01-08T01:00", 2.0, "2024-01-08"),
                (2, "2024-03-01T00:00", 9.0, "2024-03-01"))
    assert first == [(1, day("2024-01-01"), 1.0, 1), (1, day("2024-01-08"), 2.0, 1), (2, day("2024-02-26"), 9.0, 1)]
    again = run((1, "2024-01-07T10:00", 0.5, "2024-01-10"), (1, "2024-01-07T10:00", 100.0, "2024-01-11"),
                (1, None, 100.0, "2024-01-11"))
    assert again == [(1, day("2024-01-01"), 1.5, 2), *first[1:]]
    assert spark.read.parquet(str(tmp_path / "late")).filter("amount = 100").count() == 2


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_malformed_lines_are_kept_as_sent(spark, tmp_path, fmt):
    schema = T.StructType.fromDDL("k long, name string, v decimal(10,2)")
    good = ["1,a,1.50", "2,,2.00", "4,d,"] if fmt == "csv" else ['{"k":1,"name":"a","v":1.5}', '{"k":2,"v":2}', '{"k":4,"name":"d"}']
    bad = ["x,b,1.0", "3,c,many", "5"] if fmt == "csv" else ['{"k":"x","name":"b","v":1}', '{"k":3,"v":"many"}', '{"k":5,']
    os.makedirs(tmp_path / "feed")
    (tmp_path / "feed" / "one").write_text("\n".join((["k,name,v"] if fmt == "csv" else []) + good[:2] + bad + good[2:]) + "\n")
    for _ in range(2):
        feed.rescue_stream(spark, str(tmp_path / "feed"), schema, str(tmp_path / "good"), str(tmp_path / "bad"),
                           str(tmp_path / "checkpoint"), fmt).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 4]
    assert sorted(r["_raw"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(bad)


def test_state_outside_the_heap(spark, tmp_path):
    """Many live keys, half of them sent again after a restart: what comes out is each key once."""
    schema = "transaction_item_id long, event_time timestamp"
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3600)

    def run(low, high):
        spark.range(low, high).select(F.col("id").alias("transaction_item_id"), when.alias("event_time")).write.mode(
            "append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        query = feed.write_stream(feed.stream_dedupe(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return feed.state_rows(query)

    assert run(0, 200_000) == 200_000
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run(100_000, 300_000) == 300_000
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 300_000 == out.distinct().count()
    assert any(name.endswith((".changelog", ".zip")) for _, _, names in os.walk(tmp_path / "checkpoint") for name in names)


def test_month_bitmaps_are_mergeable(spark, sales):
    lines = [(f"t{i}", "s", f"20{y:02}-{m:02}-1{i % 9}", 1.0, {"customer_id": f"c{(y * 7 + m * i) % 11}"})
             for i, (y, m) in enumerate([(18, 1), (18, 2), (19, 12), (20, 1), (20, 1), (20, 2), (24, 12), (25, 1), (20, 3)] * 6)]
    txn = sales(*lines, ("anonymous", "s", "2020-01-01", 1.0), ("back", "s", "2017-01-01", 1.0, {
        "customer_id": "c1", "status": "RETURNED"}))
    months = sorted({r[2][:7] for r in lines})
    loads = [cohorts.month_bits(txn.filter(F.col("transaction_date").cast("string").startswith(m))) for m in months]
    merged = cohorts.merged_bits(*loads[::-1], loads[0])
    assert rows(merged, "customer_id", "span", "bits") == rows(cohorts.month_bits(txn), "customer_id", "span", "bits")
    want = {}
    for c in {r[4]["customer_id"] for r in lines}:
        active = sorted({int(r[2][:4]) * 12 + int(r[2][5:7]) for r in lines if r[4]["customer_id"] == c})
        for m in active:
            cohort = day(f"{(active[0] - 1) // 12}-{(active[0] - 1) % 12 + 1:02}-01")
            want[cohort, m - active[0]] = want.get((cohort, m - active[0]), 0) + 1
    got = {(r.cohort, r.month_offset): (r.customers, r.cohort_size) for r in cohorts.activity_of_bits(merged).collect()}
    assert got == {k: (n, want[k[0], 0]) for k, n in want.items()}
