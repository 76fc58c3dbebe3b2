"""What the plans of the operators look like: what is read, how often data is shuffled, what never appears."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import day
from shelfline.functions import relational as rel
from shelfline.operators import business, explore, kpi, quality
from shelfline.plans.catalog import QUERIES
from shelfline.session import shuffle_partitions

WRITES = {"load_tables", "upsert_facts", "write_result", "write_partitioned", "kpi_checks", "kpi9_store_score", "pseudonymize",
          "load_stream", "stream_ingest", "stream_dedupe", "stream_weekly_gmv", "stream_weekly_corrected",
          "stream_rescue", "upsert_facts_indexed", "daily_aggregates_delta", "anonymize_stored"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_joins_no_forced_broadcast_no_python(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "Python", "ArrowEval"):
        assert word not in text


@pytest.fixture(scope="module")
def stored(spark, sales, make, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("canon"))
    sales(("1", "S", "2025-01-02", 5), ("2", "S", "2024-01-02", 5)).write.parquet(f"{root}/t")
    make("stores", dict(store_id="S", format="F", opening_date="2020-01-01", size_sqm=5)).write.parquet(f"{root}/s")
    return spark.read.parquet(f"{root}/t"), spark.read.parquet(f"{root}/s")


def test_periods_and_status_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(business.q2_sqm_productivity(*stored))
    pushed = next(m for m in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text) if "status" in m)
    assert "EqualTo(status,COMPLETED)" in pushed
    assert "GreaterThanOrEqual(transaction_date,2025-04-01)" in pushed and "LessThanOrEqual(transaction_date,2025-06-30)" in pushed


def test_only_needed_columns_are_read(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(business.q1_comp_sales(*stored))
    schema = next(m for m in re.findall(r"ReadSchema: struct<(.*?)>", text) if "total_amount" in m)
    assert [c.split(":")[0] for c in schema.split(",") if ":" in c] == [
        "store_id", "transaction_date", "total_amount", "status"]


def test_gap_detection_shuffles_once(spark):
    daily = spark.createDataFrame([("S", "I", day("2024-01-01"), 1.0, 1.0)],
                                  "store_id string, item_id string, fecha_venta date, unidades double, gmv_dia double")
    assert exchanges(business.stockout_gaps(daily)) == 1


def test_cohorts_read_transactions_once(stored):
    assert plan(business.q3_cohort_retention(stored[0])).count("FileScan") == 1


def test_a_hot_transaction_is_split(spark, no_broadcast):
    knobs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
             "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    before = {k: spark.conf.get(k) for k in knobs}
    for k, v in knobs.items():
        spark.conf.set(k, v)
    try:
        n = 200_000
        items = spark.range(n, numPartitions=16).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("transaction_id"),
            F.col("id").alias("item_id"), F.rand(1).alias("price"))
        headers = spark.range(n, numPartitions=16).select(F.col("id").alias("transaction_id"), (F.col("id") % 9).alias("s"))
        joined = business.lines_with_headers(items, headers).groupBy("s").agg(
            F.count(F.lit(1)).alias("n"), F.sum("price"))
        assert sum(r.n for r in joined.collect()) == n
        text = plan(joined)
        assert "skewed" in text and "skew=true" in text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_median_reuses_the_counted_differences(spark, sales, make, no_broadcast):
    txn = sales(("1", "S", "2025-01-02", 5), ("2", "S", "2024-01-02", 7))
    items = make("transaction_items", dict(transaction_id="1", quantity=1, unit_price=1), dict(transaction_id="2", quantity=1, unit_price=1))
    df = quality.audit_header_vs_lines(txn, items)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_checks_run_each_frame_once(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("F", day("2024-01-01"), 1.0, 40.0)],
                          "format string, week date, ticket double, variacion_pct double").write.parquet(f"{root}/3")
    spark.createDataFrame([("S", day("2024-01-01"), 20.0)],
                          "store_id string, week date, tasa_devolucion_pct double").write.parquet(f"{root}/5")
    checks = kpi.kpi_checks({f"kpi{k}": spark.read.parquet(f"{root}/{k}") for k in (3, 5)})
    assert plan(checks).count("FileScan") == 2 and exchanges(checks) == 1
    assert sorted(r.regla for r in checks.collect()) == ["devolucion_mayor_10", "ticket_fuera_de_rango", "varia_mas_30pct"]


def test_low_rotation_reads_sales_once(spark, tmp_path):
    base = spark.createDataFrame([("S", "I", "c", day("2024-01-01"), 1.0)],
                                 "store_id string, item_id string, category string, transaction_date date, revenue double")
    base.write.parquet(str(tmp_path / "b"))
    assert plan(explore.p4_low_rotation(spark.read.parquet(str(tmp_path / "b")))).count("FileScan") == 1


def test_first_row_combines_before_the_shuffle(spark):
    text = plan(rel.first_row(spark.range(10).select(F.col("id") % 2, "id").toDF("k", "v"), ["k"], ["v"]))
    assert "partial_min" in text and text.count("Exchange") == 1


def test_shuffle_partitions_follow_the_input():
    assert shuffle_partitions(1) == 1 and shuffle_partitions(10 * 2 ** 40) == 81_920
    assert shuffle_partitions(100 * 2 ** 40) == 819_200
