"""Daily loads: upserts with corrections, freshness, aggregates, privacy, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import as_date, col, line_revenue, line_total, money, month_start
from ..functions.relational import first_row
from ..session import scratch_path
from ..sources.writers import drop_partitions, path_exists, remove_path, write_bucketed, write_partitioned


def route_late(df: DataFrame, days: int = 3, event_day: str = "transaction_date",
               ingested: str = "_ingested_at") -> DataFrame:
    """Mark each row ``corregir`` (at most ``days`` late) or ``cuarentena`` (later, or without a date)."""
    late = F.datediff(F.col(ingested).cast("date"), F.col(event_day).cast("date"))
    return df.withColumn("dias_retraso", late).withColumn(
        "ruta", F.when(late <= days, "corregir").otherwise("cuarentena"))


def upsert_facts(spark: SparkSession, path: str, staging: DataFrame, key: str = "transaction_item_id",
                 by: str = "date_id", order: str = "_ingested_at", run_id: str | None = None,
                 index: str | None = None) -> list[str]:
    """Update or insert staged rows in a parquet table partitioned by ``by``; returns the touched partitions.

    Per key the newest staged row wins, and a staged row older than the stored one is ignored, so replays
    and batches out of order do no harm. A correction may move a row to another date: the partitions
    rewritten are those of the new dates and of the dates the keys had before. Finding the latter reads three
    columns of the table, other partitions are not touched. With ``index``, the name of a ``key_index`` table that
    this function then keeps, the table itself is not read for it: staged keys meet the index in its buckets.

    The rewritten partitions are first completed in the shared scratch folder and then put in place. A run
    that dies in between is repeated with its ``run_id``, which must be unique for the table, and finishes from
    there; the scratch folder goes once all is in place. ``by`` must have few values, such as dates: those of the
    touched partitions are listed on the driver.
    """
    root = scratch_path(spark, "upsert")
    if run_id:
        target_id = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
        root = f"{root.rsplit('/', 1)[0]}/upsert-{target_id}-{run_id}"
    rewritten, touched_path = f"{root}/rows", f"{root}/touched"
    part = F.col(by).cast("string").alias("part")
    newest = first_row(staging, [key], [order], last=True)
    if not path_exists(spark, path):
        write_partitioned(newest, path, by)
        if index:
            key_index(newest, index, key, by, order)
        return sorted(r.part for r in spark.read.schema(staging.schema).parquet(path).select(part).distinct().collect())
    if not path_exists(spark, f"{rewritten}/_SUCCESS"):
        target = spark.read.schema(staging.schema).parquet(path)
        if index:
            hits = indexed(spark, index, newest.select(key), key, by, order)
        else:
            hits = (
                target.select(key, by, order).join(newest.select(key), key, "left_semi").groupBy(key)
                .agg(F.max(order).alias("_stored"), F.collect_set(F.col(by).cast("string")).alias("_old")))
        fresh = newest.join(hits, key, "left").filter(
            F.col("_stored").isNull() | (F.col("_stored") <= F.col(order))).drop("_stored")
        fresh.write.mode("overwrite").parquet(f"{root}/fresh")
        fresh = spark.read.parquet(f"{root}/fresh")
        old = F.coalesce("_old", F.array().cast("array<string>"))
        fresh.select(F.explode(F.array_union(old, F.array(F.col(by).cast("string")))).alias("part")).distinct(
        ).write.mode("overwrite").parquet(touched_path)
        parts = [r.part for r in spark.read.parquet(touched_path).collect()]
        kept = target.filter(F.col(by).cast("string").isin(parts)).join(fresh.select(key), key, "left_anti")
        kept.unionByName(fresh.select(*staging.columns)).write.mode("overwrite").parquet(rewritten)
    touched = sorted(r.part for r in spark.read.parquet(touched_path).collect())
    done = spark.read.schema(staging.schema).parquet(rewritten)
    filled = {r.part for r in done.select(part).distinct().collect()}
    if filled:
        (done.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
    drop_partitions(spark, path, by, [p for p in touched if p not in filled])
    if index:
        key_index(spark.read.schema(staging.schema).parquet(f"{root}/fresh"), index, key, by, order)
    remove_path(spark, root)
    return touched


def key_index(rows: DataFrame, table: str, key: str, by: str, order: str = "_ingested_at",
              buckets: int = 64) -> None:
    """Add rows to the catalog table ``table`` of key, partition and order, bucketed by key; created if absent.

    A key has a row for each time it was written, the newest by ``order`` being where it is now. Rows added twice
    change nothing. An existing table keeps its own number of buckets.
    """
    spark = rows.sparkSession
    if spark.catalog.tableExists(table):
        kept = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
        buckets = int(kept["data_type"])
    write_bucketed(rows.select(key, F.col(by).cast("string").alias("part"), order), table, key, buckets, "append")


def indexed(spark: SparkSession, table: str, keys: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """The partition and order that each of ``keys`` has in the index; neither the facts nor the index are shuffled.

    Only the staged keys are dealt into the index's buckets, and each bucket is joined and grouped where it lies.
    """
    found = spark.table(table).join(keys.hint("shuffle_hash"), key, "left_semi").groupBy(key).agg(
        F.max_by("part", order).alias("_part"), F.max(order).alias("_stored"))
    return found.select(key, "_stored", F.array("_part").alias("_old"))


def complete_days(df: DataFrame, as_of, day: str = "transaction_date") -> DataFrame:
    """Rows of days before ``as_of``: stores report up to two hours late, so the running day waits."""
    return df.filter(F.col(day).cast("date") < as_date(as_of))


def _last_days(facts: DataFrame, stores: DataFrame, day: str) -> DataFrame:
    """Last sale day of every known store; null for a store that never sent a row."""
    last = facts.groupBy("store_id").agg(F.max(day).alias("last_date"))
    return stores.select("store_id").join(last, "store_id", "left")


def freshness_alerts(facts: DataFrame, stores: DataFrame, as_of, day: str = "date_id") -> DataFrame:
    """Stores whose last day is before yesterday, silent stores included."""
    return _last_days(facts, stores, day).filter(
        F.col("last_date").isNull() | (F.col("last_date") < F.date_sub(as_date(as_of), 1))
    ).withColumn("dias_sin_datos", F.datediff(as_date(as_of), "last_date"))


def freshness_status(facts: DataFrame, stores: DataFrame, as_of, day: str = "date_id") -> DataFrame:
    """Traffic light per store: green up to one day old, amber up to three, red beyond or never."""
    age = F.datediff(as_date(as_of), "last_date")
    return _last_days(facts, stores, day).withColumn("dias_sin_datos", age).withColumn(
        "semaforo", F.when(age <= 1, "VERDE").when(age <= 3, "AMARILLO").otherwise("ROJO"))


def daily_aggregates(facts: DataFrame, by: Sequence[str] = ("store_id",)) -> DataFrame:
    """Revenue, margin, units and lines per day, the table dashboards read."""
    return facts.filter(~F.col("is_returned")).groupBy("date_id", *by).agg(
        line_total("gross_revenue").alias("gross_revenue"), line_total("gross_margin").alias("gross_margin"),
        line_total("quantity").alias("units"), F.count(F.lit(1)).alias("lines"))


def refresh_daily_aggregates(facts: DataFrame, path: str, days: Sequence | None = None,
                             by: Sequence[str] = ("store_id",)) -> None:
    """Rebuild the aggregate table, or only the partitions of the given ``days``."""
    if days is not None:
        facts = facts.filter(F.col("date_id").isin([str(d) for d in days]))
    (daily_aggregates(facts, by).hint("rebalance", "date_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "static" if days is None else "dynamic").partitionBy("date_id").parquet(path))


def pseudonymize(df: DataFrame, salts: DataFrame, id_col: str = "customer_id",
                 day: str = "transaction_date") -> DataFrame:
    """Replace the customer by SHA-256 of id and the month's salt (``month``, ``salt``).

    A month without a salt yields null, never the raw id. Keys of different months differ on purpose, so
    cohorts across months must be built before this step.
    """
    salted = df.withColumn("_month", month_start(day)).join(
        salts.select(F.col("month").alias("_month"), F.col("salt").alias("_salt")), "_month", "left")
    key = F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("_salt")), 256)
    return salted.withColumn("customer_key", key).drop("_month", "_salt", id_col)


def anonymize_expired(df: DataFrame, as_of, months: int = 24, id_col: str = "customer_id",
                      day: str = "transaction_date") -> DataFrame:
    """Null the customer of rows that are ``months`` old or older."""
    expired = F.add_months(col(day).cast("date"), months) <= as_date(as_of)
    return df.withColumn(id_col, F.when(~expired, F.col(id_col)))


def anonymize_stored(spark: SparkSession, path: str, schema, as_of, months: int = 24, id_col: str = "customer_id",
                     day: str = "transaction_date", by: str = "month_id") -> list[str]:
    """Null expired customers for good in a parquet table partitioned by month; returns the rewritten partitions.

    Only months that begin ``months`` ago or earlier are looked at, and of these only the ones that still hold an
    expired customer are written again: the files of all others stay as they are, and a second run finds nothing. The
    new contents are completed in the shared scratch folder first, from where a run that died is finished.
    """
    table = path.rstrip("/").replace("/", "_").replace(":", "_")
    root = f"{scratch_path(spark, 'anonymous').rsplit('/', 1)[0]}/anonymous-{table}-{as_of}"
    part = F.col(by).cast("string")
    if not path_exists(spark, f"{root}/_SUCCESS"):
        old = spark.read.schema(schema).parquet(path).filter(
            col(by).cast("date") <= F.add_months(as_date(as_of), -months))
        expired = F.col(id_col).isNotNull() & (F.add_months(col(day).cast("date"), months) <= as_date(as_of))
        parts = [r.part for r in old.filter(expired).select(part.alias("part")).distinct().collect()]
        if not parts:
            return []
        anonymize_expired(old.filter(part.isin(parts)), as_of, months, id_col, day).write.mode("overwrite").parquet(root)
    done = spark.read.schema(schema).parquet(root)
    (done.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))
    parts = sorted(r.part for r in done.select(part.alias("part")).distinct().collect())
    remove_path(spark, root)
    return parts


def gmv_reconciliation(txn: DataFrame, items: DataFrame) -> DataFrame:
    """Why two reports differ for a store and day: returned sales, and header against lines.

    Lines combine per transaction before they meet the headers; lines without a header form the null store.
    """
    lines = items.groupBy("transaction_id").agg(
        money(line_total(line_revenue())).alias("lines"))
    both = txn.select("transaction_id", "store_id", "transaction_date", "status",
                      money("total_amount").alias("header")).join(lines, "transaction_id", "full")
    done = F.col("status") == "COMPLETED"
    zero = F.lit(0).cast("decimal(28,4)")

    def amount(value, condition=None):
        return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), zero)

    header, line = F.col("header"), F.col("lines")
    grouped = both.groupBy("store_id", "transaction_date").agg(
        amount(header).alias("header_all"), amount(header, done).alias("header_done"),
        amount(line).alias("lines_all"), amount(line, done).alias("lines_done"))

    def out(expr, name):
        return expr.cast("double").alias(name)

    return grouped.select(
        "store_id", "transaction_date",
        out(F.col("header_all"), "gmv_header"), out(F.col("header_done"), "gmv_header_completed"),
        out(F.col("lines_all"), "gmv_lines"), out(F.col("lines_done"), "gmv_lines_completed"),
        out(F.col("header_all") - F.col("header_done"), "diff_returns"),
        out(F.col("header_done") - F.col("lines_done"), "diff_header_lines"))
