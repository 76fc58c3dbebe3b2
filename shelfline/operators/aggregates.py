"""Stored aggregates kept up to date by signed deltas instead of recomputing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import money
from ..functions.relational import first_row
from ..session import scratch_path
from ..sources.writers import drop_partitions, path_exists, remove_path
from .incremental import upsert_facts

SUM = "decimal(38,4)"


def summed(rows: DataFrame, by: str, group: Sequence[str], measures: Sequence[str],
           sign: Column | None = None) -> DataFrame:
    """Exact sums of ``measures`` and the number of ``lines`` per group; rows count by their ``sign``."""
    sign = F.lit(1) if sign is None else sign
    return rows.groupBy(by, *group).agg(
        *[F.sum(money(m) * sign).cast(SUM).alias(m) for m in measures], F.sum(sign).cast("long").alias("lines"))


def signed_deltas(stored: DataFrame | None, staging: DataFrame, by: str, group: Sequence[str],
                  measures: Sequence[str], key: str, order: str = "_ingested_at") -> DataFrame:
    """What a staged batch changes in the sums: new values count up, the values they replace count down.

    Per key the newest staged row wins, and one older than the stored row changes nothing, as in ``upsert_facts``.
    Of the ``stored`` facts only the staged keys' rows leave the join.
    """
    columns = list(dict.fromkeys([by, *group, *measures]))
    newest = first_row(staging, [key], [order], last=True).select(key, F.struct(order, *columns).alias("new"))
    if stored is None:
        both = newest.withColumn("old", F.expr("cast(null as string)"))
        versions = F.array(F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
    else:
        old = stored.select(key, F.struct(order, *columns).alias("old"))
        both = newest.join(old, key, "left").filter(
            F.col("old").isNull() | (F.col(f"old.{order}") <= F.col(f"new.{order}")))
        # The rows of either side have one type, whatever the staged columns allow to be null.
        kind = both.schema["old"].dataType.simpleString()
        versions = F.filter(F.array(
            F.struct(F.lit(1).alias("sign"), F.col("new").cast(kind).alias("row")),
            F.struct(F.lit(-1).alias("sign"), F.col("old").cast(kind).alias("row"))), lambda v: v["row"].isNotNull())
    signed = both.select(F.explode(versions).alias("v")).select("v.sign", *[f"v.row.{c}" for c in columns])
    changed = summed(signed, by, group, measures, F.col("sign"))
    return changed.filter(" OR ".join(f"{m} <> 0" for m in [*measures, "lines"]))


def apply_deltas(spark: SparkSession, path: str, deltas: DataFrame, by: str, group: Sequence[str],
                 measures: Sequence[str], run_id: str) -> list[str]:
    """Add ``deltas`` to the sums stored at ``path``, partitioned by ``by``; returns the touched partitions.

    Only the partitions that have deltas are read and written again. Their new contents are completed in the shared
    scratch folder first and are absolute values, so a run that died may be repeated with its ``run_id``; one that
    came to its end is remembered beside the table and adds nothing when it is repeated.
    """
    done, root = f"{path.rstrip('/')}.runs/{run_id}", _root(spark, path, run_id)
    if path_exists(spark, f"{done}/_SUCCESS"):
        return []
    names = [by, *group, *measures, "lines"]
    if not path_exists(spark, f"{root}/sums/_SUCCESS"):
        deltas.select(F.col(by).cast("string").alias("part")).distinct().write.mode("overwrite").parquet(f"{root}/parts")
        parts = [r.part for r in spark.read.schema("part string").parquet(f"{root}/parts").collect()]
        both = deltas.select(*names)
        if path_exists(spark, path):
            both = both.unionByName(spark.read.schema(both.schema).parquet(path)
                                    .filter(F.col(by).cast("string").isin(parts)))
        sums = both.groupBy(by, *group).agg(*[F.sum(c).cast(both.schema[c].dataType).alias(c)
                                              for c in [*measures, "lines"]])
        sums.filter("lines <> 0").write.mode("overwrite").parquet(f"{root}/sums")
    parts = sorted(r.part for r in spark.read.schema("part string").parquet(f"{root}/parts").collect())
    sums = spark.read.schema(deltas.select(*names).schema).parquet(f"{root}/sums")
    filled = {r.part for r in sums.select(F.col(by).cast("string").alias("part")).distinct().collect()}
    if filled:
        (sums.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(by).parquet(path))
    drop_partitions(spark, path, by, [p for p in parts if p not in filled])
    spark.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.mode("overwrite").parquet(done)
    remove_path(spark, root)
    return parts


def upsert_with_aggregates(spark: SparkSession, facts_path: str, sums_path: str, staging: DataFrame, key: str,
                           by: str, group: Sequence[str], measures: Sequence[str], run_id: str,
                           order: str = "_ingested_at") -> list[str]:
    """Upsert a batch into the facts and carry what it changes into the stored sums; returns the touched partitions.

    The deltas are stored before the facts change, so the run can be repeated with its ``run_id`` from any point.
    """
    if path_exists(spark, f"{sums_path.rstrip('/')}.runs/{run_id}/_SUCCESS"):
        return []
    kept = f"{_root(spark, sums_path, run_id)}-deltas"
    if not path_exists(spark, f"{kept}/_SUCCESS"):
        stored = spark.read.schema(staging.schema).parquet(facts_path) if path_exists(spark, facts_path) else None
        signed_deltas(stored, staging, by, group, measures, key, order).write.mode("overwrite").parquet(kept)
    upsert_facts(spark, facts_path, staging, key, by, order, run_id)
    touched = apply_deltas(spark, sums_path, spark.read.parquet(kept), by, group, measures, run_id)
    remove_path(spark, kept)
    return touched


def _root(spark: SparkSession, path: str, run_id: str) -> str:
    """A run's scratch folder, the same whenever it is repeated."""
    table = path.rstrip("/").replace("/", "_").replace(":", "_")
    return f"{scratch_path(spark, 'sums').rsplit('/', 1)[0]}/sums-{table}-{run_id}"
