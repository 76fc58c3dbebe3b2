"""Sinks: stored results and date-partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Store a result as ``json``, ``parquet``, ``csv`` or ``text`` (``key=value`` lines of each row)."""
    if fmt == "text":
        lines = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
        df = df.select(F.explode(lines).alias("value"))
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, by: str | Sequence[str] = "date_id",
                      mode: str = "overwrite") -> None:
    """Write a table partitioned by date.

    ``rebalance`` groups rows by partition value and splits the ones that are too large, so a busy day gives
    several full files and a quiet one a single file.
    """
    by = [by] if isinstance(by, str) else list(by)
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Save a catalog table bucketed by a join key.

    Headers and lines bucketed alike by ``transaction_id`` join without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def drop_partitions(spark: SparkSession, path: str, by: str, values: Sequence[str]) -> None:
    """Remove partition folders that hold no rows any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for value in values:
        folder = hadoop(f"{path}/{by}={value}")
        folder.getFileSystem(conf).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
