"""The hourly point-of-sale feed as Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import money
from ..operators.incremental import route_late, upsert_facts


def stream_ingest(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Raw files as a stream, stamped with their arrival time."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path).withColumn("_ingested_at", F.current_timestamp())


# State lives in RocksDB on the executors' disks, not on their heaps, and a batch uploads only its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a stream held after its last batch, over all its operators."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0


def write_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None,
                 partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to parquet: all that is there and stop, or ``every`` so often.

    A new stream keeps its state as ``STATE`` says; one that has a checkpoint goes on as it began.
    """
    for name, value in STATE.items():
        stream.sparkSession.conf.set(name, value)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Files carry timestamps without zone; watermarks need them as instants of the session zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_dedupe(stream: DataFrame, key: str = "transaction_item_id", ts: str = "event_time",
                  delay: str = "3 days") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; state is kept no longer than that."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_weekly_gmv(stream: DataFrame, by: Sequence[str] = ("store_id",), ts: str = "event_time",
                      amount: str = "amount", delay: str = "3 days") -> DataFrame:
    """Amount and sales per Monday week, emitted once a week is closed ``delay`` after its end.

    Weeks are tumbling windows counted from Thursday 1 January 1970, hence the shift of four days.
    """
    week = F.window(ts, "7 days", startTime="4 days")
    return stream.withWatermark(ts, delay).groupBy(week.alias("w"), *by).agg(
        F.sum(money(amount)).cast("double").alias("gmv"), F.count(F.lit(1)).alias("n_txn"),
    ).select(*by, F.col("w.start").cast("date").alias("week"), "gmv", "n_txn")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def weekly_partials(stream: DataFrame, partials_path: str, quarantine_path: str, checkpoint: str,
                    by: Sequence[str] = ("store_id",), ts: str = "event_time", amount: str = "amount",
                    late_days: int = 3, every: str | None = None) -> StreamingQuery:
    """Weekly sums that late rows correct: each batch adds a row per store and week it has sales of.

    A week is never closed: rows up to ``late_days`` late count whenever they arrive, later ones go to quarantine
    whole. No state is kept between batches, so a watermark can drop nothing. Partial sums and quarantine are named
    by the stream's id and the batch: a batch that is repeated after a failure replaces its own files.
    ``weekly_totals`` reads the sums.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"stream_id={_stream_id(spark, checkpoint)}/batch_id={batch_id}"
        batch.persist()
        try:
            routed = route_late(batch, late_days, ts)
            routed.filter(F.col("ruta") == "cuarentena").write.mode("overwrite").parquet(f"{quarantine_path}/{place}")
            week = F.trunc(F.col(ts).cast("date"), "week").alias("week")
            routed.filter(F.col("ruta") == "corregir").groupBy(*by, week).agg(
                F.sum(money(amount)).cast("decimal(38,4)").alias("gmv"), F.count(F.lit(1)).alias("n_txn"),
            ).write.mode("overwrite").parquet(f"{partials_path}/{place}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def weekly_totals(partials: DataFrame, by: Sequence[str] = ("store_id",)) -> DataFrame:
    """Amount and sales per Monday week, as of the last batch."""
    return partials.groupBy(*by, "week").agg(
        F.sum("gmv").cast("double").alias("gmv"), F.sum("n_txn").alias("n_txn"))


def rescue_stream(spark: SparkSession, path: str, schema: T.StructType, good_path: str, malformed_path: str,
                  checkpoint: str, fmt: str = "csv", header: bool = True, every: str | None = None,
                  files_per_trigger: int | None = None) -> StreamingQuery:
    """Text files as a stream with two sinks: rows that have the schema, and the raw text of lines that do not.

    A line with a value of another type, or cut off, is kept as it was sent with its file and arrival time, and no
    other line is touched. CSV lines need as many values as the schema has columns; both sinks may be repeated.
    """
    raw = "_raw"
    reader = spark.readStream.schema(T.StructType([*schema.fields, T.StructField(raw, T.StringType())])).format(fmt) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw)
    if fmt == "csv":
        reader = reader.option("header", header).option("enforceSchema", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.load(path).withColumn("_file", F.input_file_name()).withColumn("_ingested_at", F.current_timestamp())

    def put(batch: DataFrame, batch_id: int) -> None:
        place = f"stream_id={_stream_id(batch.sparkSession, checkpoint)}/batch_id={batch_id}"
        batch.persist()
        try:
            batch.filter(F.col(raw).isNull()).drop(raw, "_file").write.mode("overwrite").parquet(f"{good_path}/{place}")
            batch.filter(F.col(raw).isNotNull()).select(raw, "_file", "_ingested_at").write.mode("overwrite").parquet(
                f"{malformed_path}/{place}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def load_stream(stream: DataFrame, facts_path: str, quarantine_path: str, checkpoint: str,
                key: str = "transaction_item_id", by: str = "date_id", event_day: str = "transaction_date",
                late_days: int = 3, every: str | None = None) -> StreamingQuery:
    """Upsert rows on time or corrected in time into the facts, put later ones in quarantine.

    The split comes before anything stateful, so a watermark never drops a late row. Both writes are safe to
    repeat: the stream's own id, kept in its checkpoint, and the batch name the quarantine folder and the run of the
    upsert. A second stream, or one started anew on a fresh checkpoint, has another id and never meets the first
    one's files.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            routed = route_late(batch, late_days, event_day)
            late = routed.filter(F.col("ruta") == "cuarentena")
            stream_id = _stream_id(spark, checkpoint)
            late.write.mode("overwrite").parquet(f"{quarantine_path}/stream_id={stream_id}/batch_id={batch_id}")
            good = routed.filter(F.col("ruta") == "corregir").drop("dias_retraso", "ruta")
            upsert_facts(spark, facts_path, good, key, by, run_id=f"{stream_id}-{batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
