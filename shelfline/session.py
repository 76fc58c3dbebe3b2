"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, splits hot ones in joins and picks broadcast joins from
# measured sizes; nothing in the package forces a broadcast.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# A shuffle partition should stay near this size before adaptive execution joins small ones.
PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Partitions to start a shuffle of ``input_bytes`` with: 100 TB gives some 800,000."""
    return max(1, -(-input_bytes // PARTITION_BYTES))


def build_session(app_name: str = "shelfline", master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots.

    ``input_bytes``, the size of the columns a job reads, sets how many partitions its shuffles start with;
    adaptive execution merges the ones that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if input_bytes:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which executors and driver share.

    Without that setting a session on this machine alone uses its warehouse; one on a cluster, whose warehouse may be
    a folder of each machine, raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
