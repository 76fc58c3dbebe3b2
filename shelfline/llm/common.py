"""Helpers that several operators share: tables, stored intermediates, word splitting, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..sources.writers import remove_path

# Text bytes that one step inside a task works on; a longer text is a step of its own.
STEP_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The tables that an operator stores while it works; those it does not keep are deleted when it is left.

    ``stored`` enters its tables in the innermost open scope. Lineage ends at a stored table, so one whose successors
    are stored is needed by no later stage, not even after an executor is lost. Kept tables belong to the scope
    around, if there is one, and else stay as long as the results that read them may be used.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        self.outer = _scope.get()
        self.token = _scope.set(self)
        return self

    def __exit__(self, *failure) -> None:
        _scope.reset(self.token)
        self._delete(self.tables)

    def _delete(self, tables: list[tuple[DataFrame, str]]) -> None:
        for df, path in tables:
            remove_path(df.sparkSession, path)
        self.tables = [t for t in self.tables if t not in tables]

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the tables of ``frames`` now."""
        self._delete([t for t in self.tables if any(t[0] is f for f in frames)])

    def keep(self, *frames: DataFrame | None) -> None:
        kept = [t for t in self.tables if any(t[0] is f for f in frames)]
        self.tables = [t for t in self.tables if t not in kept]
        if self.outer:
            self.outer.tables += kept


_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
# With it Spark deletes the shuffle files of an execution when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends there, and its size is known.

    The shuffle files of the write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if scope := _scope.get():
        scope.tables.append((out, path))
    return out


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``STEP_BYTES`` of text, without empty ones."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words split at ASCII white space, and the offsets of each row's words; a null text has none."""
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.greater(pc.binary_length(flat), 0)
    rows = np.repeat(np.arange(len(text)), lengths)[keep.to_numpy(zero_copy_only=False)]
    offsets = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(text)), out=offsets[1:])
    return flat.filter(keep), offsets


def encoded(flat: pa.Array) -> tuple[np.ndarray, list]:
    """Codes into the list of different words."""
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def string_hashes(values: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if not values:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit permutation of x; each seed gives another one."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    n = len(word_hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k:n + k], 1)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): one row per node, ``node`` and its smallest reachable ``comp``.

    Alternates large-star and small-star steps until the edges stay the same. Every step is a grouped minimum
    joined back to the edges, so that a hub with very many edges is one partly aggregated row on one side and a
    join partition that adaptive execution can split on the other. Steps are stored in the shared folder.
    """
    with Scratch() as scratch:
        e = stored(edges.where("a <> b AND a IS NOT NULL AND b IS NOT NULL").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = None
        while True:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = stored(both.groupBy("a").agg(F.min("b").alias("low"))
                         .select("a", F.least("a", "low").alias("low")), "low")
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            large = stored(large.where("a <> b").distinct(), "large")
            scratch.drop(e, low)
            low = stored(large.groupBy("a").agg(F.min("b").alias("low")), "low")
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
            e = stored(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
            scratch.drop(large, low)
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        scratch.keep(e)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
