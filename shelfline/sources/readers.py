"""Reading the canonical tables and naming them for SQL."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import OPTIONAL, TABLES


def load_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """One table by a given schema; a CSV header must name the same columns in the same order."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def header_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The part of ``schema`` a CSV header names, in the header's order; reads the first line only."""
    names = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema.fields}
    return T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])


def load_tables(spark: SparkSession, directory: str, fmt: str = "csv",
                extension: str | None = None) -> dict[str, DataFrame]:
    """The six tables. A missing column raises, with all missing names, unless it is one of ``OPTIONAL``, which
    comes back as nulls of its type."""
    loaded, missing = {}, []
    for name, schema in TABLES.items():
        path = f"{directory}/{name}.{extension or fmt}"
        columns = (spark.read.option("header", True) if fmt == "csv" else spark.read).format(fmt).load(path).columns
        found = header_schema(spark, path, schema) if fmt == "csv" else schema
        df = load_table(spark, path, found, fmt)
        missing += [f"{name}.{f.name}" for f in schema.fields
                    if f.name not in columns and f.name not in OPTIONAL.get(name, ())]
        loaded[name] = df.select(*[
            (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields])
    if missing:
        raise ValueError(f"columns missing in {directory}: {', '.join(missing)}")
    return loaded


def malformed_values(spark: SparkSession, directory: str, extension: str = "csv") -> DataFrame:
    """Per table and column of CSV files: values that are there but do not have the column's type."""
    parts = []
    for name, schema in TABLES.items():
        text = spark.read.option("header", True).csv(f"{directory}/{name}.{extension}")
        known = [f for f in schema.fields if f.name in text.columns]
        bad = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
               for f in known]
        cells = [F.struct(F.lit(name).alias("tabla"), F.lit(f.name).alias("columna"), F.col(f.name).alias("n"))
                 for f in known]
        parts.append(text.agg(*bad).select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table, as one union."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("filas")).select(
            F.lit(name).alias("tabla"), "filas", F.lit(len(df.columns)).alias("columnas"))
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
