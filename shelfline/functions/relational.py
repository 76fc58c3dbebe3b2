"""Relational building blocks: small functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import money, total, within


def period_total(df: DataFrame, start, end, by: Sequence[str] = ("store_id",),
                 amount: str = "total_amount", day: str = "transaction_date") -> DataFrame:
    """Completed amount per ``by`` in a closed period."""
    kept = df.filter((F.col("status") == "COMPLETED") & within(day, start, end))
    return kept.groupBy(*by).agg(total(amount).alias("gmv"), F.count(F.lit(1)).alias("n"))


def comparable_stores(stores: DataFrame, before) -> DataFrame:
    """Stores opened strictly before the given date."""
    return stores.filter(F.col("opening_date") < F.lit(str(before)).cast("date"))


def rank_within(df: DataFrame, part: str | Sequence[str], order: Column, name: str = "rank") -> DataFrame:
    """Competition rank inside a part. Input is one row per store or category, never fact rows."""
    part = [part] if isinstance(part, str) else list(part)
    return df.withColumn(name, F.rank().over(W.partitionBy(*part).orderBy(order)))


def below_percentile_flag(df: DataFrame, part: str | Sequence[str], value: str, p: float = 0.25,
                          name: str = "estado", low: str = "BAJO_RENDIMIENTO", ok: str = "OK") -> DataFrame:
    """Label rows strictly below the interpolated percentile of their part (one row per store)."""
    part = [part] if isinstance(part, str) else list(part)
    cut = F.percentile(F.col(value), F.lit(p)).over(W.partitionBy(*part))
    return df.withColumn(name, F.when(F.col(value) < cut, low).otherwise(ok))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
              last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, ties settled by the remaining columns.

    An aggregate over structs combines before the shuffle, so a key holding a third of the rows costs
    one partial row per task instead of one sorted partition.
    """
    rest = [c for c in df.columns if c not in keys]
    marks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    row = F.struct(*marks, F.struct(*rest).alias("_row"))
    pick = F.max(row) if last else F.min(row)
    chosen = df.groupBy(*keys).agg(pick.alias("_pick"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_pick._row.{c}").alias(c) for c in df.columns])


def gaps(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Idle days between consecutive active days of a key.

    Days are made distinct first, so a window partition holds at most one row per calendar day however
    many rows the key has.
    """
    days = df.select(*keys, F.col(day).cast("date").alias("_day")).distinct()
    by_day = W.partitionBy(*keys).orderBy("_day")
    return (
        days.withColumn("prev_day", F.lag("_day").over(by_day))
        .filter(F.col("prev_day").isNotNull())
        .withColumn("idle_days", F.datediff("_day", "prev_day") - 1)
        .filter(F.col("idle_days") > 0)
        .select(*keys, "prev_day", F.col("_day").alias("next_day"), "idle_days")
    )


def islands(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive days per key: start, end, length. ``(keys, day)`` must be unique."""
    seq = F.row_number().over(W.partitionBy(*keys).orderBy(day))
    return (
        df.select(*keys, day)
        .withColumn("_run", F.date_sub(F.col(day), seq))
        .groupBy(*keys, "_run")
        .agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count(F.lit(1)).alias("run_days"))
        .drop("_run")
    )


def pivot_metrics(df: DataFrame, keys: Sequence[str], on: str, values: Mapping[str, object],
                  metrics: Sequence[str]) -> DataFrame:
    """One row per key with ``metric_label`` columns; the values are listed, so no extra job runs."""
    cells = [
        F.max(F.when(F.col(on) == F.lit(v), F.col(m))).alias(f"{m}_{label}")
        for label, v in values.items() for m in metrics
    ]
    return df.groupBy(*keys).agg(*cells)


def any_flag_per_group(df: DataFrame, keys: Sequence[str], flag: str, name: str) -> DataFrame:
    """1 when any row of the group has the flag, 0 when none, null when all are null."""
    return df.groupBy(*keys).agg(F.max(F.col(flag).cast("int")).alias(name))


def dense_periods(df: DataFrame, keys: Sequence[str], period: str, values: Sequence[str],
                  step: str) -> DataFrame:
    """Fill the periods missing between the first and last of each key with zeros.

    Expects one row per (keys, period): the rows collected per key are calendar periods, not facts.
    """
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(period), F.struct(*values))))
    spread = df.groupBy(*keys).agg(
        F.min(period).alias("_lo"), F.max(period).alias("_hi"), cells.alias("_cells"))
    steps = F.sequence(F.col("_lo"), F.col("_hi"), F.expr(f"interval {step}"))
    long = spread.select(*keys, "_cells", F.explode(steps).alias(period))
    cell = F.try_element_at(F.col("_cells"), F.col(period))
    return long.select(*keys, period, *[F.coalesce(cell.getField(v), F.lit(0)).alias(v) for v in values])


def exact_quantile(df: DataFrame, value: str, p: float, by: Sequence[str] = (),
                   name: str = "quantile") -> DataFrame:
    """Interpolated quantile of a large group without gathering it in one task.

    ``df`` has ``by``, ``value`` and a count ``n`` per distinct value (see ``value_counts``). Values fall in
    ordered log-width bins; the bin totals (a few thousand rows) tell which bins hold the two wanted
    positions. Those bins are split again at approximate percentiles of their values, and only the parts that
    hold the positions, some 1/256 of a bin each, are ordered.
    """
    v = F.col(value).cast("double")
    binned = df.filter(F.col(value).isNotNull()).select(
        *by, v.alias("_v"), F.col("n").alias("_n"),
        F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64).alias("_bin"))
    upto = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (
        binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_end", F.sum("_in_bin").over(upto))
        .withColumn("_all", F.sum("_in_bin").over(W.partitionBy(*by)))
        .withColumn("_start", F.col("_end") - F.col("_in_bin"))
        .withColumn("_pos", (F.col("_all") - 1) * F.lit(float(p)))
        .filter((F.col("_start") <= F.ceil("_pos")) & (F.col("_end") > F.floor("_pos")))
    )
    inside = binned.join(bins.select(*by, "_bin", "_start", "_pos"), [*by, "_bin"])
    cuts = inside.groupBy(*by, "_bin").agg(
        F.percentile_approx("_v", [k / 256 for k in range(1, 256)], 10_000).alias("_cuts"))
    split = inside.join(cuts, [*by, "_bin"]).withColumn(
        "_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    over = W.partitionBy(*by, "_bin").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = (
        split.groupBy(*by, "_bin", "_part", "_start", "_pos").agg(F.sum("_n").alias("_in_part"))
        .withColumn("_end", F.col("_start") + F.sum("_in_part").over(over))
        .withColumn("_before", F.col("_end") - F.col("_in_part"))
        .filter((F.col("_before") <= F.ceil("_pos")) & (F.col("_end") > F.floor("_pos"))))
    in_part = W.partitionBy(*by, "_bin", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = split.join(parts.select(*by, "_bin", "_part", "_before"), [*by, "_bin", "_part"]).withColumn(
        "_upto", F.sum("_n").over(in_part) + F.col("_before"))
    low = F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v")))
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    return placed.groupBy(*by).agg((low + (high - low) * frac).alias(name))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value: the combined input of ``exact_quantile``.

    The value is returned as an aggregate, not as the grouping key: later filters then stay above the shuffle,
    every reader of the counts has the same plan below it, and the shuffle is run once and reused.
    """
    counts = df.groupBy(*by, F.col(value).alias("_key")).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("n"))
    return counts.drop("_key")


def rounded(df: DataFrame, /, **digits: int) -> DataFrame:
    """Round the named columns for a report; calculations stay unrounded."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
