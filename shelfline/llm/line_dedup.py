"""Removal of boilerplate lines by the number of distinct sites they appear on.

Each different line gets a HyperLogLog sketch of its sites; sketches merge in the aggregation, so a line on a third of
all documents is one partly aggregated row per task. An estimate clearly above or below the threshold decides at once;
lines within the sketch's error of it get an exact distinct count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, stored, table

MIN_SITES = 5
LOG_BUCKETS = 10
# Relative standard errors of the sketch within which an estimate does not decide.
ERRORS = 5


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def spread(lines: DataFrame, min_sites: int = MIN_SITES, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """``lines`` (one, two: the line's hashes; site, doc_id, pos) -> one, two and first place of each line that
    appears on at least ``min_sites`` sites."""
    error = ERRORS * 1.04 / math.sqrt(2 ** log_buckets)
    sketched = lines.groupBy("one", "two").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", log_buckets)).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"))
    sketched = stored(sketched.where(F.col("sites") >= min_sites * (1 - error)), "spread")
    near = sketched.where(F.col("sites") <= min_sites * (1 + error)).select("one", "two")
    exact = lines.join(near, ["one", "two"]).groupBy("one", "two").agg(F.countDistinct("site").alias("exact")) \
        .where(F.col("exact") >= min_sites).select("one", "two")
    sure = sketched.where(F.col("sites") > min_sites * (1 + error)).select("one", "two")
    return stored(sketched.join(sure.union(exact), ["one", "two"], "left_semi").select("one", "two", "first"),
                  "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with columns ``text`` (what is kept), ``n_lines`` and ``n_removed``; one row per input row.

    Lines compare without outer spaces; blank lines are never removed. A boilerplate line stays where it is first
    (smallest doc_id, a null one before all, then smallest position), so no content is lost altogether. A null source
    is one site of its own. A null text has no lines and stays null. Repeated rows are treated alike. Other columns
    pass through unless they are named n_lines or n_removed. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    hashed = F.transform(_lines("text"), lambda x: F.when(F.trim(x) != "", F.struct(
        F.xxhash64(F.trim(x)).alias("one"), F.xxhash64(F.trim(x), F.lit("line")).alias("two"))))
    lines = docs.select(*key, F.coalesce("source", F.lit("")).alias("site"), F.posexplode(hashed)) \
        .where("col IS NOT NULL").select("doc_id", "text_hash", "site", "pos", "col.*")
    with Scratch() as scratch:
        gone = lines.join(spread(lines, min_sites), ["one", "two"]) \
            .where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first"))) \
            .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone")) \
            .withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
        gone = stored(gone, "gone")
        scratch.keep(gone)
    # Whole rows are one column here, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(
        gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id"))
        & F.xxhash64("row.text").eqNullSafe(F.col("gone_hash")), "left") \
        .withColumn("lines", F.when(F.col("gone").isNotNull(), _lines("row.text")))
    # The lines between two removed ones are one slice each: linear in the text's length.
    between = F.expr("""
        array_join(flatten(transform(sequence(0, size(gone)), i -> slice(
            lines, if(i = 0, 0, gone[i - 1] + 1) + 1,
            if(i = size(gone), size(lines), gone[i]) - if(i = 0, 0, gone[i - 1] + 1)))), '\n')""")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(between)
    return joined.select(
        *[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(_lines("row.text"))).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
    WITH lines AS (
        SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS pos
        FROM documents WHERE text IS NOT NULL),
    spread AS (
        SELECT trim(line) AS line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM lines
        WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT site) >= {MIN_SITES}),
    marked AS (
        SELECT l.*, s.first IS NOT NULL AND struct_pack(doc_id := l.doc_id, pos := l.pos) <> s.first AS gone
        FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line),
    docs AS (
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
        FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN docs USING (doc_id)"""
