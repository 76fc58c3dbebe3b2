"""A training corpus from ``documents``: the stages in order, each stored and read again by the next.

Rows with a null doc_id or text, empty texts and repeated rows pass through the stages as the operators define it; a
stage returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.llm import decontaminate, line_dedup, packing, quality
from shelfline.llm.common import Scratch, stored, table
from shelfline.llm.ngram_join import ngram_components


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts vote for; the rest go."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeats of lines that many sources share; documents that lose all their text go."""
    out = line_dedup.remove_boilerplate(docs).where("n_removed = 0 OR trim(text) <> ''")
    sizes = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))} \
        if "n_chars" in docs.columns else {}
    return out.withColumns(sizes).select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType).alias(c)
                                           for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, once. Rows without a doc_id all stay."""
    with Scratch() as scratch:
        first = stored(ngram_components(docs).where("doc_id = component_id").select("doc_id").distinct(), "first")
        scratch.keep(first)
    one = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    out = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"))
    return out.where("NOT contaminated").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("line_dedup", without_boilerplate), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminated), ("packing", packed)]

# SQL can't express the quality stage (a learned model) and the last one (a tokenizer); tests compare the stages with
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch() as scratch:
        for name, stage in STAGES:
            before = docs
            with Scratch() as of_stage:
                docs = stored(stage(spark, docs, sf_dir), name)
                of_stage.keep(docs)
            scratch.drop(before)
        scratch.keep(docs)
    return docs
