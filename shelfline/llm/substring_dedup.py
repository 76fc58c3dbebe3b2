"""Substring deduplication: FM-indexes over shards of repeated text, asked by backward search.

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash among its word 5-grams. Consecutive
windows with the same minimiser form a segment, and equal windows always fall under equal minimisers. So

1. minimisers that several documents have are found by one grouped pass over (minimiser, document) pairs;
2. only segments under those are cut out; equal ones inside a task are one row with their smallest document;
3. segments are dealt by minimiser into shards of bounded number, each shard is indexed, and backward search extends
   a match from a segment's right end as long as a smaller document has it, which answers all its windows; segments
   of a minimiser with more than ``MARK_SEGMENTS`` are dealt window by window instead, by the window's words;
4. the answers go back to the places of the segments, and every document's text is read once more to drop its words.

A document whose minimisers are all its own never enters steps 2 to 4 with its text's segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import encoded, mixed, steps, stored, string_hashes, table, window_hashes, words
from .fm_index import FmIndex

WINDOW = 13
GRAM = 5
SHARD_SEGMENTS = 60_000
# Segments of one minimiser up to which they stay together in a shard.
MARK_SEGMENTS = 10_000


def _minimisers(text: pa.Array, window: int):
    """Words and offsets of each text, and for its windows: row, start, place and hash of the minimiser."""
    flat, offsets = words(text)
    codes, vocabulary = encoded(flat)
    h = string_hashes(vocabulary)[codes] if vocabulary else np.zeros(0, np.uint64)
    gram = min(GRAM, window)
    grams = window_hashes(h, gram)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    best, place = grams[starts], starts.copy()
    for k in range(1, window - gram + 1):
        other = grams[starts + k]
        less = other < best
        best[less], place[less] = other[less], starts[less] + k
    return flat, h, offsets, rows, starts, place, best.view(np.int64)


def _fingerprints(window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            _, _, _, rows, _, _, best = _minimisers(batch.column("text"), window)
            first = np.r_[True, (rows[1:] != rows[:-1]) | (best[1:] != best[:-1])] if len(rows) else rows.astype(bool)
            rows, best = rows[first], best[first]
            order = np.lexsort((best, rows))
            rows, best = rows[order], best[order]
            keep = np.r_[True, (rows[1:] != rows[:-1]) | (best[1:] != best[:-1])] if len(rows) else first
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(best[keep]), ids.take(pa.array(rows[keep]))], ["mark", "doc"])
    return find


SEGMENT = "mark long, segment long, doc long, text_hash long, start long, windows int, text string"


def _joined(flat: pa.Array, low: np.ndarray, high: np.ndarray) -> list[str]:
    """The words from ``low`` to ``high`` of each range, joined by one space."""
    ends = np.concatenate([[0], np.cumsum(high - low)])
    places = np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)
    lists = pa.LargeListArray.from_arrays(pa.array(ends), flat.take(pa.array(places)))
    return pc.binary_join(lists, pa.scalar(" ", flat.type)).to_pylist()


def _segments(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of shared segments (without text), then each different segment once with its smallest document."""
        texts: dict[tuple[int, int], str] = {}
        smallest: dict[tuple[int, int], int] = {}
        for batch in steps(batches):
            flat, h, offsets, rows, starts, place, best = _minimisers(batch.column("text"), window)
            if not len(rows):
                continue
            lists = batch.column("marks")
            marks = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            asks = np.asarray(batch.column("asks").flatten())
            begin = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])])
            end = np.r_[begin[1:], len(rows)] - 1
            row, mark = rows[begin], best[begin]
            low, high = starts[begin], starts[end] + window
            known = pd.Series(asks, index=pd.MultiIndex.from_arrays([owner, marks])).reindex(
                pd.MultiIndex.from_arrays([row, mark]))
            shared = np.flatnonzero(known.notna().to_numpy())
            asks = known.to_numpy()[shared].astype(bool)
            row, mark, low, high = row[shared], mark[shared], low[shared], high[shared]
            # A hash of the segment's words.
            name = (high - low).astype(np.uint64)
            for k in range(int((high - low).max(initial=0))):
                inside = low + k < high
                name[inside] = mixed(name[inside] * np.uint64(0x9E3779B97F4A7C15) + h[low[inside] + k], 2)
            name = name.view(np.int64)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)[row]
            # Each different segment once, with its smallest document.
            order = np.lexsort((docs, name, mark))
            new = np.flatnonzero(np.r_[True, (mark[order][1:] != mark[order][:-1]) | (name[order][1:] != name[order][:-1])]) \
                if len(order) else order
            one = order[new]
            for key, d in zip(zip(mark[one].tolist(), name[one].tolist()), docs[one].tolist()):
                smallest[key] = min(smallest.get(key, d), d)
            one = np.array([i for i, key in zip(one.tolist(), zip(mark[one].tolist(), name[one].tolist()))
                            if key not in texts], np.int64)
            texts.update(zip(zip(mark[one].tolist(), name[one].tolist()), _joined(flat, low[one], high[one])))
            n = int(asks.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark[asks]), pa.array(name[asks]), pa.array(docs[asks]), pa.array(hashes[asks]),
                 pa.array((low - offsets[row])[asks]), pa.array((high - low - window + 1)[asks].astype(np.int32)),
                 pa.nulls(n, pa.string())], ["mark", "segment", "doc", "text_hash", "start", "windows", "text"])
        items = list(texts.items())
        for at in range(0, len(items), 20_000):
            part = items[at:at + 20_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()),
                 pa.array([smallest[k] for k, _ in part], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.array([v for _, v in part], pa.string())],
                ["mark", "segment", "doc", "text_hash", "start", "windows", "text"])
    return cut


def matched(texts: list[str], docs: np.ndarray, window: int) -> np.ndarray:
    """For each segment a bit per window: whether a segment of a smaller document has that window."""
    flat, offsets = words(pa.array(texts, pa.large_string()))
    codes, vocabulary = encoded(flat)
    h = string_hashes(vocabulary)
    ids = np.unique(h, return_inverse=True)[1] + 1
    lengths = np.diff(offsets)
    n = len(texts)
    # Segments in a row, each followed by a 0.
    begin = offsets[:-1] + np.arange(n)
    symbols = np.zeros(len(codes) + n, np.int64)
    symbols[np.arange(len(codes)) + np.repeat(np.arange(n), lengths)] = ids[codes]
    owner = np.repeat(np.arange(n), lengths + 1)
    index = FmIndex(symbols, int(lengths.max(initial=0)) + 1)
    at_order = docs[owner[index.order]]

    hits = np.zeros(n, np.int64)
    segment, right = np.arange(n), lengths.copy()
    while len(segment):
        low, high = np.zeros(len(segment), np.int64), np.full(len(segment), index.size)
        position = right.copy()
        active = np.arange(len(segment))
        reached = right - window + 1          # leftmost window answered so far, one past it
        while len(active):
            position[active] -= 1
            s = segment[active]
            low[active], high[active] = index.left(symbols[begin[s] + position[active]], low[active], high[active])
            # Alone in its interval, a segment can match nothing any more.
            active = active[high[active] - low[active] > 1]
            deep = active[right[active] - position[active] >= window]
            if len(deep):
                bounds = np.column_stack([low[deep], high[deep]]).ravel()
                padded = np.append(at_order, np.iinfo(np.int64).max)
                smallest = np.minimum.reduceat(padded, bounds)[::2]
                good = smallest < docs[segment[deep]]
                yes = deep[good]
                hits[segment[yes]] |= np.int64(1) << position[yes]
                reached[yes] = position[yes]
                active = np.setdiff1d(active, deep[~good], assume_unique=True)
            active = active[position[active] > 0]
        # What is left of the last answered window is searched from its own right end.
        right = np.where(reached <= right - window, reached - 1, right - window - 1) + window
        more = right >= window
        segment, right = segment[more], right[more]
    return hits


def _searcher(window: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.sort_values(["mark", "segment", "doc"]).drop_duplicates(["mark", "segment"], ignore_index=True)
        return pd.DataFrame({"mark": one["mark"], "segment": one["segment"], "least": one["doc"],
                             "hits": matched(one["text"].tolist(), one["doc"].to_numpy(np.int64), window)})
    return search


def _by_window(texts: DataFrame, window: int) -> DataFrame:
    """The answers of ``_searcher`` for segments (mark, segment, doc, text), each window a key of its own."""
    split = texts.groupBy("mark", "segment").agg(F.min("doc").alias("doc"), F.min("text").alias("text")) \
        .select("mark", "segment", "doc", F.split("text", " ").alias("w"))
    one = F.expr(f"transform(sequence(0, size(w) - {window}), k -> array_join(slice(w, k + 1, {window}), ' '))")
    each = stored(split.select("mark", "segment", "doc", F.posexplode(one).alias("k", "words")), "windows")
    first = each.groupBy("words").agg(F.min("doc").alias("first"))
    bit = F.when(F.col("first") < F.col("doc"), F.expr("shiftleft(1L, k)")).otherwise(0)
    return each.join(first, "words").groupBy("mark", "segment").agg(F.min("doc").alias("least"),
                                                                    F.bit_or(bit).alias("hits"))


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            flat, offsets = words(batch.column("text"))
            lists = batch.column("found")
            found = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy(
                zero_copy_only=False))
            start = offsets[owner] + found.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            hits = found.field("hits").to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(len(flat) + 1, np.int64)
            for k in range(int(hits.max(initial=0)).bit_length()):
                at = start[hits >> k & 1 == 1] + k
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = pa.LargeListArray.from_arrays(pa.array(ends), flat.filter(pa.array(keep)))
            text = pc.binary_join(kept, pa.scalar(" ", flat.type)).cast(pa.string())
            words_in = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(words_in), pa.array(words_in - np.diff(ends)), text],
                ["doc_id", "n_words", "n_removed", "kept"])
    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS,
                   mark_segments: int = MARK_SEGMENTS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space).

    One row per input row. A null or empty text has no words. Rows with a null doc_id lose nothing and take nothing
    from others; rows that repeat a doc_id take nothing from each other. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    named = rows.where("doc_id IS NOT NULL")
    by_mark = Window.partitionBy("mark")
    marks = named.select("doc_id", "text").mapInArrow(_fingerprints(window), "mark long, doc long") \
        .withColumn("low", F.min("doc").over(by_mark)).withColumn("high", F.max("doc").over(by_mark)) \
        .where("low <> high")
    shared = stored(marks.groupBy("doc").agg(F.collect_set(F.struct("mark", (F.col("low") < F.col("doc")).alias("ask")))
                                             .alias("m")).select("doc", F.col("m.mark").alias("marks"),
                                                                 F.col("m.ask").alias("asks")), "shared")
    cut = stored(named.join(shared.withColumnRenamed("doc", "doc_id"), "doc_id")
                 .select("doc_id", "text", "text_hash", "marks", "asks").mapInArrow(_segments(window), SEGMENT),
                 "segments")
    texts = cut.where("text IS NOT NULL").select("mark", "segment", "doc", "text")
    crowded = stored(texts.groupBy("mark").count().where(F.col("count") > mark_segments).select("mark"), "crowded")
    some = crowded.count() > 0
    few = texts.join(crowded, "mark", "left_anti") if some else texts
    shards = max(1, -(-texts.count() // shard_segments))
    answers = stored(few.groupBy(F.pmod(F.xxhash64("mark"), F.lit(shards)).alias("shard"))
                     .applyInPandas(_searcher(window), "mark long, segment long, least long, hits long"), "answers")
    if some:
        answers = answers.union(stored(_by_window(texts.join(crowded, "mark", "left_semi"), window), "answers"))
    every = F.expr("shiftleft(1L, windows) - 1")
    found = cut.where("text IS NULL").drop("text").join(answers, ["mark", "segment"]).select(
        "doc", "text_hash", "start", "windows",
        F.when(F.col("doc") > F.col("least"), every).otherwise(F.col("hits")).alias("hits")).where("hits <> 0")
    found = stored(found.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "windows", "hits"))
                                                         .alias("found")), "found")
    joined = rows.join(found.withColumnsRenamed({"doc": "doc_id"}), ["doc_id", "text_hash"], "left") \
        .select("doc_id", "text", "found")
    return joined.mapInArrow(_remover(window), "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
