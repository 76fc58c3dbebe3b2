"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: its lower-cased words, the shapes of its words (runs of capitals, small letters,
digits; other characters as they are) and coarse marks of its length and repetition. A truncated singular value
decomposition of a bounded sample of labelled rows gives each term a vector. The labelled vectors are broadcast, every
document is compared with all of them by blocked exact cosine products, and its nearest neighbours vote with their
similarity.

The sample (``sample_rows`` labelled rows of smallest hash) bounds what the driver fits and what is broadcast; every
document is scored on its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import encoded, steps, string_hashes, table, words

SAMPLE_ROWS = 4000
WORD_TERMS, SHAPE_TERMS, MARK_TERMS = 1 << 15, 1 << 12, 64
TERMS = WORD_TERMS + SHAPE_TERMS + MARK_TERMS
DIMENSIONS = 64
NEIGHBOURS = 25
# A vote weighs as this power of the cosine; shapes and marks weigh more than single words.
POWER = 8
SHAPE_WEIGHT, MARK_WEIGHT = 3.0, 6.0


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _vocabulary_terms(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word term and shape term of each word."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = pa.array(vocabulary, pa.large_string())
    lower = pc.utf8_lower(v).to_pylist()
    shape = pc.replace_substring_regex(v, r"\p{Ll}+", "a")
    shape = pc.replace_substring_regex(shape, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"\p{N}+", "9")
    shape = pc.utf8_slice_codeunits(shape, 0, 12).to_pylist()
    return ((string_hashes(lower) % np.uint64(WORD_TERMS)).astype(np.int64),
            WORD_TERMS + (string_hashes(shape) % np.uint64(SHAPE_TERMS)).astype(np.int64))


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each row's terms, ordered by row and term."""
    n = len(text)
    flat, offsets = words(text)
    codes, vocabulary = encoded(flat)
    word, shape = _vocabulary_terms(vocabulary)
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(n), counts)
    keys, times = np.unique(rows * len(word) + codes, return_counts=True) if len(codes) else (codes, codes)
    row, code = np.divmod(keys, max(len(word), 1))
    different = np.bincount(row, minlength=n)
    # Marks: words, and words per different word, both by powers of two.
    length = np.floor(np.log2(counts + 1)).astype(np.int64).clip(0, 31)
    repeats = np.floor(2 * np.log2(np.maximum(counts, 1) / np.maximum(different, 1))).astype(np.int64).clip(0, 31)
    all_rows = np.concatenate([row, row, np.arange(n), np.arange(n)])
    terms = np.concatenate([word[code], shape[code], WORD_TERMS + SHAPE_TERMS + length,
                            WORD_TERMS + SHAPE_TERMS + 32 + repeats])
    numbers = np.concatenate([times, times, np.ones(2 * n, np.int64)])
    keys, where = np.unique(all_rows * TERMS + terms, return_inverse=True)
    total = np.bincount(where, numbers, minlength=len(keys))
    return keys // TERMS, keys % TERMS, total


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    kind = np.where(terms < WORD_TERMS, 1.0, np.where(terms < WORD_TERMS + SHAPE_TERMS, SHAPE_WEIGHT, MARK_WEIGHT))
    return ((1 + np.log(counts)) * idf[terms] * kind).astype(np.float32)


def _times(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Sparse matrix, sorted by row, times a dense one, in blocks of entries."""
    out = np.zeros((n, dense.shape[1]), np.float32)
    for at in range(0, len(rows), 50_000):
        r = rows[at:at + 50_000]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(dense[columns[at:at + 50_000]] * values[at:at + 50_000, None], first, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    idf: np.ndarray
    terms: np.ndarray      # a vector per term
    vectors: np.ndarray    # labelled unit vectors
    labels: np.ndarray
    prior: float

    def project(self, text: pa.Array) -> np.ndarray:
        rows, terms, counts = bags(text)
        return _unit(_times(rows, terms, _weights(terms, counts, self.idf), self.terms, len(text)))

    def score(self, text: pa.Array, block: int = 1024) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, prior where none is similar."""
        out = np.full(len(text), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(text), block):
            cosines = self.project(text[at:at + block]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            votes = (weight * self.labels[near]).sum(1)
            out[at:at + block] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return out.clip(0, 1)


def fitted(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """Truncated decomposition by randomised subspace iteration over the sample's weighted bags."""
    n = len(labels)
    df = np.bincount(terms, minlength=TERMS)
    idf = np.log((1 + n) / (1 + df)) + 1
    prior = float(labels.mean()) if n else 0.5
    if n == 0:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    values = _weights(terms, counts, idf)
    norm = np.sqrt(np.bincount(rows, values.astype(np.float64) ** 2, minlength=n))
    values = (values / np.where(norm > 0, norm, 1)[rows]).astype(np.float32)
    order = np.lexsort((rows, terms))
    by_term = (terms[order], rows[order], values[order])
    size = min(DIMENSIONS, n)
    basis = np.random.default_rng(0).standard_normal((TERMS, size)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(_times(rows, terms, values, basis, n))
        basis, _ = np.linalg.qr(_times(*by_term, q, TERMS))
    model = Model(idf, np.ascontiguousarray(basis, np.float32), np.zeros((0, size), np.float32), labels, prior)
    model.vectors = _unit(_times(rows, terms, values, model.terms, n))
    return model


def _bagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows, terms, counts = bags(batch.column("text"))
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        parts = list(zip(ends[:-1], ends[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()),
             pa.array([terms[a:b].astype("<i4").tobytes() for a, b in parts], pa.binary()),
             pa.array([counts[a:b].astype("<f4").tobytes() for a, b in parts], pa.binary())],
            ["doc_id", "quality", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample: the ``sample_rows`` labelled rows of smallest hash that are not held out.

    Labels other than 0 and 1 and rows without a doc_id are left out; of repeated rows one is taken.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows pairs of numbers, which is what allows the broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.mapInArrow(_bagger, "doc_id long, quality int, terms binary, counts binary") \
        .dropDuplicates(["doc_id"])
    sample = sorted(one.collect(), key=lambda r: r["doc_id"])
    terms = [np.frombuffer(r["terms"], "<i4").astype(np.int64) for r in sample]
    rows = np.repeat(np.arange(len(sample)), [len(t) for t in terms])
    return fitted(rows, np.concatenate(terms) if terms else rows,
                  np.concatenate([np.frombuffer(r["counts"], "<f4") for r in sample]) if terms else rows,
                  np.array([r["quality"] for r in sample], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, score, predicted; one row per input row.

    A null or empty text has only its length marks and is scored like any other; a row with a null doc_id is not
    held out. Repeated rows score alike. Other columns are ignored; an empty table gives an empty result. Without
    labelled rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = batch.column("doc_id")
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
            values = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(values, pa.float64()),
                 pa.array((values >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column("text")) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op8_quality_neighbours(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
