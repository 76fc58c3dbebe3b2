"""Masked pseudo-likelihood: a bidirectional window network scores every token of every document from both sides.

Words are hashed into ``BUCKETS`` codes and counted over all documents. The most frequent codes are classes of their
own, the others share classes by hash. A network with one hidden layer predicts a token's class from the classes of
the tokens around it; inside a class a code has its share of the counts. A document's score is the sum of the
logarithms of these conditional probabilities over its tokens.

Training runs on all positions of all documents: the rounds' masks part them, so that each token is predicted in one
round. In a round each task trains on its masked positions from the common parameters, and its result is averaged with
the others' by a grouped sum; the next round starts from the average. What the driver collects is bounded by ``BUCKETS`` and the number of parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import encoded, mixed, steps, stored, string_hashes, table, words

BUCKETS = 1 << 18
FREQUENT, SHARED = 96, 32
CLASSES = FREQUENT + SHARED
REACH = 2                # tokens seen on either side
PLACES = [*range(-REACH, 0), *range(1, REACH + 1)]
HIDDEN = 32
MASKED = 8               # one position in so many is predicted in a round of training
ROUNDS = MASKED
RATE, BATCH = 0.1, 512


@dataclass
class Model:
    of_code: np.ndarray     # class of each code
    within: np.ndarray      # log of each code's share of its class
    inputs: np.ndarray      # [place, class or edge, hidden]
    hidden: np.ndarray
    output: np.ndarray      # [hidden, class]
    bias: np.ndarray

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.hidden, self.output, self.bias)])

    def with_parameters(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.inputs, self.hidden, self.output, self.bias):
            out.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(self.of_code, self.within, *out)


def started(counts: np.ndarray) -> Model:
    """Classes and shares from the counts of all codes; small random weights."""
    order = np.lexsort((np.arange(BUCKETS), -counts))
    of_code = FREQUENT + np.arange(BUCKETS) % SHARED
    of_code[order[:FREQUENT]] = np.arange(FREQUENT)
    total = np.bincount(of_code, counts + 1.0, minlength=CLASSES)
    rng = np.random.default_rng(0)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    share = np.bincount(of_code, counts + 1.0, minlength=CLASSES) / (counts + 1.0).sum()
    return Model(of_code.astype(np.int16), np.log((counts + 1.0) / total[of_code]).astype(np.float32),
                 small(len(PLACES), CLASSES + 1, HIDDEN), small(HIDDEN), small(HIDDEN, CLASSES),
                 np.log(share).astype(np.float32))


def surroundings(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token of texts in a row the classes around it; ``CLASSES`` beyond a text's ends."""
    n = len(lengths)
    spaced = np.full(len(classes) + REACH * (n + 1), CLASSES, np.int64)
    at = np.arange(len(classes)) + REACH * (np.repeat(np.arange(n), lengths) + 1)
    spaced[at] = classes
    return np.stack([spaced[at + p] for p in PLACES], axis=1)


def forward(m: Model, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer, and log-probabilities of all classes."""
    total = m.hidden + m.inputs[0, around[:, 0]]
    for p in range(1, len(PLACES)):
        total += m.inputs[p, around[:, p]]
    h = np.tanh(total)
    logits = h @ m.output + m.bias
    logits -= logits.max(1, keepdims=True)
    return h, logits - np.log(np.exp(logits).sum(1, keepdims=True))


def log_probabilities(m: Model, codes: np.ndarray, lengths: np.ndarray, block: int = 8192) -> np.ndarray:
    """Of each token given those around it."""
    classes = m.of_code[codes].astype(np.int64)
    around = surroundings(classes, lengths)
    out = m.within[codes].astype(np.float64)
    for at in range(0, len(codes), block):
        c = classes[at:at + block]
        out[at:at + block] += forward(m, around[at:at + block])[1][np.arange(len(c)), c]
    return out


def trained(m: Model, around: np.ndarray, target: np.ndarray, squares: list[np.ndarray]) -> None:
    """Steps of adaptive gradient descent in place."""
    for at in range(0, len(target), BATCH):
        a, t = around[at:at + BATCH], target[at:at + BATCH]
        h, logs = forward(m, a)
        d = np.exp(logs)
        d[np.arange(len(t)), t] -= 1
        d /= len(t)
        back = (d @ m.output.T) * (1 - h * h)
        into = np.zeros_like(m.inputs)
        for p in range(len(PLACES)):
            order = np.argsort(a[:, p], kind="stable")
            keys = a[order, p]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            into[p, keys[first]] = np.add.reduceat(back[order], first, axis=0)
        for x, g, s in zip((m.inputs, m.hidden, m.output, m.bias), (into, back.sum(0), h.T @ d, d.sum(0)), squares):
            s += g * g
            x -= RATE * g / (np.sqrt(s) + 1e-6)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        flat, offsets = words(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
        codes, vocabulary = encoded(flat)
        h = (string_hashes(vocabulary) % np.uint64(BUCKETS)).astype(np.int32)[codes] if vocabulary else \
            np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h))], ["doc_id", "codes"])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in steps of some hundred thousand tokens: first row, end row, codes, lengths."""
    lists = batch.column("codes")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    row = 0
    while row < len(lengths):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + 300_000, side="right")) - 1)
        yield row, stop, flat[ends[row]:ends[stop]], lengths[row:stop]
        row = stop


def masked_in(codes: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Places that are predicted in round ``number``; over ``rounds`` each place is once."""
    place = np.arange(len(codes), dtype=np.uint64)
    return np.flatnonzero(mixed(codes.astype(np.uint64) ^ (place << np.uint64(20))) % np.uint64(rounds) == number)


def _trainer(shared, number: int, rounds: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.with_parameters(shared.value.parameters())
        squares = [np.zeros_like(x) for x in (m.inputs, m.hidden, m.output, m.bias)]
        seen = 0
        for batch in batches:
            for _, _, codes, lengths in _texts(batch):
                masked = masked_in(codes, number, rounds)
                classes = m.of_code[codes].astype(np.int64)
                trained(m, surroundings(classes, lengths)[masked], classes[masked], squares)
                seen += len(masked)
        if seen:
            flat = m.parameters()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen),
                 pa.array(np.full(len(flat), seen, np.int64))], ["i", "weighed", "seen"])
    return train


def encode(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, codes array<int>"), "codes")


def fit(codes: DataFrame, rounds: int = ROUNDS) -> Model:
    """Counts over all documents, then rounds of training with averaged parameters; each token is a target in one."""
    context = codes.sparkSession.sparkContext
    counted = codes.select(F.explode("codes").alias("code")).groupBy("code").count().toPandas()
    counts = np.zeros(BUCKETS)
    counts[counted["code"].to_numpy(np.int64)] = counted["count"].to_numpy(np.float64)
    m = started(counts)
    for number in range(rounds):
        shared = context.broadcast(m)
        mean = codes.select("codes").mapInArrow(_trainer(shared, number, rounds), "i int, weighed double, seen long") \
            .groupBy("i").agg((F.sum("weighed") / F.sum("seen")).alias("v")).toPandas()
        if len(mean):
            m = m.with_parameters(mean.sort_values("i")["v"].to_numpy())
    return m


def score(codes: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over tokens), per_token (its mean; null without tokens)."""
    shared = codes.sparkSession.sparkContext.broadcast(m)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, flat, lengths in _texts(batch):
                logs = np.concatenate([[0.0], np.cumsum(log_probabilities(shared.value, flat, lengths))])
                ends = np.cumsum(lengths)
                total = logs[ends] - logs[ends - lengths]
                mean = pa.array(total / np.maximum(lengths, 1), pa.float64(), mask=lengths == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, stop - row), pa.array(lengths), pa.array(total), mean],
                    ["doc_id", "n_tokens", "log_prob", "per_token"])

    return codes.mapInArrow(scored, "doc_id long, n_tokens long, log_prob double, per_token double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per input row: doc_id, n_tokens, log_prob, per_token.

    A null or empty text has no tokens, a sum of 0 and a null mean. Null doc_ids are kept, repeated rows score alike,
    other columns are ignored, and an empty table gives an empty result.
    """
    codes = encode(docs)
    return score(codes, fit(codes, rounds))


def op10_masked_lm(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
