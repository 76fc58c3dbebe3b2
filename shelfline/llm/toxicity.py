"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word's input is a vector of its own (by hash) beside the mean of the vectors of its character sequences, the word's
start and end being characters too, so that words never seen are known by their parts. A text is cut into windows of
``WIDTH`` words that overlap by half; two recurrent passes, one from either side, read each window, an attention
weighs their states, and the pooled state gives the window's log-odds. A text is as toxic as its worst window.

Only texts are labelled, not windows. Training, in numpy on a bounded sample of labelled rows, therefore repeats two
steps: the network scores all windows of the sample, and learns from the worst windows of each text. Every document is
scored on all its windows, each different word of a batch being prepared once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .byte_words import byte_words, kinds
from .common import mixed, steps, string_hashes, table

SAMPLE_ROWS = 4000      # labelled rows that the network learns from, up to half of them toxic
WIDTH, STRIDE = 32, 16
HIDDEN = 8
WORD_ROWS, CHARACTER_ROWS, SIZE = 1 << 17, 1 << 16, 8
SEQUENCES = (3, 5)      # characters
EPOCHS, BATCH, RATE = 6, 128, 0.2
STEPS = 60              # in an epoch at least
WORST = 3               # windows of a clean text that are learned in an epoch; one of a toxic text
THRESHOLD = 0.3
TOXIC_WEIGHT = 2        # of a toxic text; a clean one weighs 1
BLOCK = 4096

_KIND = kinds(bytes(i for i in range(128) if not chr(i).isalnum()))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Vocabulary:
    """The different words of a batch: row of each word's vector, and rows of its character sequences' vectors."""

    def __init__(self, words: pa.Array) -> None:
        listed = words.to_pylist()
        self.words = (string_hashes(listed) % np.uint64(WORD_ROWS)).astype(np.int64)
        raw = [b"\x02" + w.encode() + b"\x03" for w in listed]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), lengths)
        rows, owners = [], []
        for n in SEQUENCES:
            here = max(len(flat) - n + 1, 0)
            h = np.full(here, n, np.uint64)
            for k in range(n):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + flat[k:here + k], 3)
            # A word shorter than a sequence has none of that length.
            whole = owner[:here] == owner[n - 1:n - 1 + here]
            rows.append((h[whole] % np.uint64(CHARACTER_ROWS)).astype(np.int64))
            owners.append(owner[:here][whole])
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.rows, self.owners = np.concatenate(rows)[order], np.concatenate(owners)[order]
        self.counts = np.bincount(self.owners, minlength=len(listed))

    def part(self, some: np.ndarray) -> Vocabulary:
        """Some of the words."""
        out = Vocabulary.__new__(Vocabulary)
        out.words, out.counts = self.words[some], self.counts[some]
        start = (np.cumsum(self.counts) - self.counts)[some]
        before = np.cumsum(out.counts) - out.counts
        out.rows = self.rows[np.arange(out.counts.sum()) + np.repeat(start - before, out.counts)]
        out.owners = np.repeat(np.arange(len(some)), out.counts)
        return out

    def mean(self, vectors: np.ndarray) -> np.ndarray:
        """The mean of the vectors of each word's sequences; a word of marks has at least one."""
        out = np.zeros((len(self.counts), vectors.shape[1]), vectors.dtype)
        full = np.flatnonzero(self.counts)
        if len(full):
            first = (np.cumsum(self.counts) - self.counts)[full]
            for a in range(0, len(full), 20_000):
                some = full[a:a + 20_000]
                stop = first[a + 20_000] if a + 20_000 < len(full) else len(self.rows)
                out[some] = np.add.reduceat(vectors[self.rows[first[a]:stop]], first[a:a + 20_000] - first[a], axis=0)
        return out / np.maximum(self.counts, 1)[:, None].astype(vectors.dtype)


def text_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's code, the words in each text, and the different words; one empty word where there are none."""
    words, row, _ = byte_words(text, _KIND)
    coded = words.dictionary_encode()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(row, minlength=len(text)),
            coded.dictionary if len(coded.dictionary) else pa.array([""], pa.large_string()))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window of texts in a row; a text without words has one empty window."""
    number = np.maximum(-(-(lengths - WIDTH) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(lengths)), number)
    inside = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
    first = np.repeat(np.cumsum(lengths) - lengths, number) + inside
    return text, first, np.minimum(lengths[text] - inside, WIDTH)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; words and characters are the vectors' tables."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.h = hidden
        self.p = {"words": draw(WORD_ROWS, SIZE) * np.float32(0.1),
                  "characters": draw(CHARACTER_ROWS, SIZE) * np.float32(0.1),
                  "in_f": draw(2 * SIZE, 3 * hidden), "bias_f": np.zeros(3 * hidden, np.float32),
                  "in_b": draw(2 * SIZE, 3 * hidden), "bias_b": np.zeros(3 * hidden, np.float32),
                  "again_f": draw(hidden, 3 * hidden), "again_b": draw(hidden, 3 * hidden),
                  "attention": draw(2 * hidden), "out": draw(2 * hidden), "bias": np.zeros(1, np.float32)}

    def inputs(self, v: Vocabulary) -> np.ndarray:
        return np.concatenate([self.p["words"][v.words], v.mean(self.p["characters"])], axis=1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates of either pass."""
        return x @ self.p["in_f"] + self.p["bias_f"], x @ self.p["in_b"] + self.p["bias_b"]

    def passed(self, gate: np.ndarray, mask: np.ndarray, again: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States of a recurrent pass over [time, window, gate]; outside the mask the state is zero."""
        n, out = self.h, np.empty((*gate.shape[:2], self.h), gate.dtype)
        state = np.zeros(out.shape[1:], gate.dtype)
        for t in range(len(gate)):
            both = sigmoid(gate[t, :, :2 * n] + state @ again[:, :2 * n])
            z, r = both[:, :n], both[:, n:]
            c = np.tanh(gate[t, :, 2 * n:] + (r * state) @ again[:, 2 * n:])
            if kept is not None:
                kept.append((state, z, r, c))
            state = (z * state + (1 - z) * c) * mask[t]
            out[t] = state
        return out

    def back(self, d_out: np.ndarray, mask: np.ndarray, again: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of a pass: those of the gates and of the recurrent weights."""
        n = self.h
        d_gate, d_again = np.empty((*d_out.shape[:2], 3 * n), d_out.dtype), np.zeros_like(again)
        d_state = np.zeros(d_out.shape[1:], d_out.dtype)
        for t in reversed(range(len(d_out))):
            state, z, r, c = kept[t]
            d = (d_out[t] + d_state) * mask[t]
            d_c = d * (1 - z) * (1 - c * c)
            d_reset = d_c @ again[:, 2 * n:].T
            d_both = np.concatenate([d * (state - c) * z * (1 - z), d_reset * state * r * (1 - r)], axis=1)
            d_again[:, 2 * n:] += (r * state).T @ d_c
            d_again[:, :2 * n] += state.T @ d_both
            d_state = d * z + d_reset * r + d_both @ again[:, :2 * n].T
            d_gate[t] = np.concatenate([d_both, d_c], axis=1)
        return d_gate, d_again

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights [time, window] and pooled states; an empty window's are zero."""
        raw = np.where(mask[..., 0] > 0, states @ self.p["attention"], -np.inf)
        top = raw.max(axis=0)
        e = np.exp(raw - np.where(np.isfinite(top), top, 0))
        weights = e / np.maximum(e.sum(axis=0), 1e-30)
        return weights, np.einsum("tb,tbh->bh", weights, states)

    def log_odds(self, codes: np.ndarray, gates: tuple[np.ndarray, np.ndarray], first: np.ndarray,
                 lengths: np.ndarray) -> np.ndarray:
        """Of windows given by first word and length."""
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), BLOCK):
            words, mask = laid_out(codes, first[a:a + BLOCK], lengths[a:a + BLOCK])
            forth = self.passed(gates[0][words], mask, self.p["again_f"])
            back = self.passed(gates[1][words[::-1]], mask[::-1], self.p["again_b"])[::-1]
            pooled = self.pooled(np.concatenate([forth, back], axis=2), mask)[1]
            out[a:a + BLOCK] = pooled @ self.p["out"] + self.p["bias"][0]
        return out

    def gradients(self, words: np.ndarray, mask: np.ndarray, v: Vocabulary, labels: np.ndarray,
                  weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log-loss of windows [time, window], words being codes of ``v``, and its gradients.

        Those of the two tables are gradients of rows, in the order of ``v.words`` and ``v.rows``.
        """
        p = self.p
        x = self.inputs(v)
        gate_f, gate_b = self.gates(x)
        kept_f, kept_b = [], []
        forth = self.passed(gate_f[words], mask, p["again_f"], kept_f)
        back = self.passed(gate_b[words[::-1]], mask[::-1], p["again_b"], kept_b)[::-1]
        states = np.concatenate([forth, back], axis=2)
        attention, pooled = self.pooled(states, mask)
        odds = pooled @ p["out"] + p["bias"][0]
        chance = sigmoid(odds)
        loss = float((weights * np.where(labels == 1, np.logaddexp(0, -odds), np.logaddexp(0, odds))).sum())
        d_odds = (weights * (chance - labels)).astype(odds.dtype)
        g = {"out": pooled.T @ d_odds, "bias": d_odds.sum(keepdims=True)}
        d_pooled = d_odds[:, None] * p["out"]
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_raw = attention * (d_weight - (attention * d_weight).sum(axis=0))
        g["attention"] = np.einsum("tb,tbh->h", d_raw, states)
        d_states = attention[..., None] * d_pooled + d_raw[..., None] * p["attention"]
        d_f, g["again_f"] = self.back(d_states[..., :self.h], mask, p["again_f"], kept_f)
        d_b, g["again_b"] = self.back(d_states[::-1][..., self.h:], mask[::-1], p["again_b"], kept_b)
        d_x = np.zeros_like(x)
        for name, d, order in (("f", d_f, words), ("b", d_b, words[::-1])):
            d_word = np.zeros((len(x), d.shape[2]), d.dtype)
            np.add.at(d_word, order.ravel(), d.reshape(-1, d.shape[2]))
            g[f"in_{name}"], g[f"bias_{name}"] = x.T @ d_word, d_word.sum(axis=0)
            d_x += d_word @ p[f"in_{name}"].T
        g["words"] = d_x[:, :SIZE]
        g["characters"] = (d_x[:, SIZE:] / np.maximum(v.counts, 1)[:, None].astype(x.dtype))[v.owners]
        return loss, g


def laid_out(codes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words [time, window] and a mask [time, window, 1] of those that there are."""
    time = np.arange(max(int(lengths.max(initial=1)), 1))[:, None]
    mask = time < lengths
    words = np.zeros(mask.shape, np.int64)
    words[mask] = codes[(first + time)[mask]]
    return words, mask[..., None].astype(np.float32)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    different, first = np.unique(rows[order], return_index=True)
    return different, np.add.reduceat(values[order], first, axis=0)


def _lean(v: Vocabulary, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray,
          texts: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """How much more often the words of each row of either table stand in toxic texts: log-odds from -1 to 1.

    Some ``texts`` at a time are counted, a row once in each.
    """
    tables = WORD_ROWS, CHARACTER_ROWS
    n = [np.full((2, size), 2.0) for size in tables]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    per_word = np.cumsum(v.counts) - v.counts
    for a in range(0, len(labels), texts):
        size = lengths[a:a + texts]
        owner = np.repeat(np.arange(len(size)), size)
        pair = np.unique(owner * len(v.counts) + codes[ends[a]:ends[a] + size.sum()])
        owner, word = pair // len(v.counts), pair % len(v.counts)
        many = v.counts[word]
        rows = v.rows[np.arange(many.sum()) + np.repeat(per_word[word] - (np.cumsum(many) - many), many)]
        for k, (o, r) in enumerate(((owner, v.words[word]), (np.repeat(owner, many), rows))):
            once = np.unique(o * tables[k] + r)
            toxic = labels[a:a + texts][once // tables[k]]
            for y in (0, 1):
                n[k][y] += np.bincount(once[toxic == y] % tables[k], minlength=tables[k])
    total = np.bincount(labels, minlength=2) + 4.0
    return tuple((np.log(x[1] / total[1] * total[0] / x[0]) / 4).clip(-1, 1).astype(np.float32) for x in n)


def trained(text: pa.Array, labels: np.ndarray, rows: tuple[int, int] = (1, 1), epochs: int = EPOCHS) -> Network:
    """A network fitted to labelled texts; ``rows`` says in what proportion clean and toxic texts weigh."""
    net = Network()
    p = net.p
    codes, lengths, different = text_words(text)
    if not len(codes):
        net.p["out"][:] = 0
        return net
    v = Vocabulary(different)
    weight = (np.asarray(rows) / np.maximum(np.bincount(labels, minlength=2), 1)).astype(np.float32)
    weight *= len(labels) / weight[labels].sum()
    # The first number of each vector starts from how its words lean, which tells the first worst windows.
    p["words"][:, 0], p["characters"][:, 0] = _lean(v, codes, lengths, labels)
    squares = {k: np.full_like(x, 1e-3) for k, x in p.items()}
    of, first, size = windows(lengths)
    lean = (p["words"][v.words, 0] + v.mean(p["characters"][:, :1])[:, 0])[codes]
    starts = np.minimum(first, max(len(lean) - 1, 0))
    odds = np.maximum.reduceat(lean, starts)
    rng = np.random.default_rng(1)
    for epoch in range(epochs):
        if epoch:
            odds = net.log_odds(codes, net.gates(net.inputs(v)), first, size)
        # The worst window of a toxic text, the worst few of a clean one.
        order = np.lexsort((-odds, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        chosen = order[place < np.where(labels[of[order]] == 1, 1, WORST)]
        # A small sample is passed through several times between choices.
        passes = max(1, STEPS * BATCH // len(chosen))
        chosen = np.concatenate([chosen[rng.permutation(len(chosen))] for _ in range(passes)])
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(chosen), BATCH):
            some = chosen[a:a + BATCH]
            words, mask = laid_out(codes, first[some], size[some])
            used, words = np.unique(words, return_inverse=True)
            part = v.part(used)
            y = labels[of[some]]
            _, g = net.gradients(words.reshape(mask.shape[:2]), mask, part, y.astype(np.float32), weight[y] / len(y))
            for name, d in g.items():
                if name in ("words", "characters"):
                    rows, d = _row_sums(part.words if name == "words" else part.rows, d)
                    squares[name][rows] += d * d
                    p[name][rows] -= rate * d / np.sqrt(squares[name][rows])
                else:
                    squares[name] += d * d
                    p[name] -= rate * d / np.sqrt(squares[name])
    return net


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """The network of a bounded sample: the labelled rows of smallest hash that are not held out.

    Up to half of the ``sample_rows`` are toxic ones; a label with fewer leaves its places to the other. Labels other
    than 0 and 1 and rows without a doc_id are left out; of rows with one doc_id the smallest label and text count.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")) \
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    ranked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              .collect() for k in (1, 0)]
    half = sample_rows // 2
    toxic = ranked[0][:max(half, sample_rows - len(ranked[1]))]
    chosen = docs.sparkSession.createDataFrame(
        [(r["doc_id"], int(r["toxic"])) for r in [*toxic, *ranked[1][:sample_rows - len(toxic)]]],
        "doc_id long, toxic int")
    # At most sample_rows pairs of numbers, which is what allows the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic") \
        .agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return trained(pa.array([r["text"] for r in rows], pa.large_string()),
                   np.array([r["toxic"] for r in rows], np.int64), (count.get(0, 0), TOXIC_WEIGHT * count.get(1, 0)))


def text_scores(net: Network, text: pa.Array) -> np.ndarray:
    """The chance of each text's worst window."""
    codes, lengths, different = text_words(text)
    of, first, size = windows(lengths)
    gates = net.gates(net.inputs(Vocabulary(different)))
    odds = net.log_odds(codes, gates, first, size)
    starts = np.searchsorted(of, np.arange(len(lengths)))
    return sigmoid(np.maximum.reduceat(odds.astype(np.float64), starts)) if len(starts) else np.zeros(0)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, held_out, score, predicted; one row per input row.

    A null or empty text, or one without words, is one empty window. A row with a null doc_id is scored like any other
    and is not held out. Repeated rows score alike, other columns are ignored, and an empty table gives an empty
    result. Without labelled rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = batch.column("doc_id")
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
            values = text_scores(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(values, pa.float64()),
                 pa.array((values >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
