"""Collocations: phrases counted in burstable tries, level by level, and scored by their weakest cut.

Each task counts phrases in a HAT-trie: a shallow trie over word ids whose leaves are hash containers, each for a
range of ids. A container that grows beyond ``BURST`` phrases is split at its middle id; one that holds a single id
bursts into a node for the next word. When a task's tries hold more than ``SPILL`` phrases, their largest subtrees are
written out whole as sorted runs and emptied, so memory is bounded at any input size. The runs of all tasks meet in
prefix partitions, where Spark adds up their counts: by language, first word and, so that a frequent first word is
no task's work alone, one of ``SPREAD`` parts of what follows it.

Words are counted first, then pairs of words, then triples. A phrase can reach the least count only if its parts do,
so a task leaves out phrases with a part that did not. It knows those parts by a bit array of at most
``FILTER_BITS`` bits, which may let further phrases pass but never loses one; the counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .byte_words import byte_words, kinds
from .common import mixed, steps, stored, string_hashes, table

LEAST = 10              # occurrences of a candidate
LONGEST = 3             # words of a candidate
FIRST = 2000            # phrases per language
ID_BITS = 21            # a phrase's word ids share one 64-bit integer
SLICE = 1 << 20         # tokens that are counted at once
BURST = 1 << 16
SPILL = 3 << 20
SPREAD = 64
FILTER_BITS = 1 << 26

# The kinds of bytes in a text. Bytes of letters outside ASCII belong to words.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = kinds(GAPS, BREAKS)


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lowered, and a number for each that differs between pieces."""
    words, row, breaks = byte_words(text, _KIND)
    return words, row + breaks


class Container:
    """Counts by packed phrase, in an open-addressing table."""

    def __init__(self, size: int = 1 << 10) -> None:
        self.keys, self.counts, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts of different phrases."""
        size = len(self.keys)
        while size < 2 * (self.used + len(keys)):
            size *= 2
        if size > len(self.keys):
            old = self.entries()
            self.__init__(size)
            self.add(*old)
        at = (mixed(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # where several want one place, the last has it
            placed = self.keys[at] == keys
            self.counts[at[placed]] += counts[placed]
            self.used += int((free & placed).sum())
            at, keys, counts = (at[~placed] + 1) & (size - 1), keys[~placed], counts[~placed]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases in order, and their counts."""
        full = np.flatnonzero(self.keys >= 0)
        full = full[np.argsort(self.keys[full])]
        return self.keys[full], self.counts[full]


class Node:
    """The ids of one word of a phrase in ranges; each range has a container, or a node for the next word."""

    def __init__(self, level: int, burst: int, left: int, child: Container | None = None) -> None:
        self.left = left                    # words after the one that this node tells apart
        self.level, self.burst = level, burst
        self.starts, self.children = np.zeros(1, np.int64), [child or Container()]

    @property
    def used(self) -> int:
        return sum(c.used for c in self.children)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts of different phrases in order."""
        cuts = [0, *np.searchsorted(keys, self.starts[1:]), len(keys)]
        for child, a, b in zip(self.children, cuts[:-1], cuts[1:]):
            if b > a:
                child.add(keys[a:b], counts[a:b])
        self.split()

    def split(self) -> None:
        shift = ID_BITS * self.left
        i = 0
        while i < len(self.children):
            child = self.children[i]
            if isinstance(child, Node) or child.used <= self.burst:
                i += 1
                continue
            keys, counts = child.entries()
            ids = keys >> shift
            if ids[0] == ids[-1]:           # one word: the next one tells its phrases apart
                node = Node(self.level + 1, self.burst, self.left - 1, child)
                node.split()
                self.children[i] = node
                continue
            middle = ids[len(ids) // 2]
            cut = np.searchsorted(ids, middle if middle > ids[0] else middle + 1)
            parts = Container(), Container()
            parts[0].add(keys[:cut], counts[:cut])
            parts[1].add(keys[cut:], counts[cut:])
            self.children[i:i + 1] = parts
            self.starts = np.insert(self.starts, i + 1, ids[cut] << shift)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        both = [c.entries() for c in self.children]
        return np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both])

    def taken(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of a whole subtree, which is empty afterwards."""
        out = self.children[i].entries()
        self.children[i] = Container()
        return out


class Counter:
    """The phrases of ``length`` words of one language, as far as a task has seen it."""

    def __init__(self, lang: str, length: int, bits: np.ndarray | None, burst: int = BURST) -> None:
        self.lang, self.length, self.bits, self.burst = lang, length, bits, burst
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.hashes = np.zeros(0, np.uint64)
        self.root = Node(0, self.burst, self.length - 1)

    def add(self, words: pa.Array, piece: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts a row of words; runs come out where the word ids would not fit."""
        for at in range(0, len(words), SLICE):
            stop = min(at + SLICE + self.length - 1, len(words))
            if len(self.words) + stop - at > 1 << ID_BITS:
                yield from self.spilled(0)
                self.forget()
            self._count(words.slice(at, stop - at), piece[at:stop], min(SLICE, len(words) - at))

    def _count(self, words: pa.Array, piece: np.ndarray, starts: int) -> None:
        coded = words.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        known = list(map(self.ids.get, listed))
        fresh = [w for w, k in zip(listed, known) if k is None]
        if fresh:
            self.ids.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
            self.words += fresh
            known = list(map(self.ids.get, listed))
        local = np.array(known, np.int64)
        if fresh:
            self.hashes = np.concatenate([self.hashes, phrase_hashes(self.lang, [fresh])])
        ids = local[coded.indices.to_numpy(zero_copy_only=False)]
        n = min(starts, len(ids) - self.length + 1)
        if n <= 0:
            return
        good = np.ones(n, bool)
        if self.length > 1:
            good &= piece[:n] == piece[self.length - 1:self.length - 1 + n]
        if self.bits is not None:           # both parts that are one word shorter
            h = self.hashes[ids]
            part = h
            for k in range(1, self.length - 1):
                part = joined(part[:len(h) - k], h[k:])
            known = among(self.bits, part)
            good &= known[:n] & known[1:n + 1]
        at = np.flatnonzero(good)
        keys = ids[at]
        for k in range(1, self.length):
            keys = (keys << ID_BITS) | ids[at + k]
        self.root.add(*np.unique(keys, return_counts=True))

    def spilled(self, rest: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the largest subtrees until at most ``rest`` phrases stay."""
        sizes = np.array([c.used for c in self.root.children])
        for i in np.argsort(-sizes, kind="stable"):
            if sizes.sum() <= rest:
                return
            if sizes[i]:
                yield self._run(*self.root.taken(i))
                sizes[i] = 0

    def _run(self, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [(keys >> (ID_BITS * (self.length - 1 - k))) & ((1 << ID_BITS) - 1) for k in range(self.length)]
        used = np.unique(np.concatenate(columns))
        words = pa.array([self.words[i] for i in used.tolist()], pa.string())
        rank = np.empty(len(used), np.int64)
        order = pc.array_sort_indices(words).to_numpy(zero_copy_only=False)
        rank[order] = np.arange(len(used))
        ranks = [rank[np.searchsorted(used, c)] for c in columns]
        row = np.lexsort(ranks[::-1])
        words = words.take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(row), np.int64))),
             *[words.take(pa.array(r[row])) for r in ranks], pa.array(counts[row])],
            ["lang", *names(self.length), "n"])


def names(length: int) -> list[str]:
    return [f"w{k}" for k in range(1, length + 1)]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right, 2)


def phrase_hashes(lang: str, columns: list[list[str]]) -> np.ndarray:
    """A 64-bit hash of each phrase from its words, a column for each place."""
    out = None
    for words in columns:
        h = string_hashes([f"{lang}\n{w}" for w in words])
        out = h if out is None else joined(out, h)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counter(length: int, shared, burst: int, spill: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for batch in steps(batches):
            langs = pc.fill_null(batch.column("lang"), "und")
            for lang in sorted(pc.unique(langs).to_pylist()):
                if lang not in counters:
                    counters[lang] = Counter(lang, length, None if shared is None else shared.value, burst)
                yield from counters[lang].add(*tokens(batch.column("text").filter(pc.equal(langs, lang))))
            held = sum(c.root.used for c in counters.values())
            if held > spill:
                # Most of the phrases go, each language in proportion to what it holds.
                for c in counters.values():
                    yield from c.spilled(c.root.used // 4)
        for c in counters.values():
            yield from c.spilled(0)
    return count


def counted(docs: DataFrame, length: int, bits: np.ndarray | None, burst: int = BURST, spill: int = SPILL) -> DataFrame:
    """lang, w1 .., n: occurrences of the phrases of ``length`` words that ``bits`` lets pass."""
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    words = names(length)
    runs = docs.select("lang", "text").mapInArrow(
        _counter(length, shared, burst, spill), ", ".join(["lang string", *[f"{w} string" for w in words], "n long"]))
    part = F.pmod(F.xxhash64(*words[1:]), F.lit(SPREAD)) if length > 1 else F.lit(0)
    return runs.withColumn("part", part).repartition("lang", "w1", "part") \
        .groupBy("lang", "w1", "part", *words[1:]).agg(F.sum("n").alias("n")).drop("part")


def filter_of(phrases: DataFrame, length: int) -> np.ndarray:
    """The bit array of the phrases' hashes; what the driver gets is bounded by ``FILTER_BITS``."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("lang"), lang))
                h = phrase_hashes(lang, [rows.column(w).to_pylist() for w in names(length)])
                yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(FILTER_BITS - 1)).astype(np.int64))], ["at"])

    blocks = phrases.select("lang", *names(length)).mapInArrow(places, "at long") \
        .groupBy(F.floor(F.col("at") / 32768).alias("block")) \
        .agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, bits in blocks.collect():
        out[block * 4096:(block + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)) in decimals; at most 1000000, as neither part is rarer than the phrase."""
    big = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast(cast(1000000 as decimal(7,0)) * ({big(a)} * {big(a)}) div ({big(left)} * {big(right)}) as long)")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, burst: int = BURST,
                 spill: int = SPILL) -> DataFrame:
    """``docs`` (lang, text) -> the best ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang is ``und``. Repeated rows count as often as they occur, other columns are
    ignored, and without candidates the result is empty. Phrases of equal score and count are in the order of their
    UTF-8 bytes; a phrase's cuts of equal score count by the shorter first part.
    """
    words = stored(counted(docs, 1, None, burst, spill), "words")
    total = words.groupBy("lang").agg(F.sum("n").cast("long").alias("total"))
    one = stored(words.where(F.col("n") >= least), "one")
    two = stored(counted(docs, 2, filter_of(one, 1), burst, spill).where(F.col("n") >= least), "two")
    three = stored(counted(docs, 3, filter_of(two, 2), burst, spill).where(F.col("n") >= least), "three")

    def of(frame: DataFrame, name: str, *places: str) -> DataFrame:
        return frame.select("lang", *[F.col(w).alias(p) for w, p in zip(names(len(places)), places)],
                            F.col("n").alias(name))

    pairs = of(two, "a", "w1", "w2").join(of(one, "l", "w1"), ["lang", "w1"]).join(of(one, "r", "w2"), ["lang", "w2"])
    triples = of(three, "a", "w1", "w2", "w3").join(of(one, "l1", "w1"), ["lang", "w1"]) \
        .join(of(one, "r2", "w3"), ["lang", "w3"]).join(of(two, "l2", "w1", "w2"), ["lang", "w1", "w2"]) \
        .join(of(two, "r1", "w2", "w3"), ["lang", "w2", "w3"])
    covers = triples.select("lang", "a", F.explode(F.array(
        F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    covers = covers.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(covers, ["lang", "w1", "w2"], "left") \
        .where("longer IS NULL OR cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * 50")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
                         _score("a", "l", "r").alias("score"))
    triples = triples.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return pairs.union(triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first) \
        .join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                    F.col("total").alias("n"), "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
    WITH piece AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    w AS (
        SELECT lang, i, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (
            SELECT lang, row_number() OVER () AS i, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece)),
    run AS (
        SELECT lang, w AS w1, lead(w) OVER (PARTITION BY i ORDER BY pos) AS w2,
            lead(w, 2) OVER (PARTITION BY i ORDER BY pos) AS w3 FROM w),
    f AS MATERIALIZED (
        SELECT lang, 1 AS size, w1 AS g, w1, '' AS w2, '' AS w3, count(*) AS a FROM run GROUP BY ALL
        UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, '', count(*) FROM run WHERE w2 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM run WHERE w3 IS NOT NULL
        GROUP BY ALL),
    total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
    candidate AS MATERIALIZED (SELECT * FROM f WHERE size >= 2 AND a >= {LEAST}),
    part AS (
        SELECT lang, size, g, a, 1 AS k, w1 AS g1, trim(w2 || ' ' || w3, ' ') AS g2 FROM candidate
        UNION ALL SELECT lang, size, g, a, 2, w1 || ' ' || w2, w3 FROM candidate WHERE size = 3),
    cut AS (
        SELECT c.lang, c.size, c.g, c.a, k, l.a AS l, r.a AS r,
            CAST((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
        FROM part c JOIN f l ON l.lang = c.lang AND l.g = c.g1 JOIN f r ON r.lang = c.lang AND r.g = c.g2),
    lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    covered AS (
        SELECT lang, p, max(a) AS longer FROM (
            SELECT lang, a, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS p FROM candidate WHERE size = 3)
        GROUP BY ALL),
    left_over AS (
        SELECT x.*, x.g AS phrase FROM lowest x LEFT JOIN covered c ON c.lang = x.lang AND c.p = x.g
        WHERE longer IS NULL OR 100 * longer < 50 * x.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM left_over) JOIN total USING (lang)
    WHERE rank <= {FIRST}"""
