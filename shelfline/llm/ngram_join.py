"""N-gram Jaccard join with filters under several global token orders.

A document's tokens are its distinct word shingles. Two sets whose Jaccard similarity reaches the threshold share at
least one token in their prefixes under *any* total order of the tokens; with prefixes longer by ``l - 1`` they share
at least ``l``. The join intersects the filters of three orders, each by another hash:

1. Under the first, prefixes that are longer by a fifth of the set are posted by token. A document stays a candidate
   only while enough of its posted tokens are shared with other candidates, which removes documents that merely share
   passages without looking at any pair.
2. A pair that shares posted tokens must also share prefix tokens under the second **and** the third order.
3. What is left is verified on the whole sets.

Equal texts form one class before anything is posted, and links are looked for between classes. Large groups of near
copies are linked through one pivot per token first; after that only documents of *different* components are compared.
For tokens of up to ``HOT`` documents such pairs are joined and their shared tokens counted; their frequent tokens count
as shared. Documents with so many frequent tokens that these alone could make them similar are posted again under a
fourth order, rarest tokens first, whose prefixes hold frequent tokens only where nearly the whole text is frequent. Documents that share such a token even so are put into blocks of bounded
size; inside a block's task the second and third order choose the candidates, and at most a link per document and
other component is returned; so no pair of components is missed and no group is expanded into its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, components, encoded, mixed, steps, stored, string_hashes, table, window_hashes, words

# Documents of a token up to which its pairs are joined; documents, and tokens of their sets, in a block beyond that.
HOT, BLOCK, BLOCK_TOKENS = 64, 256, 500_000
# Parts of all tokens that are shuffled one after the other.
SLICES = 4

SIGNATURE = "doc_id long, cls long, chk long, n long, prefix array<long>"


def min_overlap(n, percent: int):
    """Least overlap of a set of ``n`` with a set that is similar enough."""
    return -(-n * percent // 100)


def shared_needed(n):
    """Tokens that two long prefixes must share: ``l`` for a set of ``n``."""
    return 1 + n // 5


def _sets(text: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each row its sorted distinct shingle hashes and two hashes of its word sequence."""
    flat, offsets = words(pc.ascii_lower(pc.fill_null(text, "")))
    codes, vocabulary = encoded(flat)
    h = string_hashes(vocabulary)[codes] if vocabulary else np.zeros(0, np.uint64)
    shingles = window_hashes(h, width)
    position = (np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    placed = h + position * np.uint64(0x9E3779B97F4A7C15)
    one, two = mixed(placed, 11), mixed(placed, 12)
    for start, stop in zip(offsets[:-1], offsets[1:]):
        n = int(stop - start)
        if n == 0:
            yield shingles[:0], 0, 0
            continue
        tokens = np.unique(shingles[start:stop - width + 1]) if n >= width else \
            mixed(window_hashes(h[start:stop], n), 20 + n)
        size = np.array([n], np.uint64)
        yield (tokens, mixed(one[start:stop].sum(keepdims=True) ^ size, 13)[0],
               mixed(two[start:stop].sum(keepdims=True) ^ size, 14)[0])


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(kind)))


def _signer(width: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class repeated inside a task posts its tokens once; rows without doc_id post none
        for batch in steps(batches):
            cls, chk, sizes, prefixes = [], [], [], []
            named = batch.column("doc_id").is_valid().to_pylist()
            for has_id, (tokens, one, two) in zip(named, _sets(batch.column("text"), width)):
                n = len(tokens)
                length = n - min_overlap(n, percent) + shared_needed(n)
                prefixes.append(tokens[:length].copy() if has_id and one not in seen else tokens[:0])
                if has_id and len(seen) < 2_000_000:
                    seen.add(one)
                cls.append(one if n else None)
                chk.append(two)
                sizes.append(n)
            longs = pa.array([None if c is None else int(np.uint64(c).astype(np.int64)) for c in cls], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), longs,
                 pa.array(np.array(chk, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 _lists(prefixes, np.int64)], ["doc_id", "cls", "chk", "n", "prefix"])
    return sign


def _ordered(width: int, percent: int):
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets, and their prefixes under the two other hash orders."""
        for batch in steps(batches):
            sets, prefixes, own = [], ([], []), []
            for tokens, one, _ in _sets(batch.column("text"), width):
                length = len(tokens) - min_overlap(len(tokens), percent) + 1
                for k, out in enumerate(prefixes):
                    out.append(np.sort(mixed(tokens, 2 + k))[:length].astype(np.uint32))
                sets.append(tokens)
                own.append(int(np.uint64(one).astype(np.int64)))
            same = pc.equal(pa.array(own, pa.int64()), batch.column("cls"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("n"), _lists(sets, np.int64), _lists(prefixes[0], np.int32),
                 _lists(prefixes[1], np.int32)], ["cls", "n", "tokens", "second", "third"]).filter(same)
    return order


class _Posted:
    """The members of a block by the tokens of their lists."""

    def __init__(self, lists: pd.Series) -> None:
        tokens = np.concatenate(lists.to_list())
        order = np.argsort(tokens, kind="stable")
        self.members = len(lists)
        self.owner = np.repeat(np.arange(len(lists)), lists.map(len).to_numpy())[order]
        self.known, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.r_[self.first[1:], len(tokens)]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        """How many tokens each member shares with ``mine``."""
        at = np.searchsorted(self.known, mine)
        at = at[self.known[np.minimum(at, len(self.known) - 1)] == mine]
        n = self.last[at] - self.first[at]
        places = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[places], minlength=self.members)


def _block(percent: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the asking documents to documents of other components: one for each pair of components at most."""
        pdf = pdf.sort_values(["asks", "cls"], ignore_index=True)
        members, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        if not len(members):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        second, third, whole = (_Posted(members[c]) for c in ("second", "third", "tokens"))
        sizes = members["tokens"].map(len).to_numpy()
        names, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        comp_of, root = comp[:len(members)], np.arange(len(names))
        cls, out = members["cls"].to_numpy(), []
        for name, own, mine, two, three in zip(asking["cls"], comp[len(members):], asking["tokens"], asking["second"],
                                               asking["third"]):
            maybe = (root[comp_of] != root[own]) & (second.shared(two) > 0)
            if not maybe.any():
                continue
            maybe &= third.shared(three) > 0
            if not maybe.any():
                continue
            for k in np.flatnonzero(maybe & ((100 + percent) * whole.shared(mine)
                                             >= percent * (len(mine) + sizes))).tolist():
                x, y = root[comp_of[k]], root[own]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    out.append((name, cls[k]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return compare


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) and split at ASCII white space. A text of fewer than ``width`` words is one shingle;
    one without words, or null, has none and its component is its own doc_id. A row with a null doc_id gets its
    count and a null component and links with nothing. Repeated rows each get a row. Other columns are ignored. An
    empty table gives an empty result. Two texts of equal 64-bit hash but different check hash stop the job.
    """
    # Sets are compared by 64-bit shingle hashes.
    with Scratch() as scratch:
        rows, of_class = _classified(docs, width, percent, scratch)
        scratch.keep(rows, of_class)
    return rows.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
        .alias("component_id"))


def _shared(postings: DataFrame) -> DataFrame:
    """``postings`` (cls, token) of the tokens that several classes have; repeats inside a class don't count.

    A frequent token is one partly aggregated row here, and a join partition that adaptive execution can split.
    """
    ends = postings.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    return postings.join(stored(ends.where("low <> high").select("token"), "tokens"), "token", "left_semi")


def _sliced(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """The different ``postings`` of shared tokens, found in ``SLICES`` slices of the tokens.

    All documents' postings are shuffled here; the files of one slice are deleted before the next is begun.
    """
    slices = [stored(_shared(postings.where(F.pmod("token", F.lit(SLICES)) == k)).distinct(), "slice")
              for k in range(SLICES)]
    live = stored(functools.reduce(DataFrame.union, slices), "live")
    scratch.drop(*slices)
    return live


def _classified(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes (doc_id, cls, n), and each class's component (cls, component_id)."""
    signed = stored(docs.select("doc_id", "text").mapInArrow(_signer(width, percent), SIGNATURE), "signed")
    rows = stored(signed.select("doc_id", "cls", "n"), "rows")
    ids = signed.where("doc_id IS NOT NULL AND cls IS NOT NULL")
    classes = stored(ids.groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("chk").alias("low"),
        F.max("chk").alias("high")), "classes")
    if classes.where("low <> high").limit(1).count():
        raise ValueError("two different texts have the same 64-bit hash")
    classes = classes.select("cls", "rep", "n")

    least_overlap = F.expr(f"(n * {percent} + 99) DIV 100")
    live = _sliced(ids.select("cls", F.explode("prefix").alias("token")), scratch)
    scratch.drop(signed)
    for _ in range(2):
        enough = live.groupBy("cls").agg(F.count("*").alias("shared")).join(classes, "cls") \
            .where(F.col("shared") >= 1 + F.floor(least_overlap / 5)).select("cls", "n")
        some = stored(live.select("cls", "token").join(enough, "cls"), "some")
        scratch.drop(live)
        live = stored(_shared(some), "live")
        scratch.drop(some)
    survivors = stored(live.select("cls").distinct().join(classes, "cls"), "survivors")

    texts = docs.select("doc_id", "text").join(survivors.withColumnRenamed("rep", "doc_id"), "doc_id") \
        .select("cls", "n", "text")
    sets = stored(texts.mapInArrow(
        _ordered(width, percent), "cls long, n long, tokens array<long>, second array<int>, third array<int>")
        .dropDuplicates(["cls"]), "sets")

    def joined(pairs: DataFrame, *columns: str) -> DataFrame:
        one, two = (sets.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
        return pairs.join(one, "a").join(two, "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are links: whole sets meet only where the second and the third order agree."""
        some = stored(joined(pairs, "second", "third").where(
            F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
            .select("a", "b"), "candidates")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        links = stored(joined(some, "n", "tokens").where(
            100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "links")
        scratch.drop(some)
        return links

    def near(n: str, m: str) -> Column:
        return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")

    comps = survivors.select("cls", F.col("cls").alias("comp"))
    links = tested = None
    while True:
        held = stored(live.join(comps, "cls"), "held")
        pivots = stored(held.groupBy("token").agg(
            F.min(F.struct("comp", "cls", "n")).alias("p"), F.max("comp").alias("last"))
            .where("p.comp <> last").select("token", "p.*")
            .toDF("token", "pivot_comp", "pivot", "pivot_n"), "pivots")
        pairs = held.join(pivots, "token").where((F.col("comp") != F.col("pivot_comp")) & near("n", "pivot_n")) \
            .select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        scratch.drop(held, pivots)
        tried = pairs.count()
        found = verified(pairs) if tried else None
        n_found = found.count() if tried else 0
        if n_found:
            links = found if links is None else links.union(found)
            before, comps = comps, _relabelled(survivors, links)
            scratch.drop(before)
        if tried:
            tested = pairs if tested is None else tested.union(pairs)
        if not tried or n_found * 10 < tried:
            break

    # Every possible pair of different components: those of rare tokens joined, those of frequent tokens in blocks.
    held = stored(live.join(comps, "cls"), "held")
    scratch.drop(live, comps)
    several = stored(held.groupBy("token").agg(
        F.count("*").alias("times"), F.min("comp").alias("cluster"), F.max("comp").alias("last"))
        .where("cluster <> last").select("token", "times", "cluster"), "several")
    often = stored(held.join(several.where(F.col("times") > HOT).select("token"), "token")
                   .groupBy("cls", "comp", "n").agg(F.count("*").alias("often")), "often")
    sides = stored(held.join(several.where(F.col("times") <= HOT).select("token"), "token")
                   .join(often.select("cls", "often"), "cls", "left").fillna(0, ["often"]), "sides")
    # Only documents with that many frequent tokens can be similar without sharing a rare one.
    many = F.col("often") >= 1 + F.floor(least_overlap / 5)
    frequent = stored(often.where(many).select("cls", "comp", "n"), "frequent")
    scratch.drop(held, several, often)

    def together(postings: DataFrame, *more: str) -> DataFrame:
        left, right = (postings.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "comp", *more)])
                       for x in "ab")
        return left.join(right, "token").where(
            (F.col("comp_a") != F.col("comp_b")) & (F.col("cls_a") < F.col("cls_b")) & near("n_a", "n_b")) \
            .withColumnsRenamed({"cls_a": "a", "cls_b": "b"})

    # What a pair lacks in shared rare tokens it may share in frequent ones; two documents with many meet below.
    in_common = F.when(F.col("many_a") & F.col("many_b"), 0).otherwise(F.least("often_a", "often_b"))
    pairs = together(sides.withColumn("many", many), "often", "many") \
        .groupBy("a", "b", "n_a", "n_b", in_common.alias("often")).agg(F.count("*").alias("shared")) \
        .where(F.col("shared") + F.col("often") >= 1 + F.floor(F.least("n_a", "n_b") / 5)).select("a", "b")
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    scratch.drop(sides)
    found = [verified(pairs)]
    tested = pairs if tested is None else tested.union(pairs)

    # Documents with many frequent tokens are posted again, by the rarest tokens of their whole sets.
    spread = sets.join(frequent, ["cls", "n"]).select("cls", "comp", "n", F.explode("tokens").alias("token"))
    times = stored(spread.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"), "times")
    rare = stored(spread.join(times, "token").groupBy("cls", "comp", "n").agg(
        F.array_sort(F.collect_list(F.struct("times", "token"))).alias("common"))
        .select("cls", "comp", "n", F.explode(F.slice("common", 1, F.greatest(F.size("common") + 1 - least_overlap, F.lit(0))
                                                      .cast("int"))).alias("t"))
        .select("cls", "comp", "n", "t.token"), "rare")
    scratch.drop(frequent, times)
    several = stored(rare.groupBy("token").agg(
        F.count("*").alias("times"), F.min("comp").alias("cluster"), F.max("comp").alias("last"))
        .where("cluster <> last").select("token", "times", "cluster"), "several")
    pairs = together(rare.join(several.where(F.col("times") <= HOT).select("token"), "token")).select("a", "b").distinct()
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found.append(verified(pairs))
    clusters = stored(rare.join(several.where(F.col("times") > HOT).select("token", "cluster"), "token")
                      .select("cluster", "cls", "comp", "n").distinct(), "clusters")
    scratch.drop(rare, several)

    def parts(among: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(among) / BLOCK), F.ceil(F.sum(F.when(among, F.col("n"))) / BLOCK_TOKENS),
                          F.lit(1)).cast("int")

    dealt = clusters.join(clusters.groupBy("cluster").agg(
        parts(F.lit(True)).alias("blocks"), parts(F.col("comp") != F.col("cluster")).alias("others")), "cluster")
    every = dealt.select("cluster", "cls", "comp", F.lit(False).alias("asks"), F.expr("int(pmod(cls, blocks))").alias("j"),
                         F.explode(F.expr("sequence(0, others - 1)")).alias("i"))
    asking = dealt.where("comp <> cluster").select(
        "cluster", "cls", "comp", F.lit(True).alias("asks"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"),
        F.expr("int(pmod(cls, others))").alias("i"))
    found.append(stored(every.unionByName(asking).join(sets.select("cls", "tokens", "second", "third"), "cls")
                        .groupBy("cluster", "i", "j").applyInPandas(_block(percent), "a long, b long"), "links"))
    scratch.drop(sets, clusters)
    for more in found:
        links = more if links is None else links.union(more)
    comps = _relabelled(survivors, links)

    least = classes.join(comps.select("cls", "comp"), "cls", "left") \
        .withColumn("comp", F.coalesce("comp", "cls"))
    first = least.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return rows, stored(least.join(first, "comp").select("cls", "component_id"), "of-class")


def _relabelled(survivors: DataFrame, links: DataFrame) -> DataFrame:
    with Scratch() as scratch:
        comps = components(links).withColumnRenamed("node", "cls")
        out = stored(survivors.select("cls").join(comps, "cls", "left")
                     .withColumn("comp", F.coalesce("comp", "cls")), "comps")
        scratch.keep(out)
    return out


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
