"""Embedding near-duplicates by randomly rotated binary codes with correction factors.

Unit vectors are rotated by a random orthogonal matrix; a code keeps the signs. Stored with it is the inner product of
the vector and its code, which makes the estimate from code and query unbiased and gives its confidence bound. A query
is quantised to four bit planes, so that an estimate is four population counts. Pairs whose upper bound reaches the
threshold are recomputed exactly in double precision, and only those that then reach it are links.

Equal vectors form one class. The classes of a label are dealt into blocks of bounded size and every pair of blocks
is one group, so no task holds a label; a group returns link counts and one root per linked class, never its pairs.
The work is quadratic in a label's different vectors, as comparing all of them is.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, stored, table

THRESHOLD = 0.93
BLOCK = 2048
# Standard deviations within which an estimate is trusted: one pair in some 30,000 lies outside on one side.
SIGMAS = 4.0
PLANES = 4


@cache
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes, correction factors, and bit planes of unit vectors (rows)."""

    def __init__(self, unit: np.ndarray) -> None:
        n, dim = unit.shape
        self.size = -(-dim // 64) * 64
        padded = np.zeros((n, self.size))
        padded[:, :dim] = unit
        turned = padded @ rotation(self.size)
        self.bits = self._packed(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.float64)
        # Inner product of each vector and its code.
        self.factor = np.abs(turned).sum(1) / np.sqrt(self.size)
        # Quantised queries, rounded at random so that the error has mean zero.
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2 ** PLANES - 1), 1e-12)
        noise = np.random.default_rng(n).random(turned.shape)
        levels = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + noise), 0, 2 ** PLANES - 1)
        self.planes = [self._packed((levels.astype(np.uint8) >> k & 1).astype(bool)) for k in range(PLANES)]
        self.total = turned.sum(1)

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1).view(np.uint64)

    def estimates(self, other: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the cosines of ``other``'s ``rows`` as queries with these codes, and half-widths of
        their confidence intervals."""
        counts = np.zeros((rows.stop - rows.start, len(self.bits)))
        for k, plane in enumerate(other.planes):
            for w in range(self.bits.shape[1]):
                counts += np.bitwise_count(plane[rows, w, None] & self.bits[None, :, w]) * float(2 ** k)
        inner = 2 * (other.low[rows, None] * self.ones + other.step[rows, None] * counts) - other.total[rows, None]
        error = np.sqrt(np.maximum(1 - self.factor ** 2, 0) / max(self.size - 1, 1))
        width = SIGMAS * (error + other.step[rows, None] / 2) / self.factor
        return inner / np.sqrt(self.size) / self.factor, width


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of linked a and b; ``root`` is the smallest index of each component so far."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def linked(one: np.ndarray, two: np.ndarray | None, threshold: float, chunk: int = 256):
    """Links between rows of ``one`` and ``two`` (or inside ``one``), chunk by chunk: row numbers in either."""
    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    u = unit(one)
    v = u if two is None else unit(two)
    codes = Codes(u)
    queries = codes if two is None else Codes(v)
    for start in range(0, len(v), chunk):
        rows = slice(start, min(start + chunk, len(v)))
        value, width = codes.estimates(queries, rows)
        q, d = np.nonzero(value + width >= threshold)
        q += start
        if two is None:
            q, d = q[d < q], d[d < q]
        for at in range(0, len(q), 50_000):
            x, y = d[at:at + 50_000], q[at:at + 50_000]
            exact = np.einsum("ij,ij->i", u[x], v[y]) >= threshold
            yield x[exact], y[exact]


def _block_pair(threshold: float):
    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = key[2], key[3]
        # Sorted, so that a repeated task gives the same result.
        pdf = pdf.sort_values(["block", "cls"], ignore_index=True)
        # Scaled by the largest component: squares neither overflow nor vanish.
        vectors = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        vectors /= np.abs(vectors).max(1, keepdims=True)
        cut = int((pdf["block"] == first).sum())
        n = len(pdf)
        copies, links, root = pdf["copies"].to_numpy(), np.zeros(n, np.int64), np.arange(n)
        if first == second or 0 < cut < n:
            two = None if first == second else vectors[cut:]
            for a, b in linked(vectors[:cut], two, threshold):
                b = b if two is None else b + cut
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                merge(root, a, b)
        some = links > 0
        cls = pdf["cls"].to_numpy()
        return pd.DataFrame({"cls": cls[some], "links": links[some], "root": cls[root[some]]})
    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per input row.

    Vectors are compared when their labels are equal and not null and their lengths are equal. A vector that is null,
    empty, zero, or holds a null, infinite or NaN component links with nothing, and neither does a row with a null
    vec_id, whose component is null and which is not kept. Repeated rows link with each other. Other columns are
    ignored; an empty table gives an empty result.
    """
    fine = F.expr("""vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0
        AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))
        AND exists(embedding, x -> x <> 0)""")
    rows = vectors.select("vec_id", "label", "embedding", F.size("embedding").alias("dim"),
                          F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "embedding")).alias("cls"))
    classes = stored(rows.where("cls IS NOT NULL").groupBy("label", "dim", "cls").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")),
        "classes")
    sizes = stored(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")),
                   "sizes")
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.expr("int(pmod(cls, blocks))"))
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls",
        "copies", "embedding")
    found = stored(paired.groupBy("label", "dim", "i", "j").applyInPandas(
        _block_pair(threshold), "cls long, links long, root long"), "found")
    comps = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = classes.select("cls", "rep", "copies").join(links, "cls", "left") \
        .join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = stored(of_class.join(first, "comp").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "of-class")
    out = rows.select("vec_id", "cls").join(of_class, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
