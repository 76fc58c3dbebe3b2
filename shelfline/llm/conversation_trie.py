"""Prefix trie of conversations, built from range-partitioned shards around a skeleton of their splitters.

A conversation is a path of turns, each known by a 128-bit digest of its role and text; texts are read once and go no
further. Equal paths become one row. The different paths are range-partitioned into sorted shards, so that a node of
the trie is a run of neighbouring paths. A node that lies in more than one shard holds the paths on both sides of some
shard's boundary, and is therefore a common prefix of them: these prefixes, a few for each boundary, are the
skeleton, a small trie that is broadcast. Each shard walks its sorted paths once, with a stack of the open nodes; it
finishes every node that is not in the skeleton and gives its share of each node that is. The shares are added up, and
the skeleton's own subtree sums are taken over its few nodes.

The digest of the ids that end at a node needs them in order: they are sorted by Spark and hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, table

STEP = 16               # bytes of a turn's digest
GROUP, TURNS = 5, 9     # a conversation takes its first turns, fewer than TURNS, from the first of its GROUP
SHARD_TURNS = 20_000    # turns in a shard, about
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = ("node int, parent_node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, bytes long, ends_sha256 string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the turns' digests in a row), sizes (the bytes of each text), key (a digest of the path)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("size")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["digest"], t["size"])).alias("own"))
    heads = own.where(f"conv_id % {GROUP} = 0").select(
        F.col("conv_id").alias("head_id"), F.slice("own", 1, TURNS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TURNS)).cast("int")
    both = own.withColumn("h", h).withColumn("head_id", F.expr(f"conv_id - conv_id % {GROUP}")) \
        .join(heads, "head_id", "left")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), F.col("h")),
                     F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    path = both.select("conv_id", turns.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("path"), F.col("t.size").alias("sizes"))
    return path.withColumn("key", F.md5("path"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of rows in the order of key and conv_id: the hash of its ids, comma-joined."""
    last, digest = None, None
    for batch in batches:
        out = []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if key == last:
                digest.update(b",%d" % conv)
                continue
            if last is not None:
                out.append((last, digest.hexdigest()))
            last, digest = key, hashlib.sha256(b"%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["key", "ends"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], ["key", "ends"])


def different_paths(paths: DataFrame) -> DataFrame:
    """key, path, sizes, n, conv_id (the smallest), ends: one row for each path that conversations have."""
    ends = paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id") \
        .mapInArrow(_end_digests, "key string, ends string")
    return paths.groupBy("key").agg(F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"),
                                    F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).join(ends, "key")


def common(a: bytes, b: bytes) -> int:
    """Turns at the start of both paths."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // STEP
    at = 0
    while a[at:at + STEP] == b[at:at + STEP]:
        at += STEP
    return at // STEP


@dataclass
class Skeleton:
    """The nodes in more than one shard: parent and depth of each, and the child by parent and digest."""
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    children: dict[tuple[int, bytes], int] = field(default_factory=dict)

    def add(self, parent: int, digest: bytes, depth: int) -> int:
        if (parent, digest) not in self.children:
            self.children[parent, digest] = len(self.parents)
            self.parents.append(parent)
            self.depths.append(depth)
        return self.children[parent, digest]

    def child(self, parent: int, digest: bytes) -> int:
        """-1 where the skeleton has no such node; the root is the child of -1 without a digest."""
        return self.children.get((parent, digest), -1)


def skeleton(bounds: list[tuple[bytes, bytes]]) -> Skeleton:
    """From the first and last path of each shard, in order."""
    out = Skeleton()
    for (_, last), (first, _) in zip(bounds, bounds[1:]):
        node = out.add(-1, b"", 0)
        for k in range(common(last, first)):
            node = out.add(node, first[k * STEP:(k + 1) * STEP], k + 1)
    return out


class Open:
    """A node whose paths are still coming."""
    __slots__ = ("node", "depth", "size", "n", "conv", "children", "leaves", "saved", "ends", "done")

    def __init__(self, node: int, depth: int, size: int) -> None:
        self.node, self.depth, self.size = node, depth, size
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.done = NOTHING, []

    def finished(self, parent: Open | None) -> Iterator[tuple]:
        """Adds this node to its parent; rows whose parent's smallest id is known come out."""
        leaves, saved = self.leaves, self.saved
        if self.node < 0:
            saved += (self.n - 1) * self.size
            leaves = leaves if self.children else 1
            for row in self.done:
                yield (None, None, *row[:2], self.conv, *row[2:])
        row = self.conv, self.depth, self.n, self.children, leaves, saved, self.size, self.ends
        if self.node >= 0:                  # a share of a node of the skeleton
            yield (self.node, None, *row[:2], None, *row[2:])
        elif parent is None:
            yield (None, None, *row[:2], None, *row[2:])
        elif parent.node >= 0:
            yield (None, parent.node, *row[:2], None, *row[2:])
        else:
            parent.done.append(row)
        if parent is not None:
            parent.n += self.n
            parent.conv = self.conv if parent.conv is None else min(parent.conv, self.conv)
            if self.node < 0:
                parent.children += 1
                parent.leaves += leaves
                parent.saved += saved


def walked(rows: Iterator[tuple], bones: Skeleton) -> Iterator[tuple]:
    """The nodes of shards whose paths come in order: (shard, path, sizes, n, conv_id, ends)."""
    stack: list[Open] = []
    shard, last = None, b""

    def closed(depth: int) -> Iterator[tuple]:
        while len(stack) > depth + 1:
            node = stack.pop()
            yield from node.finished(stack[-1] if stack else None)

    for now, path, sizes, n, conv, ends in rows:
        if now != shard:
            yield from closed(-1)
            stack.append(Open(bones.child(-1, b""), 0, 0))
            shard, last = now, b""
        yield from closed(common(last, path))
        for k in range(len(stack) - 1, len(path) // STEP):
            above = stack[-1].node
            node = bones.child(above, path[k * STEP:(k + 1) * STEP]) if above >= 0 else -1
            stack.append(Open(node, k + 1, sizes[k]))
        top, last = stack[-1], path
        top.n, top.conv, top.ends = top.n + n, conv if top.conv is None else min(top.conv, conv), ends
    yield from closed(-1)


def _walker(shared):
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.string()]
    names = [c.split()[0] for c in NODE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in (
            "shard", "path", "sizes", "n", "conv_id", "ends")]))
        out = []
        for row in walked(rows, shared.value):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
    return walk


def reduced(bones: Skeleton, shares: list) -> list[tuple]:
    """The rows of the skeleton's nodes from the sums of their shares."""
    of = {r["node"]: r for r in shares}
    children, leaves, saved = {}, {}, {}
    for k in reversed(range(len(bones.parents))):  # a node comes after its parent
        r = of[k]
        children[k] = children.get(k, 0) + r["n_children"]
        leaves[k] = leaves.get(k, 0) + r["n_leaves"] if children[k] else 1
        saved[k] = saved.get(k, 0) + r["saved_tokens"] + (r["n_convs"] - 1) * r["bytes"]
        if (p := bones.parents[k]) >= 0:
            children[p] = children.get(p, 0) + 1
            leaves[p] = leaves.get(p, 0) + leaves[k]
            saved[p] = saved.get(p, 0) + saved[k]
    return [(k, of[k]["conv_id"], bones.depths[k], of[p]["conv_id"] if p >= 0 else None, of[k]["n_convs"],
             children[k], leaves[k], saved[k], of[k]["ends_sha256"]) for k, p in enumerate(bones.parents)]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> one row for each node: ``COLUMNS``.

    Turns of equal number are in the order of role and text digest; a row that repeats is a further turn. A null turn
    comes first, null roles and texts are empty, rows without a conv_id are left out, and other columns are ignored.
    An empty table has no nodes, not even the root. Remainders have the sign of the id, as in SQL. A conversation's
    digests, ``STEP`` bytes a turn, are one row.
    """
    spark = conversations.sparkSession
    paths = stored(rebuilt(conversations), "paths")
    different = stored(different_paths(paths), "different")
    turns = different.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    dealt = stored(different.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "shards")
    ends = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("first")
    bones = skeleton([(bytes(r["first"]), bytes(r["last"])) for r in ends.collect()])
    shared = spark.sparkContext.broadcast(bones)
    out = stored(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path")
                 .select("shard", "path", "sizes", "n", "conv_id", "ends").mapInArrow(_walker(shared), NODE), "nodes")
    done = out.where("node IS NULL")
    if not bones.parents:
        return done.select(*COLUMNS)
    shares = out.where("node IS NOT NULL").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        # One share at most has ids that end here.
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING))
        .alias("ends_sha256")).collect()
    whole = spark.createDataFrame(reduced(bones, shares), "node int, conv_id long, depth long, parent_conv_id long, "
                                  "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # As many rows as the skeleton that was broadcast.
    above = F.broadcast(whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above")))
    done = done.join(above, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return done.select(*COLUMNS).unionByName(whole.select(*COLUMNS))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
    WITH turn AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL),
    place AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos FROM turn),
    conv AS (
        SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
                string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % {TURNS} AS h
        FROM (SELECT DISTINCT conv_id FROM place)),
    again AS (
        SELECT c.conv_id, p.pos, p.digest, strlen(p.text) AS size FROM conv c JOIN place p ON p.conv_id = c.conv_id
        WHERE p.pos > c.h
        UNION ALL SELECT c.conv_id, p.pos, p.digest, strlen(p.text) FROM conv c
        JOIN place p ON p.conv_id = c.conv_id - c.conv_id % {GROUP} WHERE p.pos <= c.h),
    path AS (
        SELECT conv_id, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (digest IS NOT NULL), '') AS path,
            list(size ORDER BY pos) FILTER (digest IS NOT NULL) AS sizes
        FROM conv LEFT JOIN again USING (conv_id) GROUP BY conv_id),
    step AS (SELECT *, unnest(range(0, len(path) // 32 + 1)) AS depth FROM path),
    node AS (
        SELECT left(path, 32 * depth) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(any_value(sizes[depth]), 0) AS size,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = 32 * depth), ''))
                AS ends_sha256
        FROM step GROUP BY ALL),
    child AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
    one AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child USING (key)),
    below AS (
        SELECT left(key, 32 * up) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves,
            sum((n_convs - 1) * size) AS saved
        FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM one) GROUP BY ALL)
    SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children,
        CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, o.ends_sha256
    FROM one o JOIN below b ON b.key = o.key
    LEFT JOIN one p ON o.depth > 0 AND p.depth = o.depth - 1 AND p.key = left(o.key, 32 * (o.depth - 1))"""
