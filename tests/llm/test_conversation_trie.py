import hashlib
import zlib

import numpy as np
import pytest

from shelfline.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in turns.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(first, [])[:h] + x[h:])
    members, ends = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
        ends.setdefault(p, []).append(c)
    children, leaves, saved = {p: 0 for p in members}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -10**9, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                  for p, m in members.items())


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    out = conversation_trie.prefix_trie(df, **kw)
    return sorted(tuple(-10**9 if x is None else x for x in r) for r in out.select(*conversation_trie.COLUMNS).collect())


def talks(seed, n, words=3, copies=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        same = c < copies
        for t in range(6 if same else rng.integers(1, 9)):
            out.append((c, t, ["user", "assistant", None][0 if same else rng.integers(3)],
                        "same é" if same else ["", "a", "bb", "ünï"][rng.integers(words)]))
    return out


def test_small_cases(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "there"), (1, None, None, None), (1, 0, "user", "hi"),
            (1, 0, "user", "hi"), (5, 3, "user", "a"), (None, 0, "user", "lost"), (-3, 0, "user", "minus"),
            (-5, 0, "user", "five"), (7, 0, "", ""), (7, 1, "", "x" * 100_000), (10, 0, "us", "er"), (11, 0, "use", "r")]
    for size in (20_000, 3, 1):
        assert run(spark, rows, shard_turns=size) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []


@pytest.mark.parametrize("size", [20_000, 200, 31, 4])
def test_any_shards(spark, size):
    rows = talks(size, 150)
    assert run(spark, rows, shard_turns=size) == brute(rows)


def test_copies_and_a_long_conversation(spark):
    rows = talks(3, 200, copies=90) + [(1000, t, "user", f"t{t % 7}") for t in range(160)] + \
        [(1001, t, "user", f"t{t % 7}") for t in range(150)]
    assert run(spark, rows, shard_turns=100) == brute(rows)


def test_skeleton_is_the_nodes_in_several_shards(spark):
    step = lambda *k: b"".join(bytes([i]) * conversation_trie.STEP for i in k)
    bones = conversation_trie.skeleton([(step(1), step(2, 3, 4)), (step(2, 3, 5), step(2, 4)), (step(9), step(9))])
    assert sorted(bones.depths) == [0, 1, 2]
    assert conversation_trie.skeleton([(step(1), step(2))]).parents == []
