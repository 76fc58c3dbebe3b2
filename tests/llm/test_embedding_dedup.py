import numpy as np
import pytest

from shelfline.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, block int"


def brute(rows, threshold=0.93):
    n = len(rows)
    fine = [k is not None and v is not None and lab is not None and len(v) > 0 and all(
        x is not None and np.isfinite(np.float32(x)) for x in v) and any(v) for k, v, lab in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float32).astype(np.float64) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    low = {}
    for i, r in enumerate(rows):
        if fine[i]:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    comp = [low[find(i)] if fine[i] else r[0] for i, r in enumerate(rows)]
    return sorted(((r[0], links[i], comp[i], r[0] is not None and r[0] == comp[i]) for i, r in enumerate(rows)), key=str)


def run(spark, rows, block=dedup.BLOCK):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in dedup.near_duplicates(df, block=block).collect()), key=str)


def test_small_cases(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 0), (2, [2.0, 0.0, 0.0], 0), (3, e, 0), (4, e, 1), (5, e, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0),
            (8, [1.0, None, 0.0], 0), (9, [float("nan"), 1.0, 0.0], 0), (10, [float("inf"), 1.0, 0.0], 0),
            (None, e, 0), (11, [1.0, 0.39, 0.0], 0), (12, [1.0, 0.8, 0.0], 0), (13, [], 0), (14, [1.0, 0.0], 0),
            (1, e, 0), (15, [1e-30, 0.0, 0.0], 0), (16, [3e38, 1e38, 0.0], 0), (17, [-1.0, 0.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_blocks(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((12, dim))
    rows = [(i, (centres[i % 12] + rng.standard_normal(dim) * 0.3 * (i % 5)).tolist(), i % 2) for i in range(160)]
    assert run(spark, rows, block=30) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 64))
    v = base + rng.standard_normal((300, 64)) * 0.4
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (base, v))
    value, width = dedup.Codes(u).estimates(dedup.Codes(w), slice(0, 300))
    error = value - w @ u.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= width).mean() > 0.999


def test_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    assert run(spark, rows) == brute(rows)
