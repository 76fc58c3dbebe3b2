import random
import re

import numpy as np
import pytest

from shelfline.llm import fm_index, substring_dedup


def brute(rows, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, split):
        for i in range(len(w) - window + 1 if k is not None else 0):
            g = tuple(w[i:i + window])
            least[g] = min(least.get(g, k), k)
    out = []
    for (k, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1 if k is not None else 0):
            if least[tuple(w[i:i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, mark int, found string")
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df.repartition(5), **kw).collect()), key=str)


def test_small_cases(spark):
    rng = random.Random(3)
    own = lambda k, n: [f"w{k}_{i}" for i in range(n)]
    passage = own("p", 60)
    junk = ["Orre"] * 200
    rows = [(k, " ".join(own(k, 20) + passage[rng.randint(0, 20):rng.randint(30, 60)] + own(-k, 5))) for k in range(2, 14)]
    rows += [(20, " ".join(passage[:13])), (21, " ".join(passage[:12])), (22, "\t".join(passage).upper()), (23, None),
             (24, ""), (25, " \n"), (None, " ".join(passage)), (26, " ".join(junk)), (27, " ".join(junk[:14])),
             (1, " ".join(passage)), (1, " ".join(passage)), (1, " ".join(passage[5:40] + own("x", 30))),
             (30, " ".join(own("long", 9000) + passage)), (31, " ".join(own("long", 9000)))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_segments=7) == brute(rows)
    assert run(spark, []) == []


def test_one_gram_in_very_many_contexts(spark, monkeypatch):
    """The segments of a frequent 5-gram of least hash are not one group; equal windows of them still meet."""
    rng = random.Random(7)
    grams = [[f"g{k}_{i}" for i in range(5)] for k in range(5000)]
    hashes = substring_dedup.window_hashes(substring_dedup.string_hashes(sum(grams, [])), 5)[::5]
    hot = grams[int(np.argmin(hashes))]
    near = [[f"n{k}_{i}" for i in range(8)] for k in range(6)]
    rows = []
    for k in range(150):
        left, right = ([f"u{k}_{i}{s}" for i in range(8)] for s in "lr")
        if k % 3 == 0:
            left, right = left[:rng.randint(0, 4)] + rng.choice(near)[:4], rng.choice(near)
        rows.append((k, " ".join(left + hot + right)))
    searcher = substring_dedup._searcher

    def small_groups(window):
        search = searcher(window)

        def checked(pdf):
            assert len(pdf) <= 60, f"{len(pdf)} segments in one group"
            return search(pdf)
        return checked
    monkeypatch.setattr(substring_dedup, "_searcher", small_groups)
    out = run(spark, rows, shard_segments=20, mark_segments=20)
    assert out == brute(rows) and any(r[2] for r in out)


@pytest.mark.parametrize("seed", range(2))
def test_few_words(spark, seed):
    """Texts over a tiny vocabulary share windows everywhere, also inside themselves."""
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices("ab", weights=[9, 1], k=rng.randint(0, 80)))) for k in range(40)]
    assert run(spark, rows, shard_segments=50) == brute(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert run(spark, rows) == want and any(r[2] for r in want)


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(50)]
    symbols = np.concatenate([np.r_[t, 0] for t in texts])
    index = fm_index.FmIndex(symbols, 12)
    for _ in range(100):
        pattern = rng.integers(1, 4, rng.integers(1, 5))
        low, high = np.array([0]), np.array([index.size])
        for c in pattern[::-1]:
            low, high = index.left(np.array([c]), low, high)
        want = sum((symbols[i:i + len(pattern)] == pattern).all() for i in range(len(symbols) - len(pattern) + 1))
        assert high[0] - low[0] == want
        assert all((symbols[i:i + len(pattern)] == pattern).all() for i in index.order[low[0]:high[0]])
