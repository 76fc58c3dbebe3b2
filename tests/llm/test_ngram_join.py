import random
import re

import pytest

from shelfline.llm import ngram_join
from shelfline.llm.ngram_join import ngram_components


def brute(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= width:
            sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)})
        else:
            sets.append({tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posts = {}
    for i, s in enumerate(sets):
        for t in s:
            posts.setdefault(t, []).append(i)
    pairs = {(a, b) for p in posts.values() for k, a in enumerate(p) for b in p[k + 1:]}
    for a, b in pairs:
        if rows[a][0] is not None and rows[b][0] is not None \
                and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, len(sets[i]), None if k is None else low[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = ngram_components(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, n int"))
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_small_cases(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["other"] + base[31:]
    chain = near[:10] + ["third"] + near[11:]
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(chain).upper()), (4, " ".join(base[:30])),
            (5, None), (6, ""), (7, "a b c"), (8, "A  b\tc "), (9, "a b c d"), (None, " ".join(base)), (1, " ".join(base)),
            (20, "a b c d e"), (21, "a b c d e f"), (22, "Été a b c d e"), (23, "été a b c d e")]
    rows += [(30 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(15 + i))) for i in range(12)]
    rows += [(60 + i, " ".join(base[:20]) + f" v{i} " + " ".join(f"z{k}" for k in range(60))) for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_row_without_id_comes_first(spark):
    """In one task, a text's first row has no doc_id; the text still posts its tokens."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:30] + ["other"] + base[31:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()),
                  key=str) == brute(rows)


def test_frequent_tokens_in_blocks(spark, monkeypatch):
    """Subsets and edits of one text, most of them in components of their own."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(90):
        words = base[rng.randint(0, 25):rng.randint(55, 80)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"x{k}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_and_frequent_tokens_together(spark, monkeypatch, seed):
    """Texts of shared and own blocks: similar pairs share some frequent tokens and some rare ones."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(seed)
    shared = [[f"b{j}_{i}" for i in range(20)] for j in range(5)]
    rows = []
    for k in range(0, 90, 3):
        blocks = rng.sample(shared, rng.randint(1, 4)) + [[f"o{k}_{i}" for i in range(rng.randint(10, 40))]]
        for copy in range(3):
            words = sum(blocks, [])
            for _ in range(copy + rng.randint(0, 1)):
                words[rng.randrange(len(words))] = f"x{k}_{copy}"
            rows.append((k + copy, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_common_passage_is_not_posted_again(spark, monkeypatch):
    """Near copies with one passage that all texts share: its tokens alone make no two texts similar."""
    monkeypatch.setattr(ngram_join, "HOT", 4)
    counts, store = {}, ngram_join.stored

    def counted(df, name):
        out = store(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    passage = " ".join(f"p{i}" for i in range(20))
    own = [[f"w{k}_{i}" for i in range(80)] for k in range(12)]
    rows = [(k, passage + " " + " ".join(w)) for k, w in enumerate(own)]
    rows += [(20 + k, passage + " " + " ".join(w[:40] + ["other"] + w[41:])) for k, w in enumerate(own)]
    assert run(spark, rows) == brute(rows)
    assert counts["frequent"] == 0


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("changed", [3, 4, 5])
def test_threshold(spark, changed):
    base = [f"w{i}" for i in range(104)]
    rows = [(k, " ".join(w if i % (100 // changed) != k else f"x{k}" for i, w in enumerate(base))) for k in range(5)]
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)
