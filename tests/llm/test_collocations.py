import re
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import collocations


def brute(rows, least=10, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, g), a in found.items():
        if len(g) == 3:
            for part in (g[:2], g[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = {}
    for (lang, g), a in found.items():
        if len(g) == 2 and (lang, g) in longer and 100 * longer[lang, g] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, lr, r, n[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, lr, r) in enumerate(sorted(x)[:first]))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "lang string, text string, n int, w1 string")
    out = collocations.collocations(df.repartition(3), **kw)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, words, documents, length):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "The", "the", "a\x00b"]
    marks = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!?", " "]
    out = []
    for k in range(documents):
        w = rng.choice(vocabulary, rng.integers(0, length), p=_share(len(vocabulary)))
        out.append((rng.choice(["en", "de", None, ""]), "".join(x + rng.choice(marks) for x in w)))
    return out


def _share(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


def test_small_cases(spark):
    rows = [("en", "New York City. New York city, new york!" * 6), ("en", None), (None, "a b c " * 12), ("de", ""),
            ("fr", ".,;:!?"), ("en", "x y\x0bz " * 11), ("es", "solo " * 5), ("es", "a b " * 10), ("es", "a b " * 10)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [("en", "a b")]) == []


@pytest.mark.parametrize("burst, spill, size", [(4, 20, 64), (50, 300, 1 << 20), (1 << 16, 3 << 20, 1 << 20)])
def test_any_sizes(spark, monkeypatch, burst, spill, size):
    rows = texts(burst, 40, 150, 120)
    monkeypatch.setattr(collocations, "SLICE", size)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows, burst=burst, spill=spill) == want
    assert run(spark, rows, first=7) == brute(rows, first=7)


def test_frequent_pair(spark):
    rows = [("en", " ".join(f"the same v{i % 37}" for i in range(k, k + 60))) for k in range(120)]
    assert run(spark, rows, burst=64, spill=500) == brute(rows)


def test_long_text_and_ids_that_run_out(spark, monkeypatch):
    rows = [("en", " ".join(f"w{i % 5000} v{i % 7}" for i in range(60_000)))]
    want = brute(rows)
    assert run(spark, rows) == want
    counter = collocations.Counter("en", 2, None, burst=16)
    monkeypatch.setattr(collocations, "ID_BITS", 6)
    monkeypatch.setattr(collocations, "SLICE", 30)
    words, piece = collocations.tokens(__import__("pyarrow").array([rows[0][1][:4000]]))
    total = Counter()
    for run_ in [*counter.add(words, piece), *counter.spilled(0)]:
        pairs = list(zip(run_["w1"].to_pylist(), run_["w2"].to_pylist()))
        assert pairs == sorted(pairs, key=lambda p: (p[0].encode(), p[1].encode()))
        total.update(dict(zip(pairs, run_["n"].to_pylist())))
    w = words.to_pylist()
    assert total == Counter(zip(w, w[1:]))


def test_exact_scores(spark):
    a, left, right = 10**15 + 7, 10**15 + 9, 10**15 + 11
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)
