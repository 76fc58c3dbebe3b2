import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


def small(seed=0, hidden=3):
    net = toxicity.Network(seed, hidden)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def slow_odds(net, words, v):
    """A window's log-odds, word by word."""
    p, n = net.p, net.h
    x = net.inputs(v)
    sig = lambda a: 1 / (1 + np.exp(-a))

    def run(order, side):
        h, out = np.zeros(n), []
        for w in order:
            g = x[w] @ p[f"in_{side}"] + p[f"bias_{side}"]
            u = p[f"again_{side}"]
            z, r = sig(g[:n] + h @ u[:, :n]), sig(g[n:2 * n] + h @ u[:, n:2 * n])
            h = z * h + (1 - z) * np.tanh(g[2 * n:] + (r * h) @ u[:, 2 * n:])
            out.append(h)
        return out

    if not len(words):
        return p["bias"][0]
    states = np.array([np.concatenate([a, b]) for a, b in zip(run(words, "f"), run(words[::-1], "b")[::-1])])
    e = np.exp(states @ p["attention"])
    return (e / e.sum()) @ states @ p["out"] + p["bias"][0]


def test_windows_cover_all_words():
    lengths = np.array([0, 1, 32, 33, 48, 49, 1000])
    of, first, size = toxicity.windows(lengths)
    at = np.cumsum(lengths) - lengths
    for k, n in enumerate(lengths):
        mine = of == k
        covered = {i for a, s in zip(first[mine] - at[k], size[mine]) for i in range(a, a + s)}
        assert covered == set(range(n)) and mine.sum() >= 1
        assert all(s == toxicity.WIDTH for s in size[mine][:-1])


def test_network_against_word_by_word():
    texts = pa.array(["a b c d e f g " * 9, "", "one", None, "Ünder ümlaut " * 20])
    codes, lengths, different = toxicity.text_words(texts)
    v, net = toxicity.Vocabulary(different), small()
    of, first, size = toxicity.windows(lengths)
    got = net.log_odds(codes, net.gates(net.inputs(v)), first, size)
    want = [slow_odds(net, codes[a:a + n], v) for a, n in zip(first, size)]
    assert np.allclose(got, want, atol=1e-5)
    worst = [max(w for o, w in zip(of, want) if o == k) for k in range(len(texts))]
    assert np.allclose(toxicity.text_scores(net, texts), 1 / (1 + np.exp(-np.array(worst))), atol=1e-5)


def test_gradients():
    net = small(1)
    codes, lengths, different = toxicity.text_words(pa.array(["ab cde f gh ab", "x ab", "long word here and more"]))
    v = toxicity.Vocabulary(different)
    words, mask = toxicity.laid_out(codes, np.cumsum(lengths) - lengths, lengths)
    args = words, mask.astype(np.float64), v, np.array([1.0, 0, 1]), np.array([0.5, 0.2, 0.3])
    _, g = net.gradients(*args)
    whole = {k: np.zeros_like(x) for k, x in net.p.items()}
    for name, d in g.items():
        if name in ("words", "characters"):
            np.add.at(whole[name], v.words if name == "words" else v.rows, d)
        else:
            whole[name] += d
    rng = np.random.default_rng(0)
    for name, x in net.p.items():
        rows = {"words": v.words, "characters": v.rows}.get(name, np.arange(len(x)))
        for _ in range(4):
            i = (rng.choice(rows), *[rng.integers(s) for s in x.shape[1:]])
            x[i] += 1e-6
            up = net.gradients(*args)[0]
            x[i] -= 2e-6
            down = net.gradients(*args)[0]
            x[i] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(whole[name][i], rel=1e-4, abs=1e-8), name


def test_part_of_a_vocabulary():
    words = pa.array(["a", "abcdef", "xyz", "longer", "q"])
    v, some = toxicity.Vocabulary(words), np.array([3, 1, 4])
    part, want = v.part(some), toxicity.Vocabulary(words.take(pa.array(some)))
    assert all(np.array_equal(getattr(part, k), getattr(want, k)) for k in ("words", "rows", "owners", "counts"))


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "some text", 5), (3, "?!", 5), (4, "awful " * 30_000, 5), (5, "fine", 5),
         (5, "fine", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (5, 0, "x"), (None, 1, "x"), (1, 7, "x"), (2, None, "x")],
                                   "doc_id long, toxic int, text string")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(["1", "2", "None", "3", "4", "5", "5"])
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    score = {r.doc_id: r.score for r in out}
    assert score[1] == score[2] == score[3]
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.where("false"), none).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in out])
    toxic = [r.predicted for r in out if r.toxic == 1]
    assert len(out) > 50 and right >= 0.9 and np.mean(toxic) >= 0.6
