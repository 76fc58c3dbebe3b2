import zlib

import numpy as np
import pyarrow as pa

from shelfline.llm import quality

SCHEMA = "doc_id long, text string, score string, quality string"


def corpus(n=600):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, 40))
        good = i % 5 > 0
        rows.append((i, " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, "Word1x word2x."), (1002, "x" * 100_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (2000, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, marks, 200)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), marks)).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, marks.limit(0))).collect()} == {0.5}


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in quality.score(docs, quality.fit(
        docs, spark.createDataFrame(x, "doc_id long, quality int"))).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_votes_equal_brute_force():
    rows, labels = corpus(200)
    text = pa.array([t for _, t in rows])
    r, t, c = quality.bags(text)
    model = quality.fitted(r, t, c, np.array([y for _, y in labels], float))
    got = model.score(text, block=7)
    x = model.project(text)
    for i in range(len(rows)):
        cosines = model.vectors @ x[i]
        near = np.argsort(-cosines)[:quality.NEIGHBOURS]
        w = np.maximum(cosines[near], 0).astype(float) ** quality.POWER
        ties = np.isclose(cosines, cosines[near[-1]], atol=1e-6).sum() > 1
        if not ties:
            assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-4
