import math
import os
import random
import uuid

import numpy as np

from shelfline.llm import masked_lm as lm


def by_hand(m, codes):
    """Token by token, with plain loops over classes."""
    total = 0.0
    classes = [int(m.of_code[c]) for c in codes]
    for i, c in enumerate(codes):
        hidden = [float(x) for x in m.hidden]
        for p, place in enumerate(lm.PLACES):
            j = i + place
            near = classes[j] if 0 <= j < len(codes) else lm.CLASSES
            hidden = [h + float(x) for h, x in zip(hidden, m.inputs[p, near])]
        h = np.tanh(hidden)
        logits = [float(h @ m.output[:, k]) + float(m.bias[k]) for k in range(lm.CLASSES)]
        total += logits[classes[i]] - math.log(sum(map(math.exp, logits))) + float(m.within[c])
    return total


def test_scores_equal_plain_loops_and_order_matters(spark):
    rng = random.Random(0)
    cycle = [f"t{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(rng.randint(0, 11) + k) % 12] if k < 0 else cycle[(i + k) % 12] for k in range(60)))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "t1 t2 t3"), (0, rows[0][1]), (1002, "New words only"),
             (1003, " ".join(cycle * 2000)), (1004, " ".join(rng.sample(cycle * 5, 60)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, codes string").repartition(4)
    codes = lm.encode(docs)
    m = lm.fit(codes)
    out = {r.doc_id: r for r in lm.score(codes, m).collect()}
    assert lm.score(codes, m).count() == len(rows)
    assert (out[1000].n_tokens, out[1000].log_prob, out[1000].per_token) == (0, 0.0, None) and out[1001].n_tokens == 0
    for r in codes.where("doc_id IN (3, 1002, 1004) OR doc_id IS NULL").collect():
        assert abs(out[r.doc_id].log_prob - by_hand(m, r.codes)) < 1e-3
    # Trained on the cycle, both sides predict its tokens far better than chance; a shuffled text scores lower.
    assert out[5].per_token > math.log(1 / 12) + 0.7 and out[5].per_token > out[1004].per_token + 1
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_gradient():
    rng = np.random.default_rng(1)
    m = lm.started(rng.integers(0, 9, lm.BUCKETS).astype(float))
    around, target = rng.integers(0, lm.CLASSES + 1, (40, len(lm.PLACES))), rng.integers(0, lm.CLASSES, 40)
    loss = lambda x: -x_log(x, around, target)
    before = loss(m)
    squares = [np.zeros_like(x) for x in (m.inputs, m.hidden, m.output, m.bias)]
    for _ in range(60):
        lm.trained(m, around, target, squares)
    assert loss(m) < before / 2


def test_each_token_is_a_target_once(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(k, " ".join(f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 400)))) for k in range(20)]
    codes = lm.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    targets, trained = str(tmp_path), lm.trained

    def noted(m, around, target, squares):
        with open(os.path.join(targets, uuid.uuid4().hex), "w") as f:
            f.write(str(len(target)))
        trained(m, around, target, squares)

    monkeypatch.setattr(lm, "trained", noted)
    lm.fit(codes)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == sum(len(t.split()) for _, t in rows)
    flat = np.random.default_rng(0).integers(0, lm.BUCKETS, 5000)
    for rounds in (1, 2, lm.ROUNDS):
        places = np.concatenate([lm.masked_in(flat, k, rounds) for k in range(rounds)])
        assert (np.sort(places) == np.arange(5000)).all()


def x_log(m, around, target):
    return lm.forward(m, around)[1][np.arange(len(target)), target].mean()
