import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from detframe.llm import attention, lmscore
from detframe.llm.common import documents

SCHEMA = T.StructType([T.StructField("score", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])


def brute_base(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if i is not None and not held(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    return {i: (held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total,
                pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)), rel=1e-9)) for i, t in rows}


def check(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    want = brute_base([r for r in rows])
    for r in got:
        if r.doc_id is not None:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == want[r.doc_id]
        assert math.isfinite(r.score) and r.score < 0
    return got


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    params = {k: x.astype(np.float64) for k, x in attention.fresh(np.full(attention.CLASSES, 1 / attention.CLASSES)).items()}
    params["r"] += rng.normal(size=attention.WIDTH)
    inputs, targets = rng.integers(0, attention.CLASSES + 1, (3, attention.WIDTH)), rng.integers(0, attention.CLASSES, (3, attention.SPAN))
    weights = (rng.random((3, attention.SPAN)) < 0.8).astype(float)
    _, grad = attention.loss_and_gradient(params, inputs, targets, weights)
    for name, x in params.items():
        for at in rng.choice(x.size, 6):
            place = np.unravel_index(at, x.shape)
            moved = []
            for step in (1e-5, -1e-5):
                x[place] += step
                moved.append(attention.loss_and_gradient(params, inputs, targets, weights)[0])
                x[place] -= step
            assert grad[name][place] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_each_token_is_scored_once_with_its_own_past():
    rng = np.random.default_rng(4)
    params = attention.fresh(rng.dirichlet(np.ones(attention.CLASSES)))
    sizes = np.array([1, 15, 16, 17, 50])
    kinds = rng.integers(0, attention.CLASSES, sizes.sum()).astype(np.uint8)
    windows, scorer = attention.Windows(kinds, sizes), attention.Scorer(params)
    inputs, targets, used = windows.take(np.arange(len(windows.owner)))
    assert used.sum() == sizes.sum()
    got = scorer.log10(inputs, targets)
    plain = []
    for x, y in zip(inputs, targets):
        row = []
        for i, t in zip(range(attention.WIDTH - attention.SPAN, attention.WIDTH), y):
            h = params["E"][x[:i + 1]]
            a = (h @ params["K"]) @ (h[-1] @ params["Q"]) / math.sqrt(attention.DIM)
            a = np.exp(a - a.max())
            z = (h[-1] + (a / a.sum()) @ (h @ params["V"]) @ params["O"]) @ params["U"] + params["b"]
            row.append((z[t] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10))
        plain.append(row)
    assert np.allclose(got, plain, atol=1e-4)
    assert sorted(targets[used].tolist()) == sorted(kinds.tolist())


def test_classes_are_a_distribution():
    counts = np.random.default_rng(1).integers(0, 50, 5000)
    kind, within, shares = attention.classes_of(counts)
    assert np.bincount(kind, weights=10.0 ** within, minlength=attention.CLASSES) == pytest.approx(1) and shares.sum() == pytest.approx(1)


def test_whole_table_learns(spark, sf):
    docs = documents(spark, sf.replace("sf0.001", "sf0.01"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(lmscore.scored(docs), rows)
    held = [r for r in got if r.held_out]
    untrained = {r.doc_id: r.score for r in lmscore.scored(docs, rounds=0).collect()}
    # the base gives all unknown words one share, so the model, which spells them, is held against its own start
    assert sum(r.score for r in held) > 0.95 * sum(untrained[r.doc_id] for r in held)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 60)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "One two ONE", "É é x\x0by", "z " * 5000, "one", "two three four five six seven eight nine ten"])]
    rows += [(i, "again and again") for i in range(20, 40)] + [(None, "never seen elsewhere")]
    check(lmscore.scored(spark.createDataFrame([("c", i, t, "d") for i, t in rows], SCHEMA).repartition(3)), rows)
    assert lmscore.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = lmscore.scored(spark.createDataFrame([("c", None, "x", "d")], SCHEMA)).collect()
    assert alone[0].train_tokens == 0 and alone[0].base_score == 0


def test_every_window_of_a_document_is_trained_on_once():
    sizes = np.array([1, 16, 17, 300, 4000])
    windows = attention.Windows(np.zeros(sizes.sum(), np.uint8), sizes)
    draw = lmscore.dealt(lmscore._spread(np.arange(len(sizes))), windows, lmscore.RATE * lmscore.ROUNDS)
    assert (draw < lmscore.ROUNDS).all()
    for owner, n in enumerate(-(-sizes // attention.SPAN)):
        turns = np.bincount(draw[windows.owner == owner].astype(int), minlength=lmscore.ROUNDS)
        assert turns.sum() == n and (n == 1 or turns.max() - turns.min() <= 1)


def test_a_training_step_works_in_blocks(monkeypatch):
    """A step of 256 windows must not lay out their logits, nor pairs of places, all at once; the blocks change nothing."""
    rng = np.random.default_rng(3)
    params = attention.fresh(rng.dirichlet(np.ones(attention.CLASSES)))
    inputs, targets = rng.integers(0, attention.CLASSES + 1, (250, attention.WIDTH)), rng.integers(0, attention.CLASSES, (250, attention.SPAN))
    weights = (rng.random((250, attention.SPAN)) < 0.9).astype(np.float32)
    attention.loss_and_gradient(params, inputs, targets, weights)
    tracemalloc.start()
    loss, grad = attention.loss_and_gradient(params, inputs, targets, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    monkeypatch.setattr(attention, "BLOCK", 250)
    whole, same = attention.loss_and_gradient(params, inputs, targets, weights)
    assert loss == pytest.approx(whole, rel=1e-6)
    for name in grad:
        assert grad[name].dtype == np.float32 and np.allclose(grad[name], same[name], atol=1e-6)


def test_far_apart_weights_stay_finite():
    params = attention.fresh(np.full(attention.CLASSES, 1 / attention.CLASSES))
    params["Q"] *= np.float32(300)
    params["r"] = np.linspace(-200, 200, attention.WIDTH).astype(np.float32)
    windows = attention.Windows(np.arange(500, dtype=np.uint8) % attention.CLASSES, np.array([500]))
    inputs, targets, used = windows.take(np.arange(len(windows.owner)))
    loss, grad = attention.loss_and_gradient(params, inputs, targets, used.astype(np.float32))
    assert math.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())
    assert np.isfinite(attention.Scorer(params).log10(inputs, targets)).all()
