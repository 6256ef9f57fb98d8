import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators.similarity import similar
from detframe.operators.table_metrics import retrieval_scores


@pytest.mark.parametrize("method", ["dot", "cosine", "softmax"])
@pytest.mark.parametrize("block_rows", [4, 2048])
def test_best_partners_match_the_full_matrix(spark, method, block_rows):
    rng = np.random.default_rng(2)
    rows = {(g, side): rng.normal(size=(n, 3)) for g in (0, 1) for side, n in (("q", 9), ("g", 14))}
    rows[0, "g"][3] = rows[0, "g"][8]  # a tie
    made = {side: spark.createDataFrame([(g, 100 * g + i, v.tolist()) for (g, s), m in rows.items() if s == side for i, v in enumerate(m)]
                                        + [(0, None, [1.0, 1.0, 1.0]), (1, 999, None)], "g long, id long, embedding array<double>") for side in "qg"}
    got = {(r.g, r.id, r["rank"]): (r.partner, r.score) for r in similar(made["q"], made["g"], 3, method, 0.5, ["g"], block_rows).collect()}
    want = {}
    for g in (0, 1):
        a, b = rows[g, "q"], rows[g, "g"]
        if method == "cosine":
            a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        x = a @ b.T / 0.5
        if method == "softmax":
            e = np.exp(x)
            x = (e / e.sum(axis=1, keepdims=True) + e / e.sum(axis=0, keepdims=True)) / 2
        for i, row in enumerate(np.round(x, 9)):
            for r, j in enumerate(np.lexsort((np.arange(len(row)), -row))[:3]):
                want[g, 100 * g + i, r + 1] = (100 * g + int(j), pytest.approx(row[j], abs=1e-8))
    assert got == want


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert similar(some, some.limit(0), 2).count() == 0 and similar(some.limit(0), some, 2, "softmax").count() == 0


def ranked_scores(rows, top_ks):
    """Every query against every row, sorted."""
    aps, firsts = [], []
    for i, label, e in rows:
        far = sorted((sum((a - b) ** 2 for a, b in zip(e, f)), other != label) for j, other, f in rows if j != i)
        hits = [(k, sum(d < v for d, _ in far) + 1) for k, v in enumerate((d for d, strange in far if not strange), 1)]
        if hits:
            aps.append(sum(k / rank for k, rank in hits) / len(hits))
            firsts.append(hits[0][1])
    return sum(aps) / len(aps), *[sum(f <= k for f in firsts) / len(firsts) for k in top_ks]


def test_retrieval_of_a_hot_label_in_small_packs(spark):
    rng = np.random.default_rng(5)
    # two thirds share a label, whole coordinates make many ties, and some rows are equal
    rows = [(int(i), int(rng.choice([0, 0, 1, 2, 3])) if i else 99, [float(x) for x in rng.integers(0, 3, 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    want = ranked_scores(rows, (1, 5))
    for block_rows, pack in ((1000, 10**6), (20, 10**6), (20, 40), (13, 1)):
        got = retrieval_scores(df, (1, 5), block_rows=block_rows, pack=pack).first()
        assert (got["map"], got.r1, got.r5) == pytest.approx(want, abs=1e-12), (block_rows, pack)


def test_retrieval_of_some_queries_against_all_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 7 == 3 else int(rng.choice([0, 0, 0, 1, 5])), [float(x) for x in rng.integers(0, 3, 2)]) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, 1, None)], "id long, label long, embedding array<float>")
    scores = []
    for i, label, e in rows:
        if i % 5 or label is None:
            continue
        far = sorted((sum((a - b) ** 2 for a, b in zip(e, f)), other != label) for j, other, f in rows if j != i)
        hits = [(k, sum(d < v for d, _ in far), sum(d <= v for d, s in far if not s), sum(d < v for d, s in far if not s)) for k, v in enumerate((d for d, s in far if not s), 1)]
        scores.append((sum((c + (t - c + 1) / 2) / (n + 1) for _, n, t, c in hits) / len(hits), hits[0][1] < 1))
    for pack, block_rows in ((10**6, 64), (100, 7), (1, 200)):
        got = retrieval_scores(df, (1,), block_rows, pack, asked=F.col("id") % 5 == 0).first()
        assert (got["map"], got.r1) == pytest.approx(tuple(np.mean(scores, axis=0)), abs=1e-12), pack


def test_blocks_follow_the_largest_key(spark):
    # 200 keys of 3 rows: no key needs a second block, so no vector is copied
    rows = [(k, 3 * k + i, [float(i), 1.0]) for k in range(200) for i in range(3)]
    df = spark.createDataFrame(rows, "g long, id long, embedding array<float>")
    out = similar(df, df, 1, "dot", keys=["g"], block_rows=3)
    assert out.count() == 600
    assert not re.search(r"explode\(\[0,", out._jdf.queryExecution().optimizedPlan().toString().replace(" ", ""))
