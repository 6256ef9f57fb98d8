import numpy as np
import pytest

from detframe.operators import similarity as SM
from detframe.queries import metrics, similarity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve vectors in two labels; no id is divisible by 50."""
    path = tmp_path_factory.mktemp("vectors")
    rows = [(7 * i + 3, [float(i), 1.0, float(i % 3)], i % 2) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_every_row_asks_for_retrieval(spark, folder):
    row = metrics.retrieval_scores(spark, folder).first()
    assert row["map"] is not None and row.r10 == 1.0
    assert "% 50" not in metrics.RETRIEVAL_SQL


def test_every_row_asks_for_cosine_partners(spark, folder):
    rows = similarity.cosine_partners(spark, folder).collect()
    assert {r.id for r in rows} == {7 * i + 3 for i in range(12)} and len(rows) == 36
    assert "% 50" not in similarity.COSINE_SQL


def test_every_row_asks_for_softmax_partners(spark, folder):
    rows = similarity.softmax_partners(spark, folder).collect()
    assert {r.id for r in rows} == {7 * i + 3 for i in range(12)} and len(rows) == 24
    assert "% 50" not in similarity.SOFTMAX_SQL


@pytest.mark.parametrize("k", [1, 3, 40])
def test_few_best_scores_of_a_tile_hold_all_ties(k):
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(30, 1000)), 2) + rng.integers(0, 2, (30, 1000)) * 1e-11
    scores[3], scores[4, 7], scores[5, 900:] = 0.0, np.nan, np.inf
    for part in (scores, np.delete(scores, 4, axis=0)):
        at, to = SM._best_few(part, k)
        for i, row in enumerate(np.round(part, SM.DIGITS)):
            want = np.lexsort((np.arange(1000), -row))[:k]
            held = to[at == i]
            assert list(held[np.lexsort((held, -row[held]))][:k]) == list(want)
