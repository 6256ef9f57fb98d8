import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.functions import boxes as B
from detframe.functions.arrays import assign_limited, assign_min_cost, max_matching_pairs, pairwise_iou


def test_rotation_and_flip(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 60.0)], "x1 double, y1 double, x2 double, y2 double")
    turned = df.select(*[F.round(c, 6) for c in B.rotate(B.box(), 50.0, 50.0, 90.0)]).first()
    assert tuple(turned) == (40.0, 10.0, 80.0, 30.0)
    assert tuple(df.select(*B.flip(B.box(), "horizontal", F.lit(100.0), F.lit(80.0))).first()) == (70.0, 20.0, 90.0, 60.0)


def test_giou_of_apart_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 2.0, 0.0, 3.0, 1.0)], ", ".join(f"{p}{c} double" for p in "ab" for c in B.COORDS))
    row = df.select(B.iou(B.box("a"), B.box("b"), "giou").alias("g"), B.iou(B.box("a"), B.box("b")).alias("i")).first()
    assert row.i == 0.0
    assert row.g == pytest.approx(-1 / 3)


def brute(cost):
    from itertools import permutations
    n, m = cost.shape
    if n > m:
        return brute(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (4, 6)])
def test_assignment_against_all_permutations(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(30):
        cost = rng.normal(size=shape)
        i, j = assign_min_cost(cost)
        assert len(set(i)) == len(set(j)) == min(shape)
        assert cost[i, j].sum() == pytest.approx(brute(cost))


def test_limited_assignment_leaves_dear_pairs_open():
    i, j = assign_limited(np.array([[0.1, 0.9], [0.2, 0.95]]), 0.5)
    assert (list(i), list(j)) == ([0], [0])


def test_maximum_matching():
    rng = np.random.default_rng(5)
    for _ in range(30):
        allowed = rng.random((5, 5)) < 0.35
        left, right = np.nonzero(allowed)
        if not len(left):
            continue
        a, b = max_matching_pairs(left, right)
        assert len(set(a)) == len(set(b)) == len(a)
        assert allowed[a, b].all()
        assert len(a) == round(-brute(-allowed.astype(float)))


def test_pairwise_iou():
    a = np.array([[0, 0, 2, 2.0]])
    assert pairwise_iou(a, np.array([[1, 1, 3, 3.0]]))[0, 0] == pytest.approx(1 / 7)
