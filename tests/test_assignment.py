import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.functions.arrays import assign_limited, assign_min_cost, assign_sparse, max_matching_pairs
from detframe.operators import assignment as A
from detframe.operators.geometry import match_in_steps
from detframe.plans.components import pair_components


def test_sparse_solver_equals_the_dense_one():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n, m = rng.integers(1, 10, 2)
        matrix, there = rng.random((n, m)), rng.random((n, m)) < rng.choice([0.2, 0.6, 1])
        if trial % 2:
            matrix = np.round(matrix * 4) / 4
        limit = rng.choice([0.3, 0.7, 1.0])
        full = np.where(there, matrix, 9.0)
        i, j = assign_limited(full, limit)
        a, b = np.nonzero(there)
        got = assign_sparse(a, b, limit - matrix[a, b])
        assert len(set(a[got])) == len(set(b[got])) == len(got)
        assert (limit - matrix[a, b])[got].sum() == pytest.approx((limit - full[i, j]).sum(), abs=1e-9)


def groups(seed, sizes, share):
    rng = np.random.default_rng(seed)
    rows, dense = [], {}
    for g, n in enumerate(sizes):
        m = n + int(rng.integers(-2, 3))
        matrix, there = np.round(rng.random((n, m)), 3), rng.random((n, m)) < share
        dense[g] = np.where(there, matrix, 9.0)
        rows += [(g, int(a) + 100, int(b) + 500, float(matrix[a, b])) for a, b in np.argwhere(there)]
    return rows, dense


@pytest.mark.parametrize("pair_limit, component_limit", [(10_000, None), (5, 10_000), (5, 8)])
def test_total_cost_equals_the_dense_solver(spark, pair_limit, component_limit):
    rows, dense = groups(3, (5, 12, 9) if component_limit != 8 else (4, 3), 0.4)
    frame = spark.createDataFrame(rows, "image_id long, a_id long, b_id long, cost double")
    got = A.least_cost_pairs(frame, ["image_id"], limit=0.8, pair_limit=pair_limit, component_limit=component_limit, resolution=1e-3).collect()
    for g, matrix in dense.items():
        mine = [r for r in got if r.image_id == g]
        assert len({r.a_id for r in mine}) == len({r.b_id for r in mine}) == len(mine)
        assert all(matrix[r.a_id - 100, r.b_id - 500] == r.cost for r in mine)
        i, j = assign_limited(matrix, 0.8)
        assert sum(0.8 - r.cost for r in mine) == pytest.approx((0.8 - matrix[i, j]).sum(), abs=1e-9)


def test_without_limit_most_pairs_come_first(spark):
    rows, dense = groups(5, (6, 8, 3), 0.4)
    frame = spark.createDataFrame(rows, "image_id long, a_id long, b_id long, cost double")
    for limit in (10_000, 3):
        got = A.least_cost_pairs(frame, ["image_id"], pair_limit=limit, component_limit=10_000).collect()
        for g, matrix in dense.items():
            mine = [r for r in got if r.image_id == g]
            a, b = np.nonzero(matrix < 9)
            assert len(mine) == len(max_matching_pairs(a, b)[0])
            i, j = assign_min_cost(np.where(matrix < 9, matrix, 1000.0))
            assert sum(r.cost for r in mine) == pytest.approx(matrix[i, j][matrix[i, j] < 9].sum(), abs=1e-9)
    assert A.least_cost_pairs(frame.limit(0), ["image_id"]).count() == 0


def test_components_match_a_walk(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), int(a), int(b)) for k in range(2) for a, b in rng.integers(0, 60, (50, 2))] + [(2, i, i + d) for i in range(40) for d in (0, 1)]
    want = {}
    for k, a, _ in rows:
        seen, stack = {a}, [a]
        while stack:
            now = stack.pop()
            rights = {b for q, x, b in rows if q == k and x == now}
            more = {x for q, x, b in rows if q == k and b in rights} - seen
            seen |= more
            stack += more
        want[k, a] = min(seen)
    got = pair_components(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], "a", "b").select("k", "a", "component").distinct().collect()
    assert {(r.k, r.a): r.component for r in got} == want
    assert pair_components(spark.createDataFrame([], "k long, a long, b long"), ["k"], "a", "b").agg(F.count("*")).first()[0] == 0


def test_matching_index_equals_a_dense_twin(spark):
    from detframe.functions.arrays import pairwise_iou
    from detframe.operators.greedy import max_matching_index

    rng = np.random.default_rng(7)
    gt, det = [], []
    for im in range(6):
        for k in range(8):
            x, y = rng.integers(0, 40, 2)
            gt.append((im * 100 + k, im, float(x), float(y), float(x + 20), float(y + 20), int(k > 5)))
        for k in range(9):
            x, y = np.array(gt[im * 8 + int(rng.integers(8))][2:4]) + rng.integers(-5, 6, 2)
            det.append((im * 100 + k, im, float(x), float(y), float(x + 20), float(y + 20), float(rng.random())))
    g = spark.createDataFrame(gt, "ann_id long, image_id long, x1 double, y1 double, x2 double, y2 double, ignore int")
    d = spark.createDataFrame(det, "det_id long, image_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = {r.score_thr: r.ji for r in max_matching_index(d, g, [0.0, 0.4]).collect()}
    for thr in (0.0, 0.4):
        values = []
        for im in range(6):
            real = np.array([r[2:6] for r in gt if r[1] == im and not r[6]])
            void = np.array([r[2:6] for r in gt if r[1] == im and r[6]])
            mine = np.array([r[2:6] for r in det if r[1] == im and r[6] > thr])
            excused = [(pairwise_iou(x, void, "iof") > 0.5).any(axis=1).astype(float) for x in (mine, real)]
            over = pairwise_iou(mine, real) >= 0.5
            i, j = assign_min_cost(np.where(over, excused[0][:, None] + excused[1][None] - 1000, 0))
            hit = over[i, j]
            k = int(hit.sum())
            n = int((1 - excused[0]).sum() + excused[0][i[hit]].sum())
            m = int((1 - excused[1]).sum() + excused[1][j[hit]].sum())
            if m or n:
                values.append(k / (m + n - k + 1e-6))
        assert got[thr] == pytest.approx(np.mean(values), abs=1e-9)


def best_total(weights, n, m):
    """Greatest total over all partial one-to-one matchings, by trying them."""
    best = 0
    for take in itertools.product([None, *range(m)], repeat=n):
        used = [j for j in take if j is not None]
        if len(used) == len(set(used)) and all((i, j) in weights for i, j in enumerate(take) if j is not None):
            best = max(best, sum(weights[i, j] for i, j in enumerate(take) if j is not None))
    return best


def test_steps_by_overlap_then_by_center(spark):
    rng = np.random.default_rng(8)
    truth, pred, common = [], [], {}
    for image in range(12):
        truth += [(image, i, *map(float, rng.integers(0, 40, 2))) for i in range(3)]
        pred += [(image, j, *map(float, rng.integers(0, 40, 2))) for j in range(4)]
        if image % 3:
            common.update({(image, i, j): int(rng.integers(1, 30)) for i in range(3) for j in range(4) if rng.random() < 0.5})
    t, p = spark.createDataFrame(truth, "image_id long, a_id long, cx double, cy double"), spark.createDataFrame(pred, "image_id long, b_id long, cx double, cy double")
    o = spark.createDataFrame([(*k, v) for k, v in common.items()], "image_id long, a_id long, b_id long, n long")
    at = {(k, "a", i): (x, y) for k, i, x, y in truth} | {(k, "b", j): (x, y) for k, j, x, y in pred}

    def far(k, i, j):
        return math.dist(at[k, "a", i], at[k, "b", j])
    anywhere = [r for r in match_in_steps(t, p, o, 1000.0).collect() if r.step == "overlap"]
    for k in range(12):
        mine = {(i, j): n for (image, i, j), n in common.items() if image == k}
        assert sum(mine[r.a_id, r.b_id] for r in anywhere if r.image_id == k) == best_total(mine, 3, 4)
    got = match_in_steps(t, p, o, 15.0).collect()
    kept = {(r.image_id, r.a_id, r.b_id) for r in anywhere if far(r.image_id, r.a_id, r.b_id) <= 15}
    assert {(r.image_id, r.a_id, r.b_id) for r in got if r.step == "overlap"} == kept and len(kept) > 3
    want = set()
    for k in set(range(12)) - {k for k, *_ in kept}:
        nearest = sorted((min((far(k, i, j), j) for j in range(4)), i) for i in range(3))
        taken = set()
        for (d, j), i in nearest:
            if d <= 15 and j not in taken:
                taken.add(j)
                want.add((k, i, j))
    assert {(r.image_id, r.a_id, r.b_id) for r in got if r.step == "center"} == want and len(want) > 3
    assert match_in_steps(t.limit(0), p, o.limit(0), 15.0).count() == 0


def test_matching_index_of_whole_images_equals_the_joins(spark, sf):
    from detframe.operators.greedy import max_matching_index
    from detframe.queries import tables as T

    gt = T.gt(spark, sf).withColumn("ignore", F.col("iscrowd") == 1)
    whole, joined = ({r.score_thr: r.ji for r in max_matching_index(T.det(spark, sf), gt, [0.0, 0.4, 0.9], limit=n).collect()} for n in (20_000, 0))
    assert len(whole) == 3 and whole == pytest.approx(joined, abs=1e-12)
