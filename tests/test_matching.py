"""Distributed rules against sequential twins on random boxes, with limits small enough to force every path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.functions.arrays import pairwise_iou
from detframe.operators import coco_metrics as C
from detframe.operators import suppression as S
from detframe.operators.average_precision import average_precision, count_boxes
from detframe.operators.greedy import match_by_score, match_by_value
from detframe.operators.matching import match_default
from detframe.operators.overlap import overlap_pairs
from detframe.plans.ordered import dense_ids, ordered_rank, running_sums, suffix_max

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(n, seed, images=3, classes=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(60), rng.randrange(60)
        out.append((i + 1, rng.randrange(images), rng.randrange(classes), float(x), float(y), float(x + rng.randrange(10, 40)), float(y + rng.randrange(10, 40)), rng.random()))
    return out


def frames(spark, n=120, m=70, seed=1):
    det = spark.createDataFrame(boxes(n, seed), f"det_id long, image_id long, category_id long, {BOX}, score double")
    gt = spark.createDataFrame([(*b[:7], b[0] % 9 == 0) for b in boxes(m, seed + 1)], f"ann_id long, image_id long, category_id long, {BOX}, ignore boolean")
    return det, gt


def test_running_sums_with_cells_equal_plain(spark):
    rows = [(i, i % 2, (i * 37 % 11) / 11.0, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, score double, v long")
    got = {r.id: (r.s, r.m) for r in suffix_max(running_sums(df, ["k"], "score", "id", {"s": "v"}, target=10), ["k"], "score", "id", "s", "m", target=10).collect()}
    for k in (0, 1):
        ordered = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))
        sums = np.cumsum([r[3] for r in ordered])
        best = np.maximum.accumulate(sums[::-1])[::-1]
        for r, s, m in zip(ordered, sums, best):
            assert got[r[0]] == (s, m)


def test_ranks_and_dense_ids(spark):
    df = spark.createDataFrame([(i * i + 3, (i * 7 % 13) / 13.0) for i in range(300)], "id long, u double")
    ranks = ordered_rank(df, [], "u", "id", target=20).orderBy("rank").collect()
    assert [r.rank for r in ranks] == list(range(1, 301))
    assert [(r.u, r.id) for r in ranks] == sorted((r.u, r.id) for r in ranks) or ranks[0].u >= ranks[-1].u
    ids = dense_ids(df, "id", "n", target=20).orderBy("id").collect()
    assert [r.n for r in ids] == list(range(1, 301))


def test_overlap_pairs_across_tiles(spark):
    det, gt = frames(spark)
    keys = ["image_id"]
    pick = ["image_id", "x1", "y1", "x2", "y2"]
    counts = {overlap_pairs(det.select("det_id", *pick), gt.select("ann_id", *pick), keys, tile=t).select("a_det_id", "b_ann_id").distinct().count() for t in (7.0, 512.0)}
    rows = overlap_pairs(det.select("det_id", *pick), gt.select("ann_id", *pick), keys, tile=7.0).count()
    assert counts == {rows}


def greedy_nms(rows, thr):
    keep = []
    for r in sorted(rows, key=lambda r: (-r.score, r.det_id)):
        if all(pairwise_iou(np.array([[k.x1, k.y1, k.x2, k.y2]]), np.array([[r.x1, r.y1, r.x2, r.y2]]))[0, 0] <= thr for k in keep):
            keep.append(r)
    return {r.det_id for r in keep}


@pytest.mark.parametrize("limit", [5, 10_000])
def test_nms_small_groups_and_rounds(spark, limit):
    det, _ = frames(spark)
    rows = det.collect()
    want = set().union(*[greedy_nms([r for r in rows if (r.image_id, r.category_id) == k], 0.4) for k in {(r.image_id, r.category_id) for r in rows}])
    assert {r.det_id for r in S.nms(det, 0.4, limit=limit).collect()} == want


@pytest.mark.parametrize("limit", [5, 10_000])
def test_match_by_score_and_by_value(spark, limit):
    det, gt = frames(spark)
    pick = ["image_id", "x1", "y1", "x2", "y2"]
    pairs = overlap_pairs(det.select("det_id", "score", *pick), gt.select("ann_id", *pick), ["image_id"], "d_", "g_", min_overlap=0.2).select(
        "image_id", F.col("d_det_id").alias("det_id"), F.col("d_score").alias("score"), F.col("g_ann_id").alias("ann_id"), F.col("iou").alias("value"))
    rows = pairs.collect()
    taken, want = set(), set()
    for d in sorted({(-r.score, r.det_id) for r in rows}):
        free = sorted((-r.value, r.ann_id) for r in rows if r.det_id == d[1] and r.ann_id not in taken)
        if free:
            taken.add(free[0][1])
            want.add((d[1], free[0][1]))
    assert {(r.det_id, r.ann_id) for r in match_by_score(pairs, ["image_id"], limit).collect()} == want
    dets, anns, want = set(), set(), set()
    for r in sorted(rows, key=lambda r: (-r.value, r.ann_id, r.det_id)):
        if r.det_id not in dets and r.ann_id not in anns:
            dets.add(r.det_id)
            anns.add(r.ann_id)
            want.add((r.det_id, r.ann_id))
    assert {(r.det_id, r.ann_id) for r in match_by_value(pairs, ["image_id"], limit).collect()} == want


def test_average_precision_with_and_without_cells(spark):
    det, gt = frames(spark)
    flags = match_default(det, gt, 0.4).withColumnRenamed("det_id", "row_id")
    npos = count_boxes(gt, ["category_id"])
    for mode in ("area", "11points"):
        one, two = ({r.category_id: r.ap for r in average_precision(flags, npos, ["category_id"], mode, target=t).collect()} for t in (8, 10 ** 6))
        assert one == pytest.approx(two)


def test_perfect_detections_score_one(spark):
    gt = spark.createDataFrame([(i, i % 4, i % 2, 0, 10.0 * i, 0.0, 10.0 * i + 5 * (i + 1), 50.0) for i in range(12)], f"ann_id long, image_id long, category_id long, iscrowd int, {BOX}")
    det = gt.select(F.col("ann_id").alias("det_id"), "image_id", "category_id", "x1", "y1", "x2", "y2", (1 - F.col("ann_id") / 100).alias("score"))
    m, npos = C.coco_match(det, gt), C.count_real(gt)
    out = {r.metric: r.value for r in C.summarise(C.precision_table(m, npos), C.recall_table(m, npos)).collect()}
    assert out["AP"] == pytest.approx(1.0) and out["AP50"] == pytest.approx(1.0) and out["AR_100"] == pytest.approx(1.0)
    assert out["AP_large"] is None


def test_boxes_of_any_extent_touch_few_tiles(spark):
    from detframe.operators.overlap import _tiled, overlap_pairs

    boxes = [(1, 0.0, 0.0, 10.0, 10.0), (2, -1e9, -1e9, 1e9, 1e9), (3, 70_000.0, 5.0, 200_000.0, 9.0), (4, 150_000.0, 4.0, 160_000.0, 8.0),
             (5, -90_000.0, -3.0, -70_000.0, 7.0), (6, -80_000.0, -1e300, -75_000.0, 1e300), (7, 500.0, 500.0, 530.0, 530.0), (8, 511.0, 511.0, 513.0, 513.0)]
    a = spark.createDataFrame([(0, *b) for b in boxes], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    assert _tiled(a, 512.0, 0.0).groupBy("box_id").count().agg({"count": "max"}).first()[0] < 50_000
    got = {(r.a_box_id, r.b_box_id) for r in overlap_pairs(a, a, ["image_id"]).select("a_box_id", "b_box_id").collect()}
    meet = lambda p, q: min(p[3], q[3]) > max(p[1], q[1]) and min(p[4], q[4]) > max(p[2], q[2])
    assert got == {(p[0], q[0]) for p in boxes for q in boxes if meet(p, q)}


def test_precision_with_and_without_score_cells(spark, sf):
    from detframe.operators import coco_metrics as C
    from detframe.queries import tables as T
    from detframe.session import cut_lineage

    gt = T.gt(spark, sf)
    matches, npos = cut_lineage(C.coco_match(T.det(spark, sf), gt)), C.count_real(gt)
    one, many = ({(r.category_id, r.area, r.iou_thr): round(r.ap, 9) for r in C.precision_table(matches, npos, target=t).collect()} for t in (10**6, 50))
    assert one == many and len(one) > 50


def test_crowded_classes_send_few_rows_on(spark, sf):
    from detframe.operators import coco_metrics as C
    from detframe.queries import tables as T
    from detframe.session import cut_lineage

    gt = T.gt(spark, sf)
    matches, npos, combos = cut_lineage(C.coco_match(T.det(spark, sf), gt)), C.count_real(gt), C._combos(C.IOU_THRS, C.AREAS)
    slim = matches.select("category_id", "det_id", "score", "tp_mask", "ignore_mask")
    plain, cut = (C._best_points(slim, npos, ["category_id"], combos, t).collect() for t in (10**6, 50))
    assert sorted(plain) == sorted(cut) and max(r.point for r in cut) <= 100


def test_blocks_hold_many_whole_groups(spark):
    import numpy as np

    from detframe.plans.grouped import scan_blocks

    rows = spark.range(30_000).selectExpr("id div 7 AS k", "id AS v").repartition(1)

    def sums(arrays, cuts):
        return {"k": arrays["k"][cuts[:-1]], "n": np.diff(cuts), "s": np.add.reduceat(arrays["v"], cuts[:-1]), "groups": np.full(len(cuts) - 1, len(cuts) - 1)}

    out = scan_blocks(rows, ["k"], ["v"], sums, "k long, n long, s long, groups long").collect()
    want = {k: sum(range(7 * k, min(7 * k + 7, 30_000))) for k in range(-(-30_000 // 7))}
    assert {r.k: r.s for r in out} == want and len(out) == len(want) and max(r.groups for r in out) > 100


def test_thresholds_of_one_match_equal_a_match_each(spark, sf):
    from detframe.operators import average_precision as AP
    from detframe.queries import detection as D
    from detframe.queries import tables as T

    det, gt = T.det(spark, sf), D._gt(spark, sf)
    got = {(r.iou_thr, r.category_id): r for r in AP.eval_maps(det, gt, (0.5, 0.7)).collect()}
    for thr in (0.5, 0.7):
        for r in AP.eval_map(det, gt, thr).collect():
            mine = got.pop((thr, r.category_id))
            assert (mine.num_gts, mine.num_dets) == (r.num_gts, r.num_dets) and abs(mine.ap - r.ap) < 1e-12
    assert not got


def _group_tables(spark, sf):
    from detframe.queries import tables as T
    gt = T.gt(spark, sf).withColumn("is_group_of", F.col("iscrowd") == 1).withColumn("ignore", F.col("ann_id") % 11 == 0)
    return T.det(spark, sf), gt


def test_images_of_any_size_are_matched_alike_to_group_boxes(spark, sf, monkeypatch):
    from detframe.operators import matching as M
    det, gt = _group_tables(spark, sf)

    def flags(limit):
        monkeypatch.setattr(M, "IMAGE_LIMIT", limit)
        return sorted(tuple(r) for r in M.match_group_of(det, gt, 0.5, 0.5).select("image_id", "category_id", "row_id", "score", "tp", "fp").collect())
    all_by_image, all_by_tile, mixed = flags(10**9), flags(0), flags(40)
    assert all_by_image == all_by_tile == mixed and len(all_by_image) > 5000
    sizes = gt.groupBy("image_id").count()
    assert sizes.where("count > 40").count() and sizes.where("count <= 40").count()


def test_rows_that_lie_by_image_are_moved_once_for_group_boxes(spark, sf):
    """Only the numbering of boxes by image may shuffle: once for the detections and once for the truth."""
    from detframe.operators import matching as M
    det, gt = _group_tables(spark, sf)
    shuffled = []
    land = M.land

    def seen(df):
        shuffled.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return land(df)
    M.land = seen
    try:
        M.match_group_of(det, gt).count()
    finally:
        M.land = land
    assert shuffled == [1, 2]


def test_copies_of_ancestors_stay_by_image(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "a"), (2, 5, 1, "b"), (3, 6, 2, "c")], "det_id long, image_id long, category_id long, v string")
    closure = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (1, 0), (2, 2), (2, 0)], "child long, ancestor long")
    allowed = spark.createDataFrame([(5, 0), (5, 1), (5, 1), (7, 2), (None, 2)], "image_id long, category_id long")
    got = sorted((r.det_id, r.category_id) for r in S.expand_hierarchy(rows, closure, allowed, "det_id").collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert S.expand_hierarchy(rows, closure, None, "det_id").count() == 7
