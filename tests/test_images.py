import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators import average_precision as AP
from detframe.operators import coco_metrics as C
from detframe.operators import greedy as G
from detframe.operators import matching as M
from detframe.plans import images as I
from detframe.queries import greedy as Q
from detframe.queries import tables as T

DET = "det_id long, image_id long, category_id long, x1 double, y1 double, x2 double, y2 double, score double"
GT = "ann_id long, image_id long, category_id long, iscrowd int, x1 double, y1 double, x2 double, y2 double"


def no_pairs(*args, **kwargs):
    raise AssertionError("pairs of ordinary images must not be joined")


def crowd_of_boxes(spark, images=12, seed=1):
    """Detections and boxes on a coarse grid with ties in place and score, NULL and NaN among them."""
    rng = np.random.default_rng(seed)

    def boxes(n):
        x, y = rng.integers(0, 8, (2, n)) * 10.0
        return np.stack([x, y, x + rng.integers(1, 8, n) * 10.0, y + rng.integers(1, 8, n) * 10.0], 1).tolist()
    det = [(int(i), int(rng.integers(images)), int(rng.integers(4)), *b, float(rng.integers(0, 12) / 10)) for i, b in enumerate(boxes(400))]
    gt = [(int(i), int(rng.integers(images)), int(rng.integers(4)), int(rng.random() < 0.2), *b) for i, b in enumerate(boxes(300))]
    det += [(1000, None, 1, 0.0, 0.0, 9.0, 9.0, 0.5), (1001, 3, None, 0.0, 0.0, 9.0, 9.0, 0.5), (1002, 4, 1, None, 0.0, 9.0, 9.0, 0.5),
            (1003, 5, 1, float("nan"), 0.0, 90.0, 90.0, 0.5), (1004, 6, 1, 0.0, 0.0, 90.0, 90.0, float("nan")), (1005, 6, 2, 0.0, 0.0, 90.0, 90.0, None)]
    gt += [(1000, None, 1, 0, 0.0, 0.0, 9.0, 9.0), (1001, 7, None, 0, 0.0, 0.0, 9.0, 9.0), (1002, 8, 1, None, 0.0, 0.0, 90.0, 90.0)]
    return spark.createDataFrame(det, DET), spark.createDataFrame(gt, GT)


def rows(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


@pytest.mark.parametrize("use_category", [True, False])
@pytest.mark.parametrize("limit", [0, 55, 2000])
def test_coco_match_by_image_equals_the_joins(spark, monkeypatch, limit, use_category):
    monkeypatch.setattr(I, "IMAGE_ROWS", limit)
    det, gt = crowd_of_boxes(spark)
    got, want = (C.coco_match(det, gt, (0.3, 0.5), max_det=9, use_category=use_category, ordinary=ordinary) for ordinary in (True, False))
    assert rows(got.select(want.columns)) == rows(want)


def test_error_breakdown_joins_no_pairs(spark, sf, monkeypatch):
    kinds = T.categories(spark, sf).where("category_id <> 3")
    det, gt = T.det(spark, sf), T.gt(spark, sf)
    monkeypatch.setattr(I, "IMAGE_ROWS", 0)
    want = rows(C.error_breakdown(det, gt, kinds).withColumn("ap", F.round("ap", 9)))
    monkeypatch.undo()
    monkeypatch.setattr(C, "overlap_pairs", no_pairs)
    assert rows(C.error_breakdown(det, gt, kinds).withColumn("ap", F.round("ap", 9))) == want
    assert Q.coco_error_breakdown(spark, sf).count() == 105


@pytest.mark.parametrize("limit", [0, 55, 2000])
def test_threshold_masks_by_image_equal_the_joins(spark, monkeypatch, limit):
    monkeypatch.setattr(I, "IMAGE_ROWS", limit)
    det, gt = crowd_of_boxes(spark)
    gt = gt.where("iscrowd IS NOT NULL").withColumn("ignore", F.col("iscrowd") == 1)
    got, want = (M.threshold_masks(det, gt, (0.3, 0.5), legacy=True, ordinary=ordinary) for ordinary in (True, False))
    assert rows(got) == rows(want)


def test_precision_of_masks_equals_that_of_flags(spark, monkeypatch):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 3, (3, 3000))
    made = [(int(rng.integers(2)), i, float(rng.integers(0, 400) / 400), *(int(sum((bits[t, i] == v) << t for t in range(3))) for v in (0, 1))) for i in range(3000)]
    masks = spark.createDataFrame(made, "category_id long, det_id long, score double, tp long, fp long")
    npos = spark.createDataFrame([(0, 900), (1, 700), (2, 5), (3, 0)], "category_id long, num_gts long")
    for target in (10**6, 100):
        got = {(r.iou_thr, r.category_id): r for r in AP.masked_precision(masks, npos, (0.5, 0.6, 0.7), ["category_id"], target).collect()}
        for t, thr in enumerate((0.5, 0.6, 0.7)):
            flags = masks.select("category_id", F.col("det_id").alias("row_id"), "score", *[F.shiftright(c, t).bitwiseAND(F.lit(1).cast("long")).alias(c) for c in ("tp", "fp")])
            want = {(thr, r.category_id): (r.num_dets, pytest.approx(r.ap, abs=1e-12)) for r in AP.average_precision(flags, npos, ["category_id"], target=target).collect()}
            assert {k: (r.num_dets, r.ap) for k, r in got.items() if k[0] == thr} == want


def test_mean_average_precision_joins_no_pairs(spark, sf, monkeypatch):
    from detframe.queries import detection as D
    monkeypatch.setattr(M, "overlap_pairs", no_pairs)
    assert D.mean_average_precision(spark, sf).count() == 3


@pytest.mark.parametrize("by", [[], ["half"]])
def test_proposal_recall_by_image_equals_the_joins(spark, monkeypatch, by):
    det, gt = (df.withColumn("half", F.col("image_id") % 2) for df in crowd_of_boxes(spark))
    found = []
    for limit in (0, 55, 2000):
        monkeypatch.setattr(I, "IMAGE_ROWS", limit)
        found.append(rows(G.proposal_recall(det, gt, (3, 10, 100), (0.3, 0.5), by)))
    assert found[0] == found[1] == found[2]
    assert sum(float(r[-1]) > 0 for r in found[0]) >= 6


def test_proposal_recall_joins_no_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(G, "overlap_pairs", no_pairs)
    assert Q.proposal_recall(spark, sf).count() == 9


def test_offline_evaluation_joins_no_pairs(spark, sf, monkeypatch):
    from detframe.queries import live
    for module in (C, G, M):
        monkeypatch.setattr(module, "overlap_pairs", no_pairs)
    assert live.offline_evaluation(spark, sf).count() == 34


def test_matching_index_by_image_equals_the_joins(spark, monkeypatch):
    det, gt = crowd_of_boxes(spark)
    gt = gt.where("iscrowd IS NOT NULL").withColumn("ignore", F.col("iscrowd") == 1)
    alone = spark.createDataFrame([(5000, 900, 1, 0, 0.0, 0.0, 9.0, 9.0, False), (5001, 901, 1, 0, 0.0, 0.0, 9.0, 9.0, True)], gt.schema)
    # limits of pairs that leave no image, images of up to 56 rows, and all of them to numpy
    found = [{r.score_thr: round(r.ji, 9) for r in G.max_matching_index(det, gt.unionByName(alone), [0.0, 0.4, 0.9], 0.3, limit=n).collect()} for n in (0, 800, 20_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_matching_index_joins_no_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(G, "overlap_pairs", no_pairs)
    assert Q.max_matching_index(spark, sf).count() == 10
