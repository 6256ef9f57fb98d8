"""Results do not depend on size limits, key widths or NULL keys."""

import json

import pytest
from pyspark.sql import functions as F

from detframe.functions.hashing import hash_key
from detframe.operators import average_precision as AP
from detframe.operators.greedy import match_by_score
from detframe.operators.sampling import shuffled
from detframe.operators.suppression import expand_hierarchy
from detframe.operators.trackers import SortTracker, sweep
from detframe.plans.ordered import running_sums, suffix_max
from detframe.queries import live
from detframe.sources import annotations as A


def test_large_groups_match_like_small_ones(spark):
    rows = [(v, d, 1 - d / 10, a, 1.0 - abs(d - a) / 10) for v in range(3) for d in range(4) for a in range(5)]
    pairs = spark.createDataFrame(rows, "video_id long, det_id long, score double, ann_id long, value double")
    got = [sorted(map(tuple, match_by_score(pairs, ["video_id"], limit).select("video_id", "det_id", "ann_id", "value").collect())) for limit in (1, 50_000)]
    assert got[0] == got[1] and len(got[0]) == 12


def test_classes_of_any_depth(spark, tmp_path):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 39 else None) for i in range(40)], "child string, parent string")
    assert A.closure(edges).count() == 40 * 41 // 2
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert A.closure(loop).count() == 4
    node = {"LabelName": "n39"}
    for i in reversed(range(39)):
        node = {"LabelName": f"n{i}", "Subcategory": [node]}
    path = tmp_path / "tree.json"
    path.write_text(json.dumps(node))
    assert A.hierarchy_edges(spark, str(path)).count() == 39


@pytest.mark.parametrize("target", [1, 100])
def test_null_keys_stay(spark, target):
    df = spark.createDataFrame([(None, i, i / 10) for i in range(5)] + [("a", i + 10, i / 10) for i in range(4)], "k string, id long, s double")
    sums = running_sums(df, ["k"], "s", "id", {"n": F.lit(1)}, target=target).collect()
    assert sorted((str(r.k), r.n) for r in sums) == sorted([("None", i + 1) for i in range(5)] + [("a", i + 1) for i in range(4)])
    assert suffix_max(df, ["k"], "s", "id", "s", "m", target=target).count() == 9
    assert shuffled(df, "id", 3, by=["k"]).count() == 9


def test_draws_are_wide(spark):
    ids = spark.range(2000).union(spark.range(2000).select((F.col("id") + 2147483647).alias("id")))
    drawn = ids.select(hash_key(5, F.col("id")).alias("h"))
    assert drawn.distinct().count() == 4000 and drawn.where(F.col("h") > 1 << 60).count() > 1000


def test_sweep_uses_every_setting(spark):
    det = spark.createDataFrame([(0, f, f, 0.0, 0.0, 10.0, 10.0, 0.9, 0) for f in range(3)],
                                "video_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, category_id long")
    settings = spark.range(10_050).select(F.col("id").alias("setting_id"))
    assert sweep(det.where("frame_id = 0"), settings, lambda s: SortTracker()).select("setting_id").distinct().count() in (0, 10_050)


def test_open_windows_come_out(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert live.live_curves(spark, sf).agg(F.sum("n")).first()[0] == n
    assert live.live_issues(spark, sf).agg(F.sum("boxes")).first()[0] == n


def test_expanded_classes_are_matched_apart(spark):
    """A detection of class 1 on a box of class 2 must not count for class 1 because it counts for their parent."""
    box = "image_id long, category_id long, x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(1, False, False, 7, 2, 0.0, 0.0, 10.0, 10.0), (2, False, False, 7, 1, 50.0, 50.0, 60.0, 60.0)],
                               "ann_id long, ignore boolean, is_group_of boolean, " + box)
    det = spark.createDataFrame([(5, 0.9, 7, 1, 0.0, 0.0, 10.0, 10.0)], "det_id long, score double, " + box)
    closure = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (2, 2), (2, 0)], "child long, ancestor long")
    out = AP.eval_group_of_map(expand_hierarchy(det, closure, None, "det_id"), expand_hierarchy(gt, closure, None, "ann_id"))
    assert {r.category_id: r.ap for r in out.collect()} == {0: 0.5, 1: 0.0, 2: 0.0}
