"""Numbered datasets, result files, mask canvases and evaluation by dataset on small made-up rows."""

import json

import pytest
from pyspark.sql import functions as F

from detframe.operators import sampling as S
from detframe.operators import segments as SG
from detframe.operators.evaluate import evaluate
from detframe.plans.ordered import sums_before
from detframe.sinks import records as R
from detframe.sources import annotations as A

DET = "det_id long, image_id long, category_id long, score double, x1 double, y1 double, x2 double, y2 double"
GT = "ann_id long, image_id long, category_id long, iscrowd int, x1 double, y1 double, x2 double, y2 double"


def test_sums_before_equal_a_walk(spark):
    rows = [(i * i - 40, i % 5) for i in range(30) if i != 7]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "at long, n long, other string").repartition(5)
    for target in (3, 1000):
        got = {r["at"]: r["before"] for r in sums_before(df, "at", "n", "before", target).collect()}
        assert got == {a: sum(n for b, n in rows if b < a) for a, _ in rows}
    assert sums_before(df.limit(0), "at", "n", "before").count() == 0


def test_crowdhuman_file_to_numbered_records(spark, tmp_path):
    lines = [{"ID": "b", "gtboxes": [{"tag": "person", "fbox": [1, 2, 3, 4], "hbox": [0, 0, 1, 1], "vbox": [1, 2, 3, 2], "extra": {"box_id": 0}},
                                     {"tag": "mask", "fbox": [0, 0, 2, 2], "hbox": [0, 0, 1, 1], "vbox": [0, 0, 2, 1], "extra": {"ignore": 1}}]},
             {"ID": "empty", "gtboxes": []}, {"ID": "a", "gtboxes": [{"tag": "mask", "fbox": [5, 5, 1, 1], "hbox": [0, 0, 1, 1], "vbox": [5, 5, 1, 1]}]}]
    (tmp_path / "x.odgt").write_text("\n".join(json.dumps(x) for x in lines))
    images = spark.createDataFrame([("b", 10, 40, 30), ("empty", 20, 40, 30), ("a", 31, 40, 30)], "image_id string, line long, width long, height long")
    got_images, got = R.crowdhuman_to_coco(images, A.read_crowdhuman(spark, str(tmp_path / "x.odgt")))
    assert sorted((r.id, r.file_name) for r in got_images.collect()) == [(1, "Images/b.jpg"), (2, "Images/empty.jpg"), (3, "Images/a.jpg")]
    rows = [(r.id, r.image_id, r.bbox, r.vis_bbox, r.area, r.iscrowd) for r in got.orderBy("id").collect()]
    assert rows == [(1, 1, [1, 2, 3, 4], [1, 2, 3, 2], 12, 0), (2, 1, [0, 0, 2, 2], [0, 0, 2, 1], 4, 1), (3, 3, [5, 5, 1, 1], [5, 5, 1, 1], 1, 0)]


def walk_frames(videos, tracks):
    """The sequential form: every frame of every video in order, its tracks in order."""
    out, image, ann, seen = [], 0, 0, {}
    for v, _, files in sorted(videos, key=lambda x: x[1]):
        for f in range(len(files)):
            image += 1
            for tv, pos, cat, boxes in sorted((t for t in tracks if t[0] == v), key=lambda t: t[1]):
                if f < len(boxes) and boxes[f] is not None:
                    ann += 1
                    out.append((ann, image, cat, seen.setdefault((v, pos), len(seen) + 1), boxes[f][0]))
    return out


def test_video_arrays_to_frames_equal_a_walk(spark):
    videos = [(9, 1, ["9/a", "9/b", "9/c"]), (4, 3, ["4/a"]), (7, 2, []), (5, 8, ["5/a", "5/b"])]
    tracks = [(9, 2, 1, [None, [1.0, 0, 1, 1], [2.0, 0, 1, 1]]), (9, 5, 2, [[3.0, 0, 1, 1], None, [4.0, 0, 1, 1]]), (9, 6, 1, [None, None, None]),
              (4, 1, 3, [[5.0, 0, 1, 1], [6.0, 0, 1, 1]]), (5, 4, 1, [None, [7.0, 0, 1, 1]]), (5, 3, 1, [[8.0, 0, 1, 1], [9.0, 0, 1, 1]]), (1, 1, 1, [[0.0, 0, 1, 1]])]
    tracks = [(*t[:3], [b and [float(n) for n in b] for b in t[3]]) for t in tracks]
    v = spark.createDataFrame([(a, b, 6, 5, c) for a, b, c in videos], "video_id long, position long, width int, height int, file_names array<string>")
    t = spark.createDataFrame([(a, b, c, 0, d, [1.0] * len(d), ["s"] * len(d)) for a, b, c, d in tracks],
                              "video_id long, position long, category_id long, iscrowd int, bboxes array<array<double>>, areas array<double>, segmentations array<string>")
    images, got, counts = R.youtube_vis_to_coco(v, t)
    assert [(r.id, r.file_name) for r in images.orderBy("id").collect()] == [(1, "9/a"), (2, "9/b"), (3, "9/c"), (4, "4/a"), (5, "5/a"), (6, "5/b")]
    assert [(r.id, r.image_id, r.category_id, r.instance_id, r.bbox[0]) for r in got.orderBy("id").collect()] == walk_frames(videos, tracks)
    assert {r.category_id: r.objects for r in counts.collect()} == {1: 5, 2: 2, 3: 1}


def test_result_files(spark, tmp_path):
    det = spark.createDataFrame([(1, 3, 0, 0.5, 0.0, 0.0, 2.0, 3.0), (2, 3, 1, 0.25, 1.0, 1.0, 2.0, 2.0)], DET).withColumn("height", F.lit(4)).withColumn("width", F.lit(5))
    det = det.withColumnRenamed("category_id", "label")
    names = spark.createDataFrame([(0, 17), (1, 18)], "label long, category_id long")
    runs = spark.createDataFrame([(1, 0, 3), (1, 4, 3)], "det_id long, start long, length long")
    paths = R.write_coco_results(det, str(tmp_path / "out"), runs, names)
    assert paths["bbox"] == paths["proposal"] and sorted(r.category_id for r in spark.read.json(paths["bbox"]).collect()) == [17, 18]
    masks = sorted((r.category_id, r.score, r.segmentation.size, r.segmentation.counts) for r in spark.read.json(paths["segm"]).collect())
    assert [m[:3] for m in masks] == [(17, 0.5, [4, 5]), (18, 0.25, [4, 5])]
    subset = [["a.jpg", "cat", 1, [0, 0, 2, 3], {"size": [4, 5], "counts": masks[0][3]}], ["b.jpg", "dog", 2, [1, 1, 2, 2], {"size": [4, 5], "counts": masks[1][3]}]]
    (tmp_path / "occ.json").write_text(json.dumps(subset))
    rows = A.read_occlusion_subset(spark, str(tmp_path / "occ.json"), "occluded").orderBy("position").collect()
    assert [(r.file_name, r.category, r.x1, r.x2, r.y2, r.height, r.width) for r in rows] == [("a.jpg", "cat", 0, 2, 3, 4, 5), ("b.jpg", "dog", 1, 3, 3, 4, 5)]
    apart = A.read_occlusion_subset(spark, str(tmp_path / "occ.json"), "separated").orderBy("position").collect()
    assert [r.x2 for r in apart] == [2, 2]
    from detframe.functions import polygons as P
    read = spark.createDataFrame([(r.counts,) for r in rows], "c string").select(P.decode_rle("c").alias("n")).collect()
    assert [r.n for r in read] == [[0, 3, 1, 3, 13], [20]]


def test_panoptic_test_info(spark, tmp_path):
    (tmp_path / "info.json").write_text(json.dumps({"info": {"year": 2017}, "images": [{"id": 5}, {"id": 2}], "categories": [{"id": 1, "name": "old"}]}))
    info = spark.read.option("multiLine", True).json(str(tmp_path / "info.json"))
    table = spark.createDataFrame([(200, "rug", 0), (1, "person", 1)], "id long, name string, isthing int")
    row = R.panoptic_test_info(info, table).collect()
    assert len(row) == 1 and [(c.id, c.name, c.isthing) for c in row[0].categories] == [(1, "person", 1), (200, "rug", 0)]
    assert [i.id for i in row[0].images] == [5, 2] and row[0].info.year == 2017


def test_records_without_boxes(spark):
    rows = spark.createDataFrame([(1, "i", 0, 5.0, 5.0, 9.0, 9.0, 4.0, 4.0, False), (2, "j", 0, 0.0, 0.0, 9.0, 2.0, 4.0, 4.0, False), (3, "k", 0, 0.0, 0.0, 1.0, 1.0, 4.0, 4.0, True)],
                                 "row_id long, image_id string, label long, x1 double, y1 double, x2 double, y2 double, width double, height double, is_group_of boolean")
    names = spark.createDataFrame([(0, "cat")], "label long, category string")
    got = R.openimages_records(rows, names).collect()
    assert [(r.filename, [i.bbox for i in r.detection.instances]) for r in got] == [("j.jpg", [[0, 0, 4, 2]])]
    assert R.openimages_records(rows.limit(0), names).count() == 0


def test_regions_of_a_caption(spark):
    text = "A dog. Two étuis, a cat's cup"
    spans = [(2, 5), (2, 6), (7, 16), (21, 24), (2, 5), (4, 4), (18, 30), (0, 5)]
    boxes = [[0.1, 0.1, 0.5, 0.5]] * 7 + [[1.2, 0.1, 1.5, 0.5]]
    rows = [(1, text, 100.0, 50.0, [[float(a), float(b), *x] for (a, b), x in zip(spans, boxes)]), (2, None, 1.0, 1.0, [[0.0, 1.0, 0.0, 0.0, 1.0, 1.0]]), (3, "x", 9.0, 9.0, None),
            (4, "x", 9.0, 9.0, [[0.0, 1.0]]), (5, "x", None, 9.0, [[0.0, 1.0, 0.0, 0.0, 1.0, 1.0]])]
    got = R.caption_regions(spark.createDataFrame(rows, "id long, caption string, width double, height double, ref_exps array<array<double>>")).collect()
    assert [r.id for r in got] == [1]
    assert [(r.phrase, r.tokens_positive, len(r.bboxes)) for r in got[0].regions] == [("dog", [2, 5], 2), ("dog.", [2, 6], 1), (text[21:24], [21, 24], 1)]
    assert got[0].regions[0].bboxes[0] == [10.0, 5.0, 50.0, 25.0]


def test_canvases_and_joined_masks(spark):
    runs = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 0, 1)], "image_id long, mask long, start long, length long").withColumn("height", F.lit(4))
    padded = sorted((r["mask"], r["start"], r["length"], r["height"]) for r in SG.expand_runs(runs, 0, 0, 6).collect())
    assert padded == [(0, 2, 2, 6), (0, 6, 3, 6), (1, 0, 1, 6)]
    slim = runs.select("image_id", "mask", "start", "length")
    both = SG.cat_masks([slim, slim.limit(0), slim.where("mask = 1"), slim])
    assert sorted((r["mask"], r["start"]) for r in both.collect()) == [(0, 2), (1, 0), (3, 0), (4, 2), (5, 0)]
    labels = spark.createDataFrame([(0,), (1,), (255,), (7,)], "label long")
    assert [r["label"] for r in SG.reduce_zero_label(labels).collect()] == [255, 0, 255, 6]


def test_groups_without_a_value(spark):
    images = spark.createDataFrame([(i, i % 2, None if i % 3 == 0 else 1) for i in range(30)], "image_id long, source int, shape int")
    got = S.multi_source_batches(images, 4, (1, 1), 50, 3, group=F.col("shape")).collect()
    assert len(got) == 200
    shapes = {}
    for r in got:
        shapes.setdefault(r["batch"], set()).add(r["image_id"] % 3 == 0)
    assert all(len(s) == 1 for s in shapes.values()) and len({next(iter(s)) for s in shapes.values()}) == 2
    assert S.multi_source_batches(images.limit(0), 4, (1, 1), 50, 3, group=F.col("shape")).count() == 0


def test_datasets_do_not_mix(spark):
    boxes = [(1, 1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 1, 0, 20.0, 20.0, 40.0, 40.0), (3, 2, 0, 0, 5.0, 5.0, 30.0, 30.0)]
    hits = [(a, i, c, 0.9 - a / 10, x1, y1, x2, y2) for a, i, c, _, x1, y1, x2, y2 in boxes]
    gt, det = spark.createDataFrame(boxes, GT), spark.createDataFrame(hits, DET)
    whole = {"full": (det, gt), "none": (det.limit(0), gt), "half": (det.where("category_id = 0"), gt)}
    metrics = ("voc", "coco", "recall")
    got = {(r.dataset, r.metric): r["value"] for r in evaluate(whole, metrics).collect()}
    assert got["full", "voc_map_50"] == got["full", "coco_AP"] == got["full", "recall_100@0.75"] == 1
    assert got["none", "voc_map_50"] == got["none", "coco_AP"] == got["none", "recall_100@0.50"] == 0
    assert got["half", "voc_map_50"] == got["half", "coco_AP50"] == 0.5 and got["half", "recall_300@0.50"] == pytest.approx(2 / 3)
    for name, pair in whole.items():
        alone = {r.metric: r["value"] for r in evaluate({name: pair}, metrics).collect()}
        assert alone == {m: v for (d, m), v in got.items() if d == name}
    with pytest.raises(ValueError):
        evaluate(whole, ("nothing",))


def test_run_lists_need_no_shuffle_and_equal_the_run_tables(spark):
    from pyspark.sql import functions as F

    from detframe.functions import polygons as P
    from detframe.operators import segments as SG

    boxes = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 10.0), (2, 2.0, 3.0, 6.0, 5.0), (3, 4.0, 4.0, 4.0, 9.0), (4, 5.0, 7.0, 8.0, 10.0)],
                                  "ann_id long, x1 double, y1 double, x2 double, y2 double").withColumn("height", F.lit(10))
    rows = SG.union_runs(SG.box_runs(boxes), ["ann_id"]).withColumn("size", F.lit(80))
    want = {r.ann_id: r.counts for r in P.runs_to_counts(rows, ["ann_id"]).collect()} | {3: [80]}
    lists = boxes.select("ann_id", P.list_to_counts(P.merge_runs(SG.box_run_list()), F.lit(80)).alias("counts"))
    assert {r.ann_id: r.counts for r in lists.collect()} == want and want[1] == [0, 30, 50] and want[4][-1] == 3
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    back = {r.ann_id: [tuple(x) for x in r.r] for r in lists.select("ann_id", P.counts_to_runs("counts").alias("r")).collect()}
    assert back[1] == [(0, 30)] and back[3] == [] and back[2] == [(23, 2), (33, 2), (43, 2), (53, 2)]
    odd = spark.createDataFrame([(None,), ([],), ([0, 0, 5, 2],)], "counts array<long>").select(P.counts_to_runs("counts").alias("r")).collect()
    assert odd[0].r is None and odd[1].r == [] and [tuple(x) for x in odd[2].r] == [(5, 2)]
