"""Short proofs of the operators that no registered query calls."""

import os

import pytest
from pyspark.sql import functions as F

from detframe.functions import polygons as P
from detframe.operators import average_precision as AP
from detframe.operators import filters as FL
from detframe.operators import geometry as GE
from detframe.operators import logs as LG
from detframe.operators import segments as S
from detframe.sinks import convert as CV


def test_filters(spark):
    det = spark.createDataFrame([(1, 0.9, 2, 50.0), (2, 0.4, 2, 50.0), (3, 0.9, 1, 50.0), (4, 0.9, 2, 5.0)], "det_id long, score double, category_id long, area double")
    assert [r.det_id for r in FL.keep_instances(det, 0.5, 2, 10.0).collect()] == [1]
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "image_id long, source string")
    annotations = spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, 3)], "ann_id long, image_id long")
    chosen, kept = FL.by_source(images, annotations, "b")
    assert [r.image_id for r in chosen.collect()] == [2] and sorted(r.ann_id for r in kept.collect()) == [11, 12]
    assert {r.category_id for r in FL.unify_categories(det).collect()} == {1}


def test_points_and_outlines(spark):
    points = spark.createDataFrame([(k, i) for k, n in ((0, 3), (1, 10)) for i in range(n)], "mask long, at long")
    thinned = GE.every_nth(points, ["mask"], ["at"], 4).collect()
    assert sorted(r.at for r in thinned if r["mask"] == 0) == [0, 1, 2] and sorted(r.at for r in thinned if r["mask"] == 1) == [0, 2, 4, 6, 8]
    square = {(r, c) for r in range(4) for c in range(4)}
    rim = S.outline_pixels(spark.createDataFrame([(0, r, c) for r, c in square], "mask long, r long, c long"), ["mask"]).orderBy("angle").collect()
    assert {(p.r, p.c) for p in rim} == {(r, c) for r, c in square if r in (0, 3) or c in (0, 3)}
    assert [p.angle for p in rim] == sorted(p.angle for p in rim)
    parts = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [4, 2])], "flat array<double>, n array<int>").select(P.split_parts(F.col("flat"), F.col("n")).alias("p"))
    assert parts.first().p == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]]


def test_recall_logs_and_statistics(spark):
    flags = spark.createDataFrame([(0, 1), (0, 0), (0, 1)], "category_id long, tp long")
    npos = spark.createDataFrame([(0, 4), (1, 2)], "category_id long, num_gts long")
    assert {r.category_id: r.recall for r in AP.average_recall(flags, npos, ["category_id"]).collect()} == {0: 0.5, 1: 0.0}
    lines = spark.createDataFrame([("m", "r1", 1, 5), ("m", "r2", 7, 6), ("m", "r2", 7, 8), ("n", "r1", 3, 9)], "model string, run string, changed long, value long")
    assert sorted(r.value for r in LG.newest_runs(lines, "model", "run", "changed").collect()) == [6, 8, 9]
    stats = spark.createDataFrame([("train", 3, 10), ("train", 4, 1), ("val", 1, 1)], "split string, images long, boxes long")
    assert {(r.split, r.images, r.boxes) for r in CV.merged_shards(stats, "split", ["images", "boxes"]).collect()} == {("train", 7, 11), ("val", 1, 1)}
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    scores = spark.createDataFrame([(2, 0.5)], "image_id long, ap double")
    assert {r.image_id: r.ap for r in GE.with_failures(images, scores).collect()} == {1: None, 2: 0.5}


def test_conversions(spark):
    boxes = spark.createDataFrame([(1, 0, -5.0, 2.0, 20.0, 8.0, 10, 10), (2, 0, 9.5, 2.0, 30.0, 8.0, 10, 10)],
                                  "ann_id long, image_id long, x1 double, y1 double, x2 double, y2 double, width long, height long")
    clipped = CV.openimages_to_odvg(boxes.withColumn("is_group_of", F.lit(False)).withColumn("group_of", F.lit(0)).withColumn("IsGroupOf", F.lit(0)))
    assert [(r.ann_id, r.x1, r.x2) for r in clipped.collect()] == [(1, 0.0, 10.0)]
    voc = boxes.withColumn("category_id", F.lit(3)).withColumn("difficult", F.lit(1))
    row = CV.voc_to_coco(voc).where("ann_id = 1").first()
    assert row.bbox == [-5.0, 2.0, 25.0, 6.0] and row.area == 150.0 and row.iscrowd == 1
    assert {(r.category_id, r.name) for r in CV.add_background(spark.createDataFrame([(1, "cat")], "category_id long, name string")).collect()} == {(0, "background"), (1, "cat")}
    names = spark.createDataFrame([(f"{i}.png", 5, 6) for i in range(40)], "file_name string, width long, height long")
    ids = [r.image_id for r in CV.images_to_coco(names).collect()]
    assert sorted(ids) == list(range(40))
    with pytest.raises(ValueError):
        CV.images_to_coco(names.unionByName(names.limit(1))).collect()


def test_writers(spark, tmp_path):
    tracks = spark.createDataFrame([(v, f, 1, 1.0, 2.0, 5.0, 8.0, 0.5) for v in (0, 1) for f in (2, 0, 1)],
                                   "video_id long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double, score double")
    CV.write_mot(tracks, str(tmp_path / "mot"))
    back = spark.read.text(str(tmp_path / "mot"))
    assert back.count() == 6 and {r.video_id for r in back.select("video_id").distinct().collect()} == {0, 1}
    for folder in (tmp_path / "mot").glob("video_id=*"):
        lines = [x for part in sorted(folder.glob("part-*")) for x in part.read_text().splitlines()]
        assert [int(x.split(",")[0]) for x in lines] == sorted(int(x.split(",")[0]) for x in lines) and len(lines) == 3
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    CV.write_json_lines(rows, str(tmp_path / "json"))
    assert {(r.id, r.name) for r in spark.read.json(str(tmp_path / "json")).collect()} == {(1, "a"), (2, None)}
    CV.write_metrics_csv(rows, str(tmp_path / "csv"))
    assert {(r.id, r.name) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {("1", "a"), ("2", None)}
    assert os.path.isdir(tmp_path / "csv")


def test_shapes_without_a_main_axis_have_angle_zero(spark):
    from detframe.operators.geometry import shape_stats

    square = [(i, r + 0.0, c + 0.0) for i, at in enumerate((0, 7, 1001)) for r, c in ((at, at), (at, at + 3), (at + 3, at), (at + 3, at + 3), (at + 1, at + 1), (at + 2, at + 2), (at + 1, at + 2), (at + 2, at + 1))]
    line = [(9, 12.0, c + 0.1 - 0.1) for c in (1.0, 5.0, 9.0, 31.0)]
    for order in (square + line, (square + line)[::-1]):
        points = spark.createDataFrame(order, "image_id long, r double, c double").repartition(3)
        assert {r.orientation for r in shape_stats(points, ["image_id"]).collect()} == {0.0}


def test_merged_spans_equal_their_sql_on_short_texts(spark, tmp_path):
    import duckdb

    from detframe.queries import convert

    rows = [(4 * n + d, "abcdefghij"[:n]) for n in range(1, 10) for d in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in convert.merged_spans(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(convert.MERGED_SQL).fetchall()) and len(got) == len(rows)
