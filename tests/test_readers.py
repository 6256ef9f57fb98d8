"""Readers on small invented files."""

import json

from detframe.sources import annotations as A
from detframe.sources import files as L
from detframe.sources import grounding as G
from detframe.sources import video as V


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_panoptic_segments(spark, tmp_path):
    path = put(tmp_path / "p.json", {
        "images": [{"id": 4, "file_name": "x.jpg", "height": 9, "width": 8}],
        "categories": [{"id": 1, "name": "boat", "isthing": 1}, {"id": 2, "name": "sea", "isthing": 0}],
        "annotations": [{"image_id": 4, "file_name": "x.png", "segments_info": [
            {"id": 11, "category_id": 1, "area": 6, "iscrowd": 0, "bbox": [1, 2, 3, 4]}, {"id": 12, "category_id": 1, "area": 7, "iscrowd": 1, "bbox": [0, 0, 2, 2]},
            {"id": 13, "category_id": 2, "area": 8, "iscrowd": 0, "bbox": [0, 0, 8, 9]}]}]})
    rows = {r.segment_id: r for r in A.read_coco_panoptic(spark, path)["segments"].collect()}
    assert [(rows[i].is_thing, rows[i].ignore_flag) for i in (11, 12, 13)] == [(True, 0), (False, 1), (False, 0)]
    assert (rows[11].x1, rows[11].y2, rows[11].seg_file) == (1, 6, "x.png")


def test_captions_results_and_proposals(spark, tmp_path):
    path = put(tmp_path / "c.json", {"images": [], "annotations": [{"id": 2, "image_id": 1, "caption": "second"}, {"id": 1, "image_id": 1, "caption": "first"}]})
    assert A.read_captions(spark, path).first().captions == ["first", "second"]
    path = put(tmp_path / "r.json", [{"image_id": 3, "category_id": 7, "bbox": [1, 1, 4, 5], "score": 0.5}, {"image_id": 3, "category_id": 7, "bbox": [0, 0, 1, 1], "score": 0.2, "area": 9.0}])
    rows = sorted((r.det_id, r.area, r.x2, r.score) for r in A.read_coco_results(spark, path).collect())
    assert rows == [(1, 20.0, 5.0, 0.5), (2, 9.0, 1.0, 0.2)]
    path = put(tmp_path / "props.jsonl", '{"file": "/data/set/a.jpg", "x1": 0, "y1": 1, "x2": 2, "y2": 3, "score": 0.9}\n{"file": "/data/other/a.jpg", "x1": 0, "y1": 1, "x2": 2, "y2": 3, "score": 0.1}')
    images = spark.createDataFrame([(5, "elsewhere/set/a.jpg")], "image_id long, img_path string")
    assert [(r.image_id, r.score) for r in A.read_proposals(spark, path, images).collect()] == [(5, 0.9)]


def test_faces(spark, tmp_path):
    put(tmp_path / "f" / "one.xml", "<annotation><folder>street</folder><filename>one.jpg</filename><size><width>70</width><height>60</height></size>"
        "<object><name>face</name><bndbox><xmin>3.7</xmin><ymin>4</ymin><xmax>9</xmax><ymax>8</ymax></bndbox></object></annotation>")
    images, boxes = A.read_wider_face(spark, str(tmp_path / "f"), min_size=5)
    assert images.first().img_path == "street/one.jpg"
    row = boxes.first()
    assert (row.x1, row.y1, row.x2, row.ignore_flag) == (3, 4, 9, 1)


def test_open_images_tables(spark, tmp_path):
    names = put(tmp_path / "names.csv", "/m/a,Anchor\n/m/b,Bell\n")
    labels = A.read_label_descriptions(spark, names)
    assert {r.mid: r.label for r in labels.collect()} == {"/m/a": 0, "/m/b": 1}
    numbered = A.read_label_descriptions(spark, put(tmp_path / "numbered.csv", "/m/b,Bell,1\n/m/a,Anchor,5\n"))
    assert {r.mid: r.label for r in numbered.collect()} == {"/m/b": 0, "/m/a": 4}
    head = "ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax,IsOccluded,IsTruncated,IsGroupOf,IsDepiction,IsInside\n"
    boxes = put(tmp_path / "boxes.csv", head + "im,s,/m/b,1,0.1,0.5,0.25,0.75,0,1,1,0,0\nim,s,/m/unknown,1,0,1,0,1,0,0,0,0,0\n")
    sizes = spark.createDataFrame([("im", 200, 100)], "image_id string, width long, height long")
    row, = A.read_openimages(spark, boxes, labels, sizes).collect()
    assert (row.label, row.x1, row.y1, row.x2, row.y2, row.is_group_of, row.is_occluded) == (1, 20.0, 25.0, 100.0, 75.0, True, False)
    verified = A.read_image_labels(spark, put(tmp_path / "v.csv", "ImageID,Source,LabelName,Confidence\nim,h,/m/a,1\nim,h,/m/b,0\n"), labels)
    assert {(r.label, r.confidence) for r in verified.collect()} == {(0, 1.0), (1, 0.0)}


def test_dsdl_samples(spark, tmp_path):
    path = put(tmp_path / "d.json", {"samples": [
        {"media": {"media_path": "a.jpg"}, "annotations": [{"category": "kite", "bbox": [1, 2, 3, 4], "iscrowd": True}, {"category": "other", "bbox": [0, 0, 1, 1]}]},
        {"media": {"media_path": "b.jpg"}, "annotations": []}]})
    assert [(r.img_path, r.label, r.ignore_flag, r.y2) for r in A.read_dsdl(spark, path, ["boat", "kite"]).collect()] == [("a.jpg", 1, 1, 6.0)]


def test_files_and_logs(spark, tmp_path):
    put(tmp_path / "img" / "sub" / "a_img.png", "12345")
    put(tmp_path / "img" / "b.txt", "x")
    listing = L.list_files(spark, str(tmp_path / "img"), ".png")
    assert [(r.file_name, r.length) for r in listing.collect()] == [("a_img.png", 5)]
    pair = L.segmentation_pairs(listing, "_img.png", "_map.png", "/img/", "/maps/").first()
    assert pair.seg_map_path.endswith("/maps/sub/a_map.png")
    put(tmp_path / "logs" / "city" / "run.log", "start\nbbox_mAP_copypaste: 0.1 0.2 0.3 0.4 0.5 0.6\nbbox_mAP_copypaste: 0.7 0.2 0.3 -1 nan 0.6\n")
    row, = L.read_result_logs(spark, str(tmp_path / "logs")).collect()
    assert (row.dataset, row.ap, row.ap_s) == ("city", 0.7, -1.0)
    path = put(tmp_path / "poly" / "scene7.json", {"info": {"name": "x", "width": 5, "height": 6}, "objects": [{"category": "roof", "segmentation": [[0, 0], [4, 0], [4, 3]], "iscrowd": False}]})
    row, = L.read_polygons(spark, path).collect()
    assert (row.image_id, row.width, row.nth, row.category, row.points[2]) == ("scene7", 5, 0, "roof", [4.0, 3.0])


def test_videos(spark, tmp_path):
    path = put(tmp_path / "v.json", {
        "images": [{"id": 1, "video_id": 9, "frame_id": 0, "file_name": "a", "width": 5, "height": 5}, {"id": 2, "video_id": None, "frame_id": 3, "file_name": "b", "width": 5, "height": 5}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "instance_id": 0, "bbox": [0, 0, 2, 2], "iscrowd": 0, "visibility": 0.9, "mot_conf": 1.0},
                        {"id": 2, "image_id": 1, "category_id": 1, "instance_id": 8, "bbox": [1, 1, 2, 2], "iscrowd": 1, "visibility": 0.1, "mot_conf": 1.0},
                        {"id": 3, "image_id": 2, "category_id": 1, "instance_id": 4, "bbox": [1, 1, 2, 2], "iscrowd": 0, "visibility": 0.5, "mot_conf": 1.0}]})
    frames, boxes = V.read_video_coco(spark, path)
    assert {r.image_id: (r.video_id, r.frame_id, r.video_length) for r in frames.collect()} == {1: (9, 0, 1), 2: (100002, 0, 1)}
    assert {r.ann_id: (r.instance_id, r.ignore_flag) for r in boxes.collect()} == {1: (0, 0), 2: (8, 1), 3: (4, 0)}
    assert V.read_video_coco(spark, path, visibility_thr=0.5)[1].count() == 2
    path = put(tmp_path / "y.json", {"annotations": [{"id": 3, "video_id": 1, "category_id": 2, "iscrowd": 0, "bboxes": [[0, 0, 1, 1], None, [2, 2, 3, 3]], "areas": [1, None, 9], "segmentations": ["a", None, "c"]}]})
    assert sorted((r.instance_id, r.frame_id, r.x2, r.area) for r in V.read_youtube_vis(spark, path).collect()) == [(3, 0, 1.0, 1.0), (3, 2, 5.0, 9.0)]
    rows = V.read_identity_list(spark, put(tmp_path / "ids.txt", "a/one.jpg 3\nb/two.jpg 4\n"), "root/")
    assert sorted((r.img_path, r.pid) for r in rows.collect()) == [("root/a/one.jpg", 3), ("root/b/two.jpg", 4)]


def test_grounding_tables(spark, tmp_path):
    refs = spark.createDataFrame([(1, 5, 2, "val", ["red", "the red one"]), (2, 6, 2, "train", ["x"])], "ref_id long, ann_id long, image_id long, split string, sentences array<string>")
    boxes = spark.createDataFrame([(5, 2, 1.0), (6, 2, 2.0)], "ann_id long, image_id long, x1 double")
    images = spark.createDataFrame([(2, "a.jpg")], "image_id long, file_name string")
    assert [(r.text, r.x1) for r in G.referring_samples(refs, boxes, images, "val", "select_first").collect()] == [("red", 1.0)]
    assert {r.text for r in G.referring_samples(refs, boxes, images, "val", "original").collect()} == {"red", "the red one"}
    assert G.referring_samples(refs, boxes, images, "val", "random").first().text in ("red", "the red one")
    path = put(tmp_path / "m.json", {"images": [{"id": 4, "file_name": "z.jpg", "caption": " A Red Kite ", "dataset_name": "d"}], "annotations": []})
    assert G.read_mdetr(spark, path).first().text == "a red kite"
    path = put(tmp_path / "f.json", {
        "images": [{"id": 4, "caption": "a red kite flies", "tokens_positive_eval": [[[2, 10]], [[11, 16]]]}],
        "annotations": [{"image_id": 4, "phrase_ids": [7], "bbox": [0, 0, 2, 3]}, {"image_id": 4, "phrase_ids": [9, 7], "bbox": [1, 1, 2, 3]}]})
    phrases, rows = G.read_flickr(spark, path)
    assert [r.phrase for r in phrases.orderBy("nth").collect()] == ["red kite", "flies"]
    assert sorted((r.phrase_id, r.phrase_label, r.x2) for r in rows.collect()) == [(7, 0, 2.0), (7, 0, 3.0), (9, 1, 3.0)]
    out = G.described_objects(spark.createDataFrame([(1, 3)], "image_id long, group_id long"), spark.createDataFrame([(3, [1, 2])], "group_id long, sent_ids array<long>"),
                              spark.createDataFrame([(1, "one"), (2, "two")], "sent_id long, raw_sent string"), spark.createDataFrame([(1, 2, 5.0)], "image_id long, sent_id long, x1 double"))
    assert sorted((r.label, r.x1) if r.x1 else (r.label, 0) for r in out.collect()) == [(0, 0), (1, 5.0)]
