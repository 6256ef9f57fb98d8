import json
import struct

import pytest

from detframe.sources import annotations as A
from detframe.sources import files as L
from detframe.sources import grounding as G
from detframe.sources import video as V


@pytest.fixture()
def coco(tmp_path):
    doc = {"images": [{"id": 7, "file_name": "a/b/c.jpg", "coco_url": "http://host/train/c.jpg", "height": 50, "width": 60}, {"id": 8, "file_name": "d.jpg", "height": 5, "width": 6}],
           "annotations": [{"id": 1, "image_id": 7, "category_id": 5, "bbox": [1, 2, 10, 20], "area": 200, "iscrowd": 0},
                           {"id": 2, "image_id": 7, "category_id": 3, "bbox": [0, 0, 4, 4], "area": 16, "iscrowd": 1}],
           "categories": [{"id": 5, "name": "car", "supercategory": "vehicle"}, {"id": 3, "name": "bus", "supercategory": "none"}]}
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_coco_labels_in_file_and_id_order(spark, coco):
    out = A.read_coco(spark, coco, ["car", "bus"], prefix="img/")
    assert {r.name: r.label for r in out["categories"].collect()} == {"car": 0, "bus": 1}
    row = out["annotations"].where("ann_id = 1").first()
    assert (row.x1, row.y1, row.x2, row.y2, row.ignore_flag, row.label) == (1, 2, 11, 22, 0, 0)
    assert out["images"].where("image_id = 7").first().img_path == "img/a/b/c.jpg"
    assert {r.name: r.label for r in A.read_objects365(spark, coco, "v2")["categories"].collect()} == {"bus": 0, "car": 1}
    assert A.read_objects365(spark, coco, "v2")["images"].where("image_id = 7").first().file_name == "b/c.jpg"
    assert A.read_lvis(spark, coco)["images"].where("image_id = 7").first().file_name == "train/c.jpg"
    assert A.read_coco(spark, coco, ["car"], drop_root_supercategory=True)["categories"].count() == 1


def test_voc(spark, tmp_path):
    (tmp_path / "sheet_a.xml").write_text(
        "<annotation><filename>sheet_a.png</filename><size><width>640</width><height>410</height></size>"
        "<object><name>kite</name><difficult>0</difficult><bndbox><xmin>31</xmin><ymin>7</ymin><xmax>90</xmax><ymax>66</ymax></bndbox></object>"
        "<object><name>barge</name><difficult>0</difficult><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>20</xmax><ymax>25</ymax></bndbox></object>"
        "<object><name>kite</name><difficult>1</difficult><bndbox><xmin>101</xmin><ymin>202</ymin><xmax>303</xmax><ymax>404</ymax></bndbox></object></annotation>")
    images, ann = A.read_voc(spark, str(tmp_path), ["kite"])
    assert images.first().width == 640
    rows = sorted((r.x1, r.y1, r.x2, r.y2, r.label, r.ignore_flag) for r in ann.collect())
    assert rows == [(30, 6, 89, 65, 0, 0), (100, 201, 302, 403, 0, 1)]


def test_crowdhuman(spark, tmp_path):
    path = tmp_path / "a.odgt"
    path.write_text(json.dumps({"ID": "x", "gtboxes": [{"tag": "person", "fbox": [1, 2, 3, 4], "hbox": [1, 2, 1, 1], "extra": {"ignore": 1}},
                                                       {"tag": "person", "fbox": [0, 0, 5, 5], "extra": {}}, {"tag": "mask", "fbox": [0, 0, 5, 5]}]}) + "\n")
    rows = A.read_crowdhuman(spark, str(path)).orderBy("pos").collect()
    assert [(r.label, r.ignore_flag) for r in rows] == [(-1, 1), (0, 0), (-1, 1)]
    assert rows[0].head == [1, 2, 2, 3]


def test_openimages_blocks_and_hierarchy(spark, tmp_path):
    blocks = tmp_path / "boxes.txt"
    blocks.write_text("dir/one.jpg\n-1\n2\n1 0.1 0.2 0.3 0.4 0\n3 0 0 1 1 1\ndir/two.jpg\n-1\n1\n2 0 0 0.5 0.5 0\n")
    rows = A.read_openimages_blocks(spark, str(blocks)).orderBy("image_id", "label").collect()
    assert [(r.image_id, r.label, r.is_group_of) for r in rows] == [("one", 0, False), ("one", 2, True), ("two", 1, False)]
    tree = tmp_path / "tree.json"
    tree.write_text(json.dumps({"LabelName": "/root", "Subcategory": [{"LabelName": "a", "Subcategory": [{"LabelName": "b"}, {"LabelName": "c"}]}, {"LabelName": "d"}]}))
    pairs = {(r.child, r.ancestor) for r in A.closure(A.hierarchy_edges(spark, str(tree))).collect()}
    assert pairs == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("b", "a"), ("c", "a")}


def test_grounding(spark, tmp_path):
    path = tmp_path / "vg.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (
        {"filename": "a", "height": 50, "width": 50, "grounding": {"caption": "a red car", "regions": [
            {"bbox": [[0, 0, 10, 10], [5, 5, 20, 20]], "phrase": "car", "tokens_positive": [[6, 9]]}, {"bbox": [60, 60, 70, 70], "phrase": "sky", "tokens_positive": [[0, 1]]}]}},
        {"filename": "b", "height": 50, "width": 50, "detection": {"instances": [{"bbox": [1, 1, 9, 9], "label": 4, "category": "dog"}]}})))
    od, vg = G.read_odvg(spark, str(path))
    assert [(r.label, r.x2) for r in od.collect()] == [(4, 9.0)]
    assert sorted((r.phrase, r.x2) for r in vg.collect()) == [("car", 10.0), ("car", 20.0)]


def test_mot_files(spark, tmp_path):
    (tmp_path / "V1" / "gt").mkdir(parents=True)
    (tmp_path / "V1" / "gt" / "gt.txt").write_text("1,5,10,20,30,40,1,1,0.8\n2,5,11,20,30,40,1,7,0.1\n")
    (tmp_path / "V1" / "seqinfo.ini").write_text("[Sequence]\nname=V1\nimDir=img1\nframeRate=30\nseqLength=2\nimWidth=640\nimHeight=480\n")
    rows = V.read_mot(spark, str(tmp_path / "*" / "gt")).orderBy("frame_id").collect()
    assert [(r.video, r.instance_id, r.x2, r.class_id, r.visibility) for r in rows] == [("V1", 5, 40.0, 1, 0.8), ("V1", 5, 41.0, 7, 0.1)]
    info = V.read_seqinfo(spark, str(tmp_path / "*" / "seqinfo.ini")).first()
    assert (info.video, info.frame_rate, info.width) == ("V1", 30, 640)


def test_image_headers_and_logs(spark, tmp_path):
    png = tmp_path / "img" / "a.png"
    png.parent.mkdir()
    png.write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 12, 34) + b"\0" * 8)
    row = L.image_sizes(spark, str(png.parent)).first()
    assert (row.file_name, row.width, row.height) == ("a.png", 12, 34)
    log = tmp_path / "log.json"
    log.write_text('{"lr": 0.1}\n{"epoch": 1, "iter": 10, "loss": 0.5, "time": 0.2}\n{"coco/bbox_mAP": 0.4, "step": 1}\n')
    rows = L.read_train_logs(spark, str(log)).orderBy("line_no").collect()
    assert [(r.epoch, r.loss, r.is_val) for r in rows] == [(1, 0.5, False), (None, None, True)]
