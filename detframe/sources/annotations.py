"""Readers of annotation files into flat tables.

Each reader returns DataFrames with explicit schemas; a path may be a file, a folder or a glob of shards.
One JSON document is one task by nature, so large sets should come as shards and be landed as Parquet once.
Ids stay what the format has (numbers or strings); boxes are four double columns ``x1, y1, x2, y2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.plans.sized import broadcast_if_small

_IMAGE = ("struct<id: long, file_name: string, coco_url: string, height: long, width: long, video_id: long, frame_id: long, "
          "mot_frame_id: long, caption: string, dataset_name: string, data_source: string, original_id: long, "
          "tokens_negative: array<array<long>>, neg_category_ids: array<long>, not_exhaustive_category_ids: array<long>, tokens_positive_eval: array<array<array<long>>>>")
_SEGMENT = "struct<id: long, category_id: long, iscrowd: long, bbox: array<double>, area: double>"
_ANNOTATION = ("struct<id: long, image_id: long, category_id: long, bbox: array<double>, area: double, iscrowd: long, ignore: long, score: double, "
               "instance_id: long, mot_instance_id: long, video_id: long, visibility: double, mot_conf: double, caption: string, phrase_ids: array<long>, "
               f"tokens_positive: array<array<long>>, segmentation: string, segments_info: array<{_SEGMENT}>, file_name: string>")
_CATEGORY = "struct<id: long, name: string, supercategory: string, frequency: string, isthing: long>"
COCO_SCHEMA = (f"images array<{_IMAGE}>, annotations array<{_ANNOTATION}>, categories array<{_CATEGORY}>, videos array<struct<id: long, name: string, width: long, height: long, fps: double>>")
from detframe.session import cut_lineage


def xywh(col: Column) -> B.Box:
    return B.xywh_to_xyxy(col[0], col[1], col[2], col[3])


def read_json_lists(spark: SparkSession, path: str, schema: str = COCO_SCHEMA) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)


def _rows(doc: DataFrame, name: str) -> DataFrame:
    return doc.select(F.posexplode(name).alias("pos", "r")).select("pos", "r.*")


def _labelled(categories: DataFrame, classes: Sequence[str] | None, by_id: bool) -> DataFrame:
    """Add ``label``: rank among the wanted names, in file order or by id."""
    kept = categories if classes is None else categories.where(F.col("name").isin(list(classes)))
    order = Window.partitionBy(F.lit(0)).orderBy("category_id" if by_id else "pos")  # a dimension table
    return kept.withColumn("label", F.row_number().over(order) - 1)


def read_coco(spark: SparkSession, path: str, classes: Sequence[str] | None = None, prefix: str = "", by_id: bool = False,
              drop_root_supercategory: bool = False, url_names: bool = False, path_parts: int | None = None) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of COCO-style JSON.

    ``by_id`` numbers labels by category id (Objects365). ``url_names`` takes file names from ``coco_url`` (LVIS v1).
    ``path_parts`` keeps the last parts of a file name. ``drop_root_supercategory`` drops classes without a parent
    when the file has more classes than asked for.
    """
    doc = read_json_lists(spark, path)
    cats = _rows(doc, "categories").withColumnRenamed("id", "category_id")
    if drop_root_supercategory and classes is not None and cats.count() != len(classes):
        cats = cats.where(F.coalesce("supercategory", F.lit("")) != "none")
        classes = None
    categories = _labelled(cats, classes, by_id)
    name = F.regexp_replace("coco_url", r"^https?://[^/]+/", "") if url_names else F.col("file_name")
    if path_parts:
        name = F.array_join(F.slice(F.split(name, "/"), -F.least(F.lit(path_parts), F.size(F.split(name, "/"))), path_parts), "/")
    images = (_rows(doc, "images").withColumnRenamed("id", "image_id").withColumn("file_name", name)
              .withColumn("img_path", F.concat(F.lit(prefix), "file_name")).drop("pos"))
    box = xywh(F.col("bbox"))
    flag = (F.coalesce("iscrowd", F.lit(0)) == 1).cast("int")
    ann = _rows(doc, "annotations").withColumnRenamed("id", "ann_id").select(
        "*", *B.named(box), flag.alias("ignore_flag"))
    ann = ann.join(broadcast_if_small(categories.select("category_id", "label")), "category_id", "left").drop("pos")
    return {"images": images, "annotations": ann, "categories": categories.drop("pos")}


def read_lvis(spark: SparkSession, path: str, version: str = "v1", **options) -> dict[str, DataFrame]:
    return read_coco(spark, path, url_names=version == "v1", **options)


def read_objects365(spark: SparkSession, path: str, version: str = "v1", ignore: Sequence[str] = (), **options) -> dict[str, DataFrame]:
    """Labels follow the id order; v2 keeps the last two parts of file names and skips listed files."""
    out = read_coco(spark, path, by_id=True, path_parts=2 if version == "v2" else None, **options)
    if ignore:
        out["images"] = out["images"].where(~F.col("file_name").isin(list(ignore)))
    return out


def read_coco_panoptic(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``segments`` keyed by (image_id, segment_id): segment ids repeat between images. Crowd things are ignored."""
    doc = read_json_lists(spark, path)
    cats = _rows(doc, "categories").select(F.col("id").alias("category_id"), "name", (F.coalesce("isthing", F.lit(1)) == 1).alias("is_thing"))
    rows = _rows(doc, "annotations").select("image_id", "file_name", F.explode("segments_info").alias("s"))
    seg = rows.select("image_id", F.col("file_name").alias("seg_file"), F.col("s.id").alias("segment_id"), F.col("s.category_id").alias("category_id"),
                      F.col("s.area").alias("area"), F.coalesce("s.iscrowd", F.lit(0)).alias("iscrowd"), *B.named(xywh(F.col("s.bbox"))))
    seg = seg.join(broadcast_if_small(cats.select("category_id", "is_thing")), "category_id", "left")
    seg = seg.withColumn("ignore_flag", (F.col("is_thing") & (F.col("iscrowd") == 1)).cast("int")).withColumn("is_thing", F.col("is_thing") & (F.col("iscrowd") == 0))
    return {"images": _rows(doc, "images").withColumnRenamed("id", "image_id").drop("pos"), "segments": seg, "categories": cats}


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, captions)``."""
    rows = _rows(read_json_lists(spark, path), "annotations")
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("caption")))).alias("c")).select(
        "image_id", F.col("c.caption").alias("captions"))


def read_coco_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored detections; area defaults to width times height. ``det_id`` follows file order inside each file."""
    schema = ("image_id long, category_id long, bbox array<double>, score double, area double, id long, segmentation string")
    raw = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("_i", F.monotonically_increasing_id() + 1)
    return raw.select(F.coalesce("id", "_i").alias("det_id"), "image_id", "category_id", "score", "segmentation",
                      F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), *B.named(xywh(F.col("bbox"))))


def read_proposals(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """Stored proposals ``(file, x1..y2, score)`` joined to images on the last two parts of the path."""
    def tail(c: str) -> Column:
        return F.regexp_extract(c, r"([^/]*/)?[^/]*$", 0)
    rows = spark.read.json(path, schema="file string, x1 double, y1 double, x2 double, y2 double, score double")
    return rows.withColumn("_k", tail("file")).join(images.select("image_id", tail("img_path").alias("_k")), "_k").drop("_k")


_VOC = (
    "folder string, filename string, size struct<width: long, height: long>, "
    "object array<struct<name: string, difficult: long, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>")


def read_voc(spark: SparkSession, path: str, classes: Sequence[str], minus_one: bool = True, min_size: float | None = None,
             folder_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """VOC-style XML: (images, annotations); the file stem is the image id.

    Coordinates become whole numbers, minus 1 if ``minus_one``. Difficult or too small boxes are flagged as ignored;
    unknown classes are dropped. ``folder_paths`` prefixes the folder tag (WIDER Face).
    """
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(_VOC).load(path).withColumn(
        "image_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1))
    name = F.concat_ws("/", "folder", F.concat("image_id", F.lit(".jpg"))) if folder_paths else F.concat("image_id", F.lit(".jpg"))
    images = raw.select("image_id", name.alias("img_path"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    rows = raw.select("image_id", F.posexplode("object").alias("pos", "o")).where(F.col("o.name").isin(list(classes)))
    labels = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))])
    box = [F.floor(F.col(f"o.bndbox.{c}")).cast("double") - F.lit(1.0 if minus_one else 0.0) for c in ("xmin", "ymin", "xmax", "ymax")]
    ann = rows.select("image_id", "pos", F.element_at(labels, F.col("o.name")).alias("label"), F.col("o.name").alias("name"),
                      F.coalesce("o.difficult", F.lit(0)).alias("difficult"), *B.named(box))
    small = F.lit(False) if min_size is None else (F.col("x2") - F.col("x1") < min_size) | (F.col("y2") - F.col("y1") < min_size)
    return images, ann.withColumn("ignore_flag", ((F.col("difficult") == 1) | small).cast("int"))


def read_wider_face(spark: SparkSession, path: str, classes: Sequence[str] = ("face",), min_size: float | None = None):
    return read_voc(spark, path, classes, minus_one=False, min_size=min_size, folder_paths=True)


_ODGT = ("ID string, gtboxes array<struct<tag: string, fbox: array<double>, hbox: array<double>, vbox: array<double>, extra: struct<ignore: long, box_id: long>>>")


def read_crowdhuman(spark: SparkSession, path: str, sizes: DataFrame | None = None, classes: Sequence[str] = ("person",)) -> DataFrame:
    """Boxes of odgt lines: full box as ``x1..y2``, head and visible boxes as arrays; ignored ones get label -1."""
    rows = spark.read.schema(_ODGT).json(path).select(F.col("ID").alias("image_id"), F.posexplode("gtboxes").alias("pos", "b"))
    ignored = ~F.col("b.tag").isin(list(classes)) | (F.coalesce("b.extra.ignore", F.lit(0)) != 0)
    labels = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))])

    def corners(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.array(*xywh(F.col(c))))
    out = rows.select("image_id", "pos", F.when(ignored, -1).otherwise(F.element_at(labels, F.col("b.tag"))).alias("label"),
                      ignored.cast("int").alias("ignore_flag"), *B.named(xywh(F.col("b.fbox"))), corners("b.hbox").alias("head"), corners("b.vbox").alias("visible"),
                      F.col("b.extra.ignore").alias("extra_ignore"))
    return out if sizes is None else out.join(sizes, "image_id", "left")


def read_occlusion_subset(spark: SparkSession, path: str, subset: str) -> DataFrame:
    """``(subset, position, file_name, category, x1..y2, height, width, counts)`` of a list ``[[file, class, _, bbox, rle, ..], ..]``.

    Boxes of the subset "occluded" are xywh, others are corners. ``counts`` is the compressed run-length text. The list is one
    JSON document, hence one task.
    """
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("position", "r"))
    box, mask = F.from_json(F.col("r")[3], "array<double>"), F.from_json(F.col("r")[4], "struct<size: array<long>, counts: string>")
    read = rows.select(F.lit(subset).alias("subset"), F.col("position").cast("long").alias("position"), F.col("r")[0].alias("file_name"),
                       F.col("r")[1].alias("category"), box.alias("b"), mask.alias("m"))
    corners = xywh(F.col("b")) if subset == "occluded" else [F.col("b")[i] for i in range(4)]
    return read.select("subset", "position", "file_name", "category", *B.named(corners), F.col("m.size")[0].alias("height"),
                       F.col("m.size")[1].alias("width"), F.col("m.counts").alias("counts"))


def read_openimages(spark: SparkSession, path: str, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Box CSV with normalised coordinates, scaled by ``sizes(image_id, width, height)``; ``labels(mid, label)``."""
    flags = ["IsOccluded", "IsTruncated", "IsGroupOf", "IsDepiction", "IsInside"]
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(F.col("ImageID").alias("image_id"), F.col("LabelName").alias("mid"), F.col("Confidence").cast("double").alias("confidence"),
                      *[F.col(c).cast("double") for c in ("XMin", "XMax", "YMin", "YMax")], *[(F.col(c).cast("int") == 1).alias(c) for c in flags])
    both = rows.join(broadcast_if_small(labels.select("mid", "label")), "mid").join(sizes, "image_id")
    w, h = F.col("width"), F.col("height")
    return both.select("image_id", "label", "confidence", (F.col("XMin") * w).alias("x1"), (F.col("YMin") * h).alias("y1"),
                       (F.col("XMax") * w).alias("x2"), (F.col("YMax") * h).alias("y2"), F.col("IsOccluded").alias("is_occluded"),
                       F.col("IsTruncated").alias("is_truncated"), F.col("IsGroupOf").alias("is_group_of"), F.col("IsDepiction").alias("is_depiction"), F.col("IsInside").alias("is_inside"))


def read_openimages_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Challenge text: blocks of path, a line, a count, then ``label x1 y1 x2 y2 group`` lines; labels start at 1.

    The block structure is read with window functions over line numbers: a line without blanks opens a block
    and following lines with six fields belong to it.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v"))
    head = F.when(~F.col("v").rlike(r"^-?\d+$") & (F.size(F.split("v", r"\s+")) == 1), F.col("v"))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = F.split("v", r"\s+")
    rows = lines.withColumn("image_path", F.last(head, ignorenulls=True).over(order)).where(F.size(parts) == 6)
    return rows.select("image_path", F.regexp_extract("image_path", r"([^/]+?)(\.[^.]*)?$", 1).alias("image_id"), (parts[0].cast("int") - 1).alias("label"),
                       *[parts[i].cast("double").alias(c) for i, c in enumerate(("nx1", "ny1", "nx2", "ny2"), 1)], (parts[5].cast("int") == 1).alias("is_group_of"))


def read_label_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``(mid, name, label)``: CSV without header; a third column, when present, holds the 1-based label."""
    raw = spark.read.csv(path).withColumn("_n", F.monotonically_increasing_id())
    order = Window.partitionBy(F.lit(0)).orderBy("_n")  # a dimension table
    label = F.col("_c2").cast("int") - 1 if "_c2" in raw.columns else F.row_number().over(order) - 1
    return raw.select(F.col("_c0").alias("mid"), F.col("_c1").alias("name"), label.alias("label"))


def read_image_labels(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Image-level labels: confidence 1 means verified present, 0 verified absent."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("ImageID").alias("image_id"), F.col("LabelName").alias("mid"), F.col("Confidence").cast("double").alias("confidence")).join(
        broadcast_if_small(labels.select("mid", "label")), "mid").drop("mid")


def hierarchy_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)`` of a nested Subcategory tree of any depth, one JSON level per step; the root has no pairs of its own."""
    level = spark.read.text(path, wholetext=True).select(F.col("value").alias("node"))
    root = level.select(F.get_json_object("node", "$.LabelName").alias("root"))
    edges = None
    while True:
        child = level.select(F.get_json_object("node", "$.LabelName").alias("parent"), F.explode_outer(F.from_json(
            F.get_json_object("node", "$.Subcategory"), "array<string>")).alias("node")).where("node IS NOT NULL")
        child = cut_lineage(child)
        if edges is not None and child.isEmpty():
            break
        step = child.select(F.get_json_object("node", "$.LabelName").alias("child"), "parent")
        edges = step if edges is None else edges.unionByName(step)
        level = child.select("node")
    return edges.join(root.withColumnRenamed("root", "parent"), "parent", "left_anti").select("child", "parent").unionByName(
        edges.join(root.withColumnRenamed("root", "parent"), "parent", "left_semi").select("child", F.lit(None).cast("string").alias("parent")))


def closure(edges: DataFrame) -> DataFrame:
    """``(child, ancestor)`` of ``edges(child, parent)``, each class with itself; rows with a NULL parent only name a class.

    Paths are doubled until no pair is new, so any depth is covered and a cycle ends too.
    """
    known = edges.select("child", F.col("child").alias("ancestor")).unionByName(edges.where("parent IS NOT NULL").select("child", F.col("parent").alias("ancestor")))
    pairs, n = cut_lineage(known.distinct()), 0
    while (now := pairs.count()) != n:
        n = now
        onward = pairs.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_next"))
        pairs = cut_lineage(pairs.unionByName(pairs.join(onward, "ancestor").select("child", F.col("_next").alias("ancestor"))).distinct())
    return pairs


def read_dsdl(spark: SparkSession, path: str, classes: Sequence[str]) -> DataFrame:
    """Boxes of ``samples[]``: images without boxes disappear; ``label`` is the position in the class list."""
    schema = ("samples array<struct<media: struct<media_path: string, image_shape: struct<width: long, height: long>, media_shape: array<long>>, "
              "annotations: array<struct<category: string, label: string, bbox: array<double>, iscrowd: boolean, ignore_flag: boolean>>>>")
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    rows = doc.select(F.posexplode("samples").alias("image_id", "s")).select("image_id", F.col("s.media.media_path").alias("img_path"), F.explode("s.annotations").alias("a"))
    name = F.coalesce("a.label", "a.category")
    labels = F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))])
    return rows.select("image_id", "img_path", F.element_at(labels, name).alias("label"), (F.coalesce("a.iscrowd", F.lit(False)) | F.coalesce("a.ignore_flag", F.lit(False))).cast("int").alias("ignore_flag"),
                       *B.named(xywh(F.col("a.bbox")))).where("label IS NOT NULL")
