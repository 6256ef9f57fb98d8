"""Readers of tracking text files, video annotation files, and identity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.sources.annotations import read_json_lists

_MOT = "frame long, id long, x double, y double, w double, h double, c6 double, c7 double, c8 double"
VIDEO_OF = r"([^/]+)/(?:gt|det)/[^/]+$"


def read_mot(spark: SparkSession, path: str, kind: str = "gt", mot15: bool = False) -> DataFrame:
    """Rows of MOT text files under ``<video>/gt`` or ``<video>/det``; boxes become corners.

    Truth: confidence, class and visibility (all 1 in the oldest format). Detections: score.
    """
    raw = spark.read.schema(_MOT).csv(path).withColumn("video", F.regexp_extract(F.input_file_name(), VIDEO_OF, 1))
    base = raw.select("video", F.col("frame").alias("frame_id"), F.col("id").alias("instance_id"), *B.named(B.xywh_to_xyxy(*(F.col(c) for c in "xywh"))), "c6", "c7", "c8")
    if kind == "det":
        return base.withColumnRenamed("c6", "score").drop("c7", "c8", "instance_id")
    if mot15:
        return base.drop("c6", "c7", "c8").withColumns({"conf": F.lit(1.0), "class_id": F.lit(1).cast("long"), "visibility": F.lit(1.0)})
    return base.withColumn("class_id", F.col("c7").cast("long")).withColumnsRenamed({"c6": "conf", "c8": "visibility"}).drop("c7")


def read_seqinfo(spark: SparkSession, path: str) -> DataFrame:
    """``(video, name, frame_rate, length, width, height)`` from ini files."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/seqinfo\.ini$", 1).alias("video"),
                                         F.regexp_extract("value", r"^\s*(\w+)\s*=", 1).alias("k"), F.trim(F.regexp_extract("value", r"=\s*(.*)$", 1)).alias("v")).where("k <> ''")
    wide = lines.groupBy("video").pivot("k", ["name", "frameRate", "seqLength", "imWidth", "imHeight"]).agg(F.first("v"))
    return wide.select("video", "name", *[F.col(a).cast("long").alias(b) for a, b in (("frameRate", "frame_rate"), ("seqLength", "length"), ("imWidth", "width"), ("imHeight", "height"))])


def read_video_coco(spark: SparkSession, path: str, visibility_thr: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, instances) of COCO-style video JSON.

    Images without a video get ids from 100001 on. ``visibility_thr`` drops barely visible boxes (training).
    An ``instance_id`` of 0 or none is replaced by the position of the annotation in its image.
    """
    doc = read_json_lists(spark, path)
    frames = doc.select(F.posexplode("images").alias("_p", "i")).select("_p", F.col("i.id").alias("image_id"), F.col("i.video_id").alias("video_id"),
                                                                       F.col("i.frame_id").alias("frame_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    alone = F.col("video_id").isNull()
    frames = frames.withColumns({"video_id": F.coalesce("video_id", F.lit(100001) + F.col("_p")), "frame_id": F.when(alone, F.lit(0)).otherwise(F.col("frame_id"))}).drop("_p")
    length = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("video_length"))
    ann = doc.select(F.posexplode("annotations").alias("_p", "a")).select("_p", "a.*").withColumnRenamed("id", "ann_id")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("_p")) - 1
    ann = ann.withColumn("instance_id", F.coalesce(F.nullif("instance_id", F.lit(0)), rank.cast("long"))).withColumn("ignore_flag", (F.coalesce("iscrowd", F.lit(0)) == 1).cast("int"))
    if visibility_thr is not None:
        ann = ann.where(F.coalesce("visibility", F.lit(1.0)) >= visibility_thr)
    box = B.xywh_to_xyxy(*(F.col("bbox")[i] for i in range(4)))
    out = ann.select("ann_id", "image_id", "category_id", "instance_id", "ignore_flag", "visibility", "mot_conf", *B.named(box))
    return frames.join(length, "video_id"), out.join(frames.select("image_id", "video_id", "frame_id"), "image_id")


_VIS = ("annotations array<struct<id: long, video_id: long, category_id: long, iscrowd: long, bboxes: array<array<double>>, areas: array<double>, segmentations: array<string>>>")


def read_youtube_vis(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows of per-track arrays; frames where a track is absent have no row."""
    doc = read_json_lists(spark, path, _VIS)
    rows = doc.select(F.explode("annotations").alias("a")).select(
        F.col("a.id").alias("instance_id"), F.col("a.video_id").alias("video_id"), F.col("a.category_id").alias("category_id"),
        F.posexplode(F.arrays_zip(F.col("a.bboxes").alias("b"), F.col("a.areas").alias("area"), F.col("a.segmentations").alias("seg"))).alias("frame_id", "f"))
    return rows.where("f.b IS NOT NULL").select("video_id", "instance_id", "category_id", "frame_id", F.col("f.area").alias("area"), F.col("f.seg").alias("segmentation"),
                                                *B.named(B.xywh_to_xyxy(*(F.col("f.b")[i] for i in range(4)))))


def read_identity_list(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``path pid`` lines."""
    return spark.read.schema("path string, pid long").option("sep", " ").csv(path).withColumn("img_path", F.concat(F.lit(prefix), "path"))
