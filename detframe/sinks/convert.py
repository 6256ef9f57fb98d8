"""Reshaping tables into the layouts of other formats, and writing them.

Everything up to the write is a DataFrame; files are written by Spark, one or more parts per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions.hashing import hash_key
from detframe.plans.ordered import dense_ids, running_sums
from detframe.plans.sized import broadcast_if_small


# ---- results ------------------------------------------------------------------------------------------

def coco_results(det: DataFrame, categories: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """``(image_id, category_id, bbox xywh, score, extra..)``; labels go back to category ids through ``categories(label, category_id)``."""
    rows = det if categories is None else det.drop("category_id").join(broadcast_if_small(categories.select("label", "category_id")), "label")
    return rows.select("image_id", "category_id", F.array(*B.xyxy_to_xywh(B.box())).alias("bbox"), "score", *extra)


def coco_dataset(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations renumbered from 1, with the area of the box unless a mask area is given."""
    new_images = dense_ids(images, "image_id", "new_id")
    area = F.col("area") if "area" in annotations.columns else B.area(B.box())
    rows = annotations.withColumn("area", area).join(new_images.select("image_id", F.col("new_id").alias("new_image_id")), "image_id")
    return new_images, dense_ids(rows, "ann_id", "new_id")


def proposals(det: DataFrame, num_max: int) -> DataFrame:
    """Best ``num_max`` per image."""
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "det_id")
    return det.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= num_max)


def mot_lines(tracks: DataFrame) -> DataFrame:
    """``(video_id, frame_id, track_id, line)``: frame from 1, id, box as xywh, score, three -1."""
    x, y, w, h = B.xyxy_to_xywh(B.box())
    line = F.format_string("%d,%d,%.3f,%.3f,%.3f,%.3f,%.3f,-1,-1,-1", F.col("frame_id") + 1, F.col("track_id"), x, y, w, h, F.col("score"))
    return tracks.select("video_id", "frame_id", "track_id", line.alias("line"))


def write_mot(tracks: DataFrame, path: str) -> None:
    """Text files in one folder per video, lines in frame order."""
    (mot_lines(tracks).repartition("video_id").sortWithinPartitions("video_id", "frame_id", "track_id")
     .select("video_id", F.col("line").alias("value")).write.partitionBy("video_id").mode("overwrite").text(path))


def youtube_vis_results(tracks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per (video, track): mean score, majority label + 1, and one entry per frame with NULL where absent."""
    from detframe.operators.tracks import track_results

    summary = track_results(tracks)
    frames = lengths.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("video_length") - 1)).alias("frame_id"))
    grid = summary.select("video_id", "track_id").join(frames, "video_id")
    full = grid.join(tracks.select("video_id", "track_id", "frame_id", F.array(*B.xyxy_to_xywh(B.box())).alias("bbox")), ["video_id", "track_id", "frame_id"], "left")
    boxes = full.groupBy("video_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "bbox"))).alias("b"))
    return summary.join(boxes, ["video_id", "track_id"]).select("video_id", "track_id", "score", (F.col("category_id") + 1).alias("category_id"), F.col("b.bbox").alias("bboxes"))


def panoptic_segments(runs: DataFrame, void: int = 0) -> DataFrame:
    """Labels present per image with their pixel count; void is skipped."""
    return runs.where(F.col("label") != void).groupBy("image_id", "label").agg(F.sum("length").alias("area"))


def instance_lines(det: DataFrame) -> DataFrame:
    """One line per instance: mask name, class id, score."""
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "det_id")
    n = F.row_number().over(order) - 1
    return det.select("image_id", F.format_string("%d_%d_%d.png %d %.6f", "image_id", n, "category_id", "category_id", "score").alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ---- grounding layouts -------------------------------------------------------------------------------

def to_odvg(images: DataFrame, annotations: DataFrame, label_map: DataFrame, skip: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """One record per image with nested instances.

    Ignored, crowd, outside, empty and sub-pixel boxes and unknown classes are dropped; ``label_map(category_id,
    label, category)`` is contiguous; images in ``skip`` (known to be missing) are left out.
    """
    live = images if skip is None else images.join(skip.select("image_id"), "image_id", "left_anti")
    rows = annotations.join(live.select("image_id", "width", "height"), "image_id").join(broadcast_if_small(label_map), "category_id")
    area = F.col("area") if "area" in annotations.columns else B.area(B.box())
    kept = rows.where(B.valid_annotation(B.box(), area, F.col("width"), F.col("height")) & (F.coalesce("iscrowd", F.lit(0)) == 0))
    instance = F.struct("ann_id", F.array(*B.box()).alias("bbox"), "label", "category")
    nested = kept.groupBy("image_id").agg(F.sort_array(F.collect_list(instance)).alias("i"))
    name = F.concat(F.lit(prefix), "file_name")
    return live.join(nested, "image_id", "left").select("image_id", name.alias("filename"), "height", "width", F.struct(
        F.transform(F.coalesce("i", F.array()), lambda x: F.struct(x["bbox"].alias("bbox"), x["label"].alias("label"), x["category"].alias("category"))).alias("instances")).alias("detection"))


def dump_odvg(det: DataFrame, images: DataFrame, categories: DataFrame, score_thr: float, nms_thr: float) -> DataFrame:
    """Predictions as grounding records: score filter, suppression per class, values rounded to two places."""
    from detframe.operators.suppression import nms

    kept = nms(det.where(F.col("score") > score_thr), nms_thr).join(broadcast_if_small(categories.select("category_id", F.col("name").alias("category"))), "category_id")
    instance = F.struct("det_id", F.array(*[F.round(c, 2) for c in B.COORDS]).alias("bbox"), F.round("score", 2).alias("score"), F.col("category_id").alias("label"), "category")
    return images.join(kept.groupBy("image_id").agg(F.sort_array(F.collect_list(instance)).alias("instances")), "image_id", "left")


def openimages_to_odvg(rows: DataFrame) -> DataFrame:
    """Clip boxes to the image and drop group boxes; judged by the box's own size."""
    clipped = rows.where(~F.col("is_group_of")).withColumns({c: v for c, v in zip(B.COORDS, B.clip(B.box(), F.col("width"), F.col("height")))})
    return clipped.where((B.width(B.box()) >= 1) & (B.height(B.box()) >= 1))


def merged_spans(spans: Column) -> Column:
    """Sorted ``[start, end)`` spans with neighbours at most one character apart joined."""
    ordered = F.array_sort(spans)
    empty = F.array().cast("array<array<bigint>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s[0] <= last[1] + 1)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, empty, add)


def span_text(text: Column, spans: Column) -> Column:
    """Text of the spans, joined by blanks."""
    return F.array_join(F.transform(spans, lambda s: F.substring(text, (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int"))), " ")


def goldg_regions(annotations: DataFrame, captions: DataFrame) -> DataFrame:
    """``(image_id, phrase, spans, boxes)``: annotations of one phrase grouped; images with only boxes up to one pixel drop out.

    ``annotations(image_id, ann_id, tokens_positive, x1..y2)``, ``captions(image_id, text)``.
    """
    rows = annotations.join(captions, "image_id").withColumn("spans", merged_spans(F.col("tokens_positive")))
    rows = rows.withColumn("phrase", span_text(F.col("text"), F.col("spans")))
    good = rows.groupBy("image_id").agg(F.max((F.least(B.width(B.box()), B.height(B.box())) > 1).cast("int")).alias("_ok")).where("_ok = 1")
    boxes = F.sort_array(F.collect_list(F.struct("ann_id", F.array(*B.box()).alias("b"))))
    return rows.join(good, "image_id", "left_semi").groupBy("image_id", "phrase", "spans").agg(boxes.alias("_b")).select("image_id", "phrase", "spans", F.col("_b.b").alias("boxes"))


# fixed values: marks that a caption must not hold before its last character, and the tokens from which on it is too long
CAPTION_MARKS = ("↙️", "[CLS]", "[SEP]")
MAX_TOKENS = 240


def clean_captions(captions: DataFrame, text: str = "text") -> DataFrame:
    """Captions without a special mark and of less than ``MAX_TOKENS`` tokens, unchanged; null captions are dropped.

    The last character of the trimmed caption ends it and is not searched. Tokens are words.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.substring(trimmed, F.lit(1), F.greatest(F.length(trimmed) - 1, F.lit(0)))
    marked = F.lit(False)
    for mark in CAPTION_MARKS:
        marked = marked | body.contains(mark)
    return captions.where(~marked & (F.regexp_count(text, F.lit(r"\S+")) < MAX_TOKENS))


def merged_shards(stats: DataFrame, group: str, counts: Sequence[str]) -> DataFrame:
    """Sums over shard statistics."""
    return stats.groupBy(group).agg(*[F.sum(c).alias(c) for c in counts])


# ---- tracking layouts ---------------------------------------------------------------------------------

def half_split(frames: DataFrame) -> DataFrame:
    """Add ``part``: the first n // 2 + 1 frames of a video train, the rest validate."""
    order = Window.partitionBy("video_id").orderBy("frame_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    return frames.withColumn("part", F.when(F.row_number().over(order) <= F.floor(n / 2) + 1, "train").otherwise("val"))


def global_instances(tracks: DataFrame) -> DataFrame:
    """``(video_id, track_id, instance_id)``: ids 0.. over all videos in first-seen order."""
    first = tracks.groupBy("video_id", "track_id").agg(F.min("frame_id").alias("_f"))
    # per-video ranks plus the number of tracks in earlier videos: no global sort
    order = Window.partitionBy("video_id").orderBy("_f", "track_id")
    local = first.withColumn("_r", F.row_number().over(order))
    sizes = local.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    span = running_sums(sizes.withColumn("_u", F.lit(0.0)), [], "_u", "video_id", {"_c": F.col("_n")}, descending=False)
    return local.join(span.select("video_id", (F.col("_c") - F.col("_n")).alias("_o")), "video_id").select("video_id", "track_id", (F.col("_o") + F.col("_r") - 1).alias("instance_id"))


def identity_crops(boxes: DataFrame, visibility_thr: float, val_share: float, least: int, most: int, seed: int, classes: Sequence[int] = (1,)) -> DataFrame:
    """Crop rectangles per identity: ``boxes`` columns plus ``person`` and ``part``.

    Useless classes and barely visible boxes go; identities with fewer than ``least`` boxes go; at most ``most``
    are drawn from larger ones. Identities are split in name order: the first share trains, the rest validates.
    """
    kept = boxes.where(F.col("class_id").isin(list(classes)) & (F.col("visibility") >= visibility_thr))
    key = Window.partitionBy("video_id", "track_id")
    rank = F.row_number().over(key.orderBy(hash_key(seed, F.col("ann_id")), "ann_id"))
    drawn = kept.withColumn("_n", F.count(F.lit(1)).over(key)).where(F.col("_n") >= least).withColumn("_r", rank).where(F.col("_r") <= most)
    people = drawn.select("video_id", "track_id").distinct()
    # identities by video, then track: places within a video behind the identities of earlier videos
    local = people.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy("track_id")))
    sizes = local.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", F.lit(0.0))
    before = running_sums(sizes, [], "_u", "video_id", {"_c": F.col("_n")}, descending=False).select("video_id", (F.col("_c") - F.col("_n")).alias("_o"))
    people = local.join(before, "video_id").select("video_id", "track_id", (F.col("_o") + F.col("_r")).alias("person"))
    total = people.count()
    part = F.when(F.col("person") <= int((1 - val_share) * total), "train").otherwise("val")
    return drawn.join(people.select("video_id", "track_id", (F.col("person") - 1).alias("person"), part.alias("part")), ["video_id", "track_id"]).drop("_n", "_r")


def box_polygon(b: B.Box) -> Column:
    """Box as a four-point polygon."""
    return F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])


def voc_to_coco(annotations: DataFrame) -> DataFrame:
    x, y, w, h = B.xyxy_to_xywh(B.box())
    return annotations.select("ann_id", "image_id", "category_id", F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"), box_polygon(B.box()).alias("polygon"),
                              F.col("difficult").alias("iscrowd"))


def images_to_coco(sizes: DataFrame) -> DataFrame:
    """Images-only dataset with ids from 0 in an order fixed by the names; a repeated name is an error."""
    if sizes.groupBy("file_name").count().where("count > 1").limit(1).count():
        raise ValueError("file names are not unique")
    order = Window.partitionBy(F.substring(F.sha2("file_name", 256), 1, 2)).orderBy("file_name")
    keyed = sizes.withColumn("_b", F.substring(F.sha2("file_name", 256), 1, 2)).withColumn("_r", F.row_number().over(order))
    bins = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.join(F.broadcast(bins.select("_b", before.alias("_o"))), "_b").withColumn("image_id", F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")


def add_background(categories: DataFrame) -> DataFrame:
    """Category 0 "background" in front."""
    spark = categories.sparkSession
    zero = spark.range(1).select(F.lit(0).cast("long").alias("category_id"), F.lit("background").alias("name"))
    return categories.select("category_id", "name").unionByName(zero)
