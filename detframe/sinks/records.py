"""Whole datasets and result files in the layouts of other formats: numbered records, masks, regions.

Ids follow the order of the source by running sums of counts, never by a sort of the whole table into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions import polygons as P
from detframe.plans.ordered import dense_ids, sums_before
from detframe.plans.sized import broadcast_if_small
from detframe.sinks.convert import coco_results, global_instances


def _corners_to_xywh(corners: Column) -> Column:
    return F.when(corners.isNotNull(), F.array(*B.xyxy_to_xywh(tuple(corners[i] for i in range(4)))))


def crowdhuman_to_coco(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images ``(id, file_name, height, width)`` and annotations of the one class 1, both numbered from 1 in file order.

    ``images(image_id, line, width, height)`` with distinct lines; ``boxes(image_id, pos, x1..y2, visible, extra_ignore)`` where
    ``pos`` counts an image's boxes from 0. A box is a crowd only if its own ignore mark is 1, whatever its tag; its area is
    that of the full box. Boxes of unknown images are left out.
    """
    sized = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    numbered = dense_ids(images.select("image_id", "line", "width", "height"), "line", "id").join(sized, "image_id", "left").na.fill(0, ["_n"])
    placed = sums_before(numbered, "id", "_n", "_before")
    ids = placed.select("image_id", F.col("id").alias("_image"), "_before")
    x, y, w, h = B.xyxy_to_xywh(B.box())
    annotations = boxes.join(ids, "image_id").select(
        (F.col("_before") + F.col("pos") + 1).alias("id"), F.col("_image").alias("image_id"), F.lit(1).cast("long").alias("category_id"),
        F.array(x, y, w, h).alias("bbox"), _corners_to_xywh(F.col("visible")).alias("vis_bbox"), (w * h).alias("area"),
        (F.coalesce("extra_ignore", F.lit(0)) == 1).cast("int").alias("iscrowd"))
    names = F.concat(F.lit("Images/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    return placed.select("id", names.alias("file_name"), "height", "width"), annotations


def youtube_vis_to_coco(videos: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frame images, frame annotations and ``(category_id, objects)`` from per-track arrays.

    ``videos(video_id, position, width, height, file_names)``; ``tracks(video_id, position, category_id, iscrowd, bboxes,
    areas, segmentations)`` with one array entry per frame. Images, annotations and instances are numbered from 1: frames in
    video order, annotations by frame and then position of the track, instances as they are first seen. Frames where the box
    is null have no row; entries beyond the video's frames are not read.
    """
    placed = sums_before(videos.withColumn("_n", F.size("file_names").cast("long")), "position", "_n", "_before")
    images = placed.select("video_id", "width", "height", "_before", F.posexplode("file_names").alias("frame_id", "file_name")).select(
        (F.col("_before") + F.col("frame_id") + 1).alias("id"), "video_id", "frame_id", "file_name", "height", "width")
    entries = F.arrays_zip(F.col("bboxes").alias("bbox"), F.col("areas").alias("area"), F.col("segmentations").alias("segmentation"))
    rows = (tracks.select("video_id", "position", "category_id", "iscrowd", F.posexplode(entries).alias("frame_id", "f"))
            .where("f.bbox IS NOT NULL").join(placed.select("video_id", F.col("position").alias("_video"), "_before", "_n"), "video_id")
            .where("frame_id < _n").withColumn("image_id", F.col("_before") + F.col("frame_id") + 1))
    per_image = sums_before(rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_k")), "image_id", "_k", "_earlier").drop("_k")
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("position"))  # the tracks of one frame
    seen = global_instances(rows.select(F.col("_video").alias("video_id"), "frame_id", F.col("position").alias("track_id")))
    seen = seen.select(F.col("video_id").alias("_video"), F.col("track_id").alias("position"), (F.col("instance_id") + 1).alias("instance_id"))
    annotations = rows.withColumn("_r", order).join(per_image, "image_id").join(seen, ["_video", "position"]).select(
        (F.col("_earlier") + F.col("_r")).alias("id"), "video_id", "image_id", "category_id", "instance_id", F.col("f.bbox").alias("bbox"),
        F.col("f.segmentation").alias("segmentation"), F.col("f.area").alias("area"), "iscrowd")
    return images, annotations, rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("objects"))


def coco_mask_results(det: DataFrame, runs: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """:func:`coco_results` with ``segmentation(size, counts)``: height and width, and the compressed run-length string.

    ``det`` has ``height`` and ``width`` of the image, ``runs(det_id, start, length)`` are disjoint pixels down the columns. A
    ``mask_score`` takes the place of the score. A detection without pixels has one count of zeros. Without ``runs``, ``det`` has a
    column ``runs`` with the runs of its row in order, and no row moves.
    """
    size = F.col("height").cast("long") * F.col("width").cast("long")
    if runs is None:
        whole = det.withColumn("counts", P.list_to_counts(P.merge_runs("runs"), size))
    else:
        counts = P.runs_to_counts(runs.join(det.select("det_id", size.alias("size")), "det_id"), ["det_id"])
        whole = det.join(counts, "det_id", "left").withColumn("counts", F.coalesce("counts", F.array(size)))
    rows = coco_results(whole, categories, extra=("det_id", "height", "width", "counts") + (("mask_score",) if "mask_score" in det.columns else ()))
    score = F.coalesce("mask_score", "score") if "mask_score" in det.columns else F.col("score")
    mask = F.struct(F.array(F.col("height").cast("long"), F.col("width").cast("long")).alias("size"), P.encode_rle("counts").alias("counts"))
    return rows.select("det_id", "image_id", "category_id", "bbox", score.alias("score"), mask.alias("segmentation"))


def write_coco_results(det: DataFrame, prefix: str, runs: DataFrame | None = None, categories: DataFrame | None = None) -> dict[str, str]:
    """Write ``<prefix>.bbox.json`` and, with masks, ``<prefix>.segm.json`` (folders of JSON lines); returns the path per kind."""
    paths = {"bbox": f"{prefix}.bbox.json", "proposal": f"{prefix}.bbox.json"}
    coco_results(det, categories).write.mode("overwrite").json(paths["bbox"])
    if runs is not None:
        paths["segm"] = f"{prefix}.segm.json"
        coco_mask_results(det, runs, categories).drop("det_id").write.mode("overwrite").json(paths["segm"])
    return paths


def openimages_records(rows: DataFrame, categories: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """``(image_id, filename, height, width, detection.instances)`` of boxes in pixels, in the order of ``row_id``.

    ``rows(row_id, image_id, label, x1..y2, width, height, is_group_of)``, ``categories(label, category)``. Group boxes go; boxes
    are clipped to the image and must keep an area there; images without such a box have no record.
    """
    clipped = rows.where(~F.col("is_group_of")).withColumns({c: v for c, v in zip(B.COORDS, B.clip(B.box(), F.col("width"), F.col("height")))})
    kept = clipped.where("x2 > x1 AND y2 > y1 AND width >= 1 AND height >= 1").join(broadcast_if_small(categories.select("label", "category")), "label")
    one = F.struct("row_id", F.array(*B.box()).alias("bbox"), "label", "category")
    nested = kept.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"), F.sort_array(F.collect_list(one)).alias("_i"))
    bare = F.transform("_i", lambda i: F.struct(i["bbox"].alias("bbox"), i["label"].alias("label"), i["category"].alias("category")))
    return nested.select("image_id", F.concat(F.col("image_id").cast("string"), F.lit(suffix)).alias("filename"), "height", "width", F.struct(bare.alias("instances")).alias("detection"))


# fixed values: characters that end or quote a phrase
PHRASE_MARKS = (".", "？", "'", '"')


def caption_regions(captions: DataFrame) -> DataFrame:
    """``captions`` columns with ``regions(phrase, tokens_positive, bboxes)`` in place of ``ref_exps``; captions without one drop out.

    ``captions(caption, width, height, ref_exps)``: each expression is ``[start, end, x1, y1, x2, y2, ..]``, the span in
    characters, the box in shares of the image. The phrase is judged, not the caption around it: no mark before its last
    character, ASCII only (so no emoji), not empty. Boxes are scaled, rounded to three places and must meet the image. A phrase
    met again adds its box to the first one's span. A null caption, size or list gives no region.
    """
    def region(e: Column) -> Column:
        phrase = F.substring(F.col("caption"), (e[0].cast("int") + 1), (e[1].cast("int") - e[0].cast("int")))
        box = F.array(*[F.round(e[i] * F.col("width" if i % 2 == 0 else "height"), 3) for i in range(2, 6)])
        return F.struct(phrase.alias("phrase"), F.array(e[0].cast("long"), e[1].cast("long")).alias("span"), box.alias("bbox"))

    def good(r: Column) -> Column:
        body = F.substring(r["phrase"], F.lit(1), F.greatest(F.length(r["phrase"]) - 1, F.lit(0)))
        marked = F.lit(False)
        for mark in PHRASE_MARKS:
            marked = marked | body.contains(mark)
        b = r["bbox"]
        meets = (F.least(b[2], F.col("width")) > F.greatest(b[0], F.lit(0))) & (F.least(b[3], F.col("height")) > F.greatest(b[1], F.lit(0)))
        return ~marked & (F.length(r["phrase"]) > 0) & ~r["phrase"].rlike(r"[^\x00-\x7F]") & meets & (F.col("width") > 1) & (F.col("height") > 1)

    found = F.filter(F.transform(F.filter("ref_exps", lambda e: F.size(e) >= 6), region), good)
    rows = captions.where("caption IS NOT NULL AND ref_exps IS NOT NULL").withColumn("_found", found).where(F.size("_found") > 0)

    def same(phrase: Column) -> Column:
        mine = F.filter("_found", lambda r: r["phrase"] == phrase)
        return F.struct(phrase.alias("phrase"), mine[0]["span"].alias("tokens_positive"), F.transform(mine, lambda r: r["bbox"]).alias("bboxes"))
    phrases = F.array_distinct(F.transform("_found", lambda r: r["phrase"]))
    return rows.withColumn("regions", F.transform(phrases, same)).drop("_found", "ref_exps")


def panoptic_test_info(info: DataFrame, categories: DataFrame) -> DataFrame:
    """The image-info document with its categories replaced by ``categories(id, name, isthing, ..)`` in id order.

    ``info`` is the document as read: one row, whose other fields are kept.
    """
    table = categories.agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in categories.columns if c != "id"]))).alias("categories"))  # a row of classes
    return info.drop("categories").join(F.broadcast(table))
