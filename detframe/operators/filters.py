"""Cleaning rules for images and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions import boxes as B
from detframe.plans.sized import broadcast_if_small


def valid_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Drop ignored ones, boxes outside the image, empty or sub-pixel boxes and unknown classes."""
    sized = annotations.join(images.select("image_id", "width", "height"), "image_id")
    area = F.col("area") if "area" in annotations.columns else B.area(B.box())
    kept = sized.where(B.valid_annotation(B.box(), area, F.col("width"), F.col("height")))
    if "ignore" in annotations.columns:
        kept = kept.where(~F.coalesce(F.col("ignore").cast("boolean"), F.lit(False)))
    known = broadcast_if_small(categories.select("category_id"))
    return kept.join(known, "category_id", "left_semi").select(*annotations.columns)


def filter_images(images: DataFrame, annotations: DataFrame, categories: DataFrame | None = None,
                  filter_empty: bool = True, min_size: int = 0, test_mode: bool = False) -> DataFrame:
    """Images large enough and, if asked, with a wanted class; judged on raw annotations. Test mode keeps all."""
    if test_mode:
        return images
    out = images.where(F.least("width", "height") >= min_size)
    if filter_empty:
        wanted = annotations
        if categories is not None:
            wanted = wanted.join(broadcast_if_small(categories.select("category_id")), "category_id", "left_semi")
        out = out.join(wanted.select("image_id"), "image_id", "left_semi")
    return out


def drop_all_crowd(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Drop images whose annotations are all crowds; an image without any counts as such."""
    real = annotations.where(F.col("iscrowd") == 0).select("image_id")
    return images.join(real, "image_id", "left_semi")


def filter_frames(frames: DataFrame, annotations: DataFrame, min_size: int = 32) -> DataFrame:
    """Video frames with an annotation and a least side; ``video_length`` counts what is left."""
    kept = filter_images(frames, annotations, min_size=min_size)
    length = kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("video_length"))
    return kept.drop("video_length").join(length, "video_id")


def filter_small(annotations: DataFrame, min_w: float, min_h: float, min_mask_area: float | None = None) -> DataFrame:
    """Strictly larger boxes, masks of at least the given area."""
    out = annotations.where((B.width(B.box()) > min_w) & (B.height(B.box()) > min_h))
    return out if min_mask_area is None else out.where(F.col("mask_area") >= min_mask_area)


def border_filter(instances: DataFrame, margin: float) -> DataFrame:
    """Drop instances within ``margin`` of an edge of their image."""
    x1, y1, x2, y2 = B.box()
    return instances.where((x1 > margin) & (y1 > margin) & (x2 < F.col("width") - margin) & (y2 < F.col("height") - margin))


def keep_instances(det: DataFrame, score_thr: float, label: int, min_pixels: float) -> DataFrame:
    return det.where((F.col("score") >= score_thr) & (F.col("category_id") == label) & (F.col("area") >= min_pixels))


def split_by_class(images: DataFrame, annotations: DataFrame, categories: DataFrame, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of one class split; images are those still referenced."""
    chosen = categories.where(F.col("split") == split)
    kept = annotations.join(broadcast_if_small(chosen.select("category_id")), "category_id", "left_semi")
    return images.join(kept.select("image_id"), "image_id", "left_semi"), kept, chosen


def drop_rare(nested: DataFrame, rare: Sequence[int]) -> DataFrame:
    """Remove instances of rare classes inside the nested array."""
    return nested.withColumn("instances", F.filter("instances", lambda x: ~x["category_id"].isin(list(rare))))


def by_source(images: DataFrame, annotations: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Images of one data source and their annotations."""
    chosen = images.where(F.col("source") == source)
    return chosen, annotations.join(chosen.select("image_id"), "image_id", "left_semi")


def remap_classes(annotations: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """New class ids through ``table(old_id, new_id)``; others become 0, or an error when ``strict``."""
    if strict and annotations.join(table, annotations.category_id == table.old_id, "left_anti").limit(1).count():
        raise ValueError("some classes are missing from the new class list")
    out = annotations.join(broadcast_if_small(table), annotations.category_id == table.old_id, "left")
    return out.withColumn("category_id", F.coalesce("new_id", F.lit(0).cast("long"))).drop("old_id", "new_id")


def select_annotations(annotations: DataFrame, image_ids: Sequence[int] | None = None, category_ids: Sequence[int] | None = None,
                       area_range: tuple[float, float] | None = None, crowd: bool | None = None) -> DataFrame:
    """Selectors by image, class, open area range and crowd flag; all optional."""
    rule: Column = F.lit(True)
    if image_ids is not None:
        rule = rule & F.col("image_id").isin(list(image_ids))
    if category_ids is not None:
        rule = rule & F.col("category_id").isin(list(category_ids))
    if area_range is not None:
        area = F.col("area") if "area" in annotations.columns else B.area(B.box())
        rule = rule & (area > area_range[0]) & (area < area_range[1])
    if crowd is not None:
        rule = rule & (F.col("iscrowd") == int(crowd))
    return annotations.where(rule)


def concat_datasets(named: dict[str, DataFrame]) -> DataFrame:
    """Union by column name with the origin kept in ``source``."""
    out = None
    for name, df in named.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def minus_ids(images: DataFrame, held_out: Sequence[DataFrame]) -> DataFrame:
    """Images whose id is in none of the held-out sets."""
    out = images
    for other in held_out:
        out = out.join(other.select("image_id"), "image_id", "left_anti")
    return out


def nest_instances(annotations: DataFrame) -> DataFrame:
    """One row per image with its instances, for sinks; per-image lists are assumed to fit a row."""
    fields = [c for c in annotations.columns if c != "image_id"]
    return annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("instances"))


def explode_instances(nested: DataFrame, flags: str = "ignore_flags", boxes: str = "boxes", labels: str = "labels") -> DataFrame:
    """Parallel arrays to rows; when flags and boxes differ in number every flag becomes false."""
    same = F.size(flags) == F.size(boxes)
    fixed = F.when(same, F.col(flags)).otherwise(F.transform(boxes, lambda _: F.lit(False)))
    kept = [c for c in nested.columns if c not in (flags, boxes, labels)]
    rows = nested.select(*kept, F.posexplode(F.arrays_zip(F.col(boxes).alias("box"), F.col(labels).alias("label"), fixed.alias("ignore"))).alias("pos", "i"))
    return rows.select(*kept, "pos", *[F.col("i.box")[j].alias(c) for j, c in enumerate(B.COORDS)],
                       F.col("i.label").alias("category_id"), F.coalesce("i.ignore", F.lit(False)).alias("ignore"))


def unify_categories(annotations: DataFrame, category_id: int = 1) -> DataFrame:
    return annotations.withColumn("category_id", F.lit(category_id).cast("long"))


def fix_names(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Rename by ``names(category_id, new_name)``; ``renamed`` marks the changes."""
    both = categories.join(names, "category_id", "left")
    return (both.withColumn("renamed", F.coalesce(F.col("new_name") != F.col("name"), F.lit(False)))
            .withColumn("name", F.coalesce("new_name", "name")).drop("new_name"))


def categories_per_key(annotations: DataFrame, key: str) -> DataFrame:
    """Sorted distinct classes per image or video."""
    return annotations.groupBy(key).agg(F.sort_array(F.collect_set("category_id")).alias("category_ids"), F.count(F.lit(1)).alias("boxes"))
