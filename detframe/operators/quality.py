"""Dataset checks as tables: one pass of conditional sums, and rows instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the report
TINY_SIDE = 4
MAX_ASPECT = 20


def check_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Issue counts and area statistics as one row.

    ``annotations(ann_id, image_id, category_id, x, y, w, h, area, segmentation)`` where ``segmentation`` is an
    array of flat polygons, or NULL. Annotations of unknown images are counted and then left out. An empty
    polygon list counts as missing, as in the report this follows.
    """
    img = images.select("image_id", "width", "height").dropDuplicates(["image_id"])
    both = annotations.join(img, "image_id", "left").join(
        categories.select("category_id", F.lit(True).alias("_known")), "category_id", "left")
    known = F.col("width").isNotNull()

    def total(rule):
        return F.sum((known & F.coalesce(rule, F.lit(False))).cast("long"))

    x, y, w, h, area = (F.col(c) for c in ("x", "y", "w", "h", "area"))
    seg = F.col("segmentation")
    has = seg.isNotNull() & (F.size(seg) > 0)

    def polys(rule):
        return F.sum(F.when(known & has, F.size(F.filter(seg, rule))).otherwise(0))

    kept_area = F.when(known, area)
    return both.agg(
        F.count(F.lit(1)).alias("annotations"),
        F.sum((~known).cast("long")).alias("unknown_img_id"), total(F.col("_known").isNull()).alias("unknown_cat_id"),
        total((w <= 0) | (h <= 0)).alias("non_positive_wh"), total((x < 0) | (y < 0)).alias("negative_coords"),
        total(x + w > F.col("width")).alias("bbox_out_w"), total(y + h > F.col("height")).alias("bbox_out_h"),
        total((w < TINY_SIDE) | (h < TINY_SIDE)).alias("tiny"),
        total((w > 0) & (h > 0) & (F.greatest(w / F.nullif(h, F.lit(0.0)), h / F.nullif(w, F.lit(0.0))) > MAX_ASPECT)).alias("extreme_aspect"),
        total(area <= 0).alias("area_le_0"), total(~has).alias("missing_seg"),
        polys(lambda p: F.size(p) % 2 != 0).alias("odd_poly"), polys(lambda p: F.size(p) < 6).alias("small_poly"),
        F.min(kept_area).alias("area_min"), F.percentile(kept_area, 0.5).alias("area_median"),
        F.percentile(kept_area, 0.95).alias("area_p95"), F.max(kept_area).alias("area_max"),
        F.percentile(kept_area / (F.col("width") * F.col("height")), 0.5).alias("relative_area_median"))


def duplicates(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """``(field, duplicates)``: rows minus distinct values of ids and file names."""
    out = None
    for df, field in ((images, "image_id"), (images, "file_name"), (annotations, "ann_id")):
        # count per value first, so that a hot value combines before the shuffle
        one = df.groupBy(field).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
        one = one.select(F.lit(field).alias("field"), "duplicates")
        out = one if out is None else out.unionByName(one)
    return out


def missing_files(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Images whose file is not in ``listing(file_name)``."""
    return images.join(listing.select("file_name"), "file_name", "left_anti")


def category_counts(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations per class on known images, with the share of all annotations (orphans included)."""
    known = annotations.join(images.select("image_id"), "image_id", "left_semi")
    total = annotations.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return (known.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
            .withColumn("share", F.col("n") / F.col("_all")).drop("_all"))


def distribution_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the sum of absolute share differences of two :func:`category_counts` tables."""
    left, right = a.select("category_id", F.col("share").alias("p")), b.select("category_id", F.col("share").alias("q"))
    both = left.join(right, "category_id", "full").na.fill(0.0, ["p", "q"])
    return both.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"))


def busiest_images(annotations: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` images with most annotations."""
    counts = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "image_id").limit(k)


def class_count_check(categories: DataFrame, configured: int) -> DataFrame:
    """One row: classes present, classes configured, whether they agree."""
    return categories.agg(F.countDistinct("category_id").alias("classes")).withColumn("configured", F.lit(configured)).withColumn(
        "matches", F.col("classes") == F.col("configured"))
