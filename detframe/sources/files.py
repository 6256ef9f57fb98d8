"""File listings, image headers and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.sources.headers import ImageHeaders


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, file_name, length, modified)`` of all files below a folder; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return raw.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"), "length", F.col("modificationTime").alias("modified"))


def segmentation_pairs(listing: DataFrame, image_suffix: str, map_suffix: str, image_dir: str = "", map_dir: str = "") -> DataFrame:
    """Image paths with the path of their label map: the suffix, and the folder if given, are swapped."""
    out = listing.where(F.col("path").endswith(image_suffix))
    target = F.concat(F.expr(f"left(path, length(path) - {len(image_suffix)})"), F.lit(map_suffix))
    if image_dir:
        target = F.replace(target, F.lit(image_dir), F.lit(map_dir))
    return out.select(F.col("path").alias("img_path"), target.alias("seg_map_path"))


def image_sizes(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """``(file_name, width, height)`` read from image headers; ``names`` is a text or CSV file that lists the images."""
    spark.dataSource.register(ImageHeaders)
    reader = spark.read.format("image_headers")
    return (reader.option("names", names) if names else reader).load(path).select("file_name", "width", "height")


def read_train_logs(spark: SparkSession, path: str, metrics: Sequence[str] = ("loss", "lr", "time", "memory")) -> DataFrame:
    """JSON lines of training runs: ``run, line_no, epoch, iter, step`` and the metrics; keys with "/" hold validation values.

    Lines with a single key are skipped. Line numbers follow the file.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("run"), F.monotonically_increasing_id().alias("line_no"), "value")
    data = raw.withColumn("m", F.from_json("value", "map<string, string>")).where(F.size("m") > 1)
    val = F.map_filter("m", lambda k, _: k.contains("/"))
    return data.select("run", "line_no", *[F.col("m")[k].cast("long").alias(k) for k in ("epoch", "iter", "step")],
                       *[F.col("m")[k].cast("double").alias(k) for k in metrics], val.alias("val"), (F.size(val) > 0).alias("is_val"))


def read_result_logs(spark: SparkSession, path: str, pattern: str = r"bbox_mAP_copypaste:\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)") -> DataFrame:
    """Last metric line of each log below a tree: ``(dataset, ap, ap50, ap75, ap_s, ap_m, ap_l)``; the folder names the dataset."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    hit = raw.where(F.col("value").rlike(pattern))
    last = hit.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.col("n").desc()))).where("_r = 1")
    names = ("ap", "ap50", "ap75", "ap_s", "ap_m", "ap_l")
    return last.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("dataset"),
                       *[F.regexp_extract("value", pattern, i + 1).try_cast("double").alias(n) for i, n in enumerate(names)])


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Labelled polygons of one-file-per-image JSON: ``(image_id, nth, category, points)``; the file stem is the id."""
    schema = "info struct<name: string, width: long, height: long>, objects array<struct<category: string, segmentation: array<array<double>>, iscrowd: boolean>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("image_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    return raw.select("image_id", F.col("info.width").alias("width"), F.col("info.height").alias("height"), F.posexplode("objects").alias("nth", "o")).select(
        "image_id", "width", "height", "nth", F.col("o.category").alias("category"), F.col("o.segmentation").alias("points"))
