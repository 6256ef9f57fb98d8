"""Readers of grounding data: captions with regions, referring expressions, described objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions.hashing import text_key
from detframe.sources.annotations import read_json_lists, xywh

_INSTANCE = "struct<bbox: array<double>, label: long, category: string>"
_REGION = "struct<bbox: string, phrase: string, tokens_positive: array<array<long>>>"
ODVG_SCHEMA = (
    f"filename string, height long, width long, detection struct<instances: array<{_INSTANCE}>>, grounding struct<caption: string, regions: array<{_REGION}>>")


def _inside(df: DataFrame) -> DataFrame:
    """Drop boxes outside the image or under one pixel."""
    iw = F.least("x2", F.col("width").cast("double")) - F.greatest("x1", F.lit(0.0))
    ih = F.least("y2", F.col("height").cast("double")) - F.greatest("y1", F.lit(0.0))
    return df.where((F.greatest(iw, F.lit(0.0)) * F.greatest(ih, F.lit(0.0)) != 0) & (B.width(B.box()) >= 1) & (B.height(B.box()) >= 1))


def read_odvg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(detection boxes, grounding boxes) of JSON lines.

    A grounding region holds one box or a list of boxes; both become rows. Its label is the region's position.
    """
    raw = spark.read.schema(ODVG_SCHEMA).json(path).withColumn("image_id", F.col("filename"))
    od = raw.where("detection IS NOT NULL").select("image_id", "width", "height", F.explode("detection.instances").alias("i")).select(
        "image_id", "width", "height", F.col("i.label").alias("label"), F.col("i.category").alias("category"), *B.named([F.col("i.bbox")[j] for j in range(4)]))
    vg = raw.where("grounding IS NOT NULL").select("image_id", "width", "height", F.col("grounding.caption").alias("caption"),
                                                   F.posexplode("grounding.regions").alias("label", "r"))
    many = F.coalesce(F.from_json("r.bbox", "array<array<double>>"), F.array(F.from_json("r.bbox", "array<double>")))
    nested = F.when(F.col("r.bbox").rlike(r"^\s*\[\s*\["), many).otherwise(F.array(F.from_json("r.bbox", "array<double>")))
    vg = vg.select("image_id", "width", "height", "caption", "label", F.col("r.phrase").alias("phrase"), F.col("r.tokens_positive").alias("tokens_positive"), F.explode(nested).alias("b"))
    vg = vg.select("image_id", "width", "height", "caption", "label", "phrase", "tokens_positive", *B.named([F.col("b")[j] for j in range(4)]))
    return _inside(od), _inside(vg)


def expression_text(sentences: Column, mode: str, seed: int, *keys: Column) -> Column:
    """One text from an array of sentences: select_first, concat or random; ``original`` leaves the array."""
    if mode == "select_first":
        return F.element_at(sentences, 1)
    if mode == "concat":
        return F.array_join(sentences, ".")
    if mode == "random":
        return F.element_at(sentences, (text_key(seed, *keys) % F.size(sentences) + 1).cast("int"))
    raise ValueError(f"unknown text mode {mode}")


def referring_samples(refs: DataFrame, annotations: DataFrame, images: DataFrame, split: str, mode: str = "random", seed: int = 0) -> DataFrame:
    """Expressions of a split with the box they mean: refs ⋈ annotations ⋈ images.

    ``refs(ref_id, ann_id, image_id, split, sentences)``. ``original`` gives one row per sentence.
    """
    rows = refs.where(F.col("split") == split).join(annotations.drop("image_id"), "ann_id").join(images, "image_id")
    if mode == "original":
        return rows.withColumn("text", F.explode("sentences")).drop("sentences")
    return rows.withColumn("text", expression_text(F.col("sentences"), mode, seed, F.col("ref_id"))).drop("sentences")


def read_mdetr(spark: SparkSession, path: str) -> DataFrame:
    """``(image_id, file_name, text, dataset_name)`` of images that carry a caption."""
    doc = read_json_lists(spark, path)
    return doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"),
                                                              F.lower(F.trim("i.caption")).alias("text"), F.col("i.dataset_name").alias("dataset_name"))


def phrase_spans(captions: DataFrame, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``(keys.., nth, phrase)``: the caption slice of the first span [start, end) of each phrase."""
    kept = [c for c in captions.columns if c not in (tokens, text)]
    rows = captions.select(*kept, text, F.posexplode(tokens).alias("nth", "_t"))
    a, b = F.col("_t")[0][0], F.col("_t")[0][1]
    return rows.select(*kept, "nth", F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).alias("phrase"))


def read_flickr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(phrases, boxes): phrase ids are renumbered densely per image."""
    doc = read_json_lists(spark, path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.caption").alias("text"), F.col("i.tokens_positive_eval").alias("tokens"))
    rows = doc.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("image_id"), F.explode("a.phrase_ids").alias("phrase_id"), *B.named(xywh(F.col("a.bbox"))))
    return phrase_spans(images), dense_phrases(rows)


def dense_phrases(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy("phrase_id")
    return rows.withColumn("phrase_label", F.dense_rank().over(order) - 1)


def described_objects(images: DataFrame, groups: DataFrame, sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with every sentence of their group and the boxes it describes; label = sentence id - 1.

    ``images(image_id, group_id)``, ``groups(group_id, sent_ids)``, ``sentences(sent_id, raw_sent)``.
    """
    asked = images.join(groups.select("group_id", F.explode("sent_ids").alias("sent_id")), "group_id").join(sentences, "sent_id")
    return asked.join(annotations, ["image_id", "sent_id"], "left").withColumn("label", F.col("sent_id") - 1)
