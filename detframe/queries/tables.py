"""Box tables derived from the given tables, once as DataFrames and once as SQL for the checks.

Only integer arithmetic decides the values, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

IMAGE_W, IMAGE_H = 300, 250


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    src = read(spark, sf, "lineitem").select(
        F.floor((F.col("l_orderkey") - F.col("l_orderkey") % 10) / 10).cast("long").alias("image_id"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"))
    order = Window.partitionBy("image_id").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "disc", "l_returnflag")
    gx, gy = (F.col("l_partkey") * 37) % 200, (F.col("l_partkey") * 53) % 150
    return src.withColumn("k", F.row_number().over(order).cast("long")).select(
        "image_id", (F.col("image_id") * 1000 + F.col("k")).alias("ann_id"), "k",
        "l_partkey", "l_suppkey", "qty", "disc", (F.col("l_suppkey") % 5).alias("category_id"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), 1).otherwise(0).alias("iscrowd"),
        gx.cast("double").alias("x1"), gy.cast("double").alias("y1"),
        (gx + 20 + F.col("qty")).cast("double").alias("x2"),
        (gy + 20 + F.col("l_linenumber") * 4).cast("double").alias("y2"))


def gt(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select("ann_id", "image_id", "category_id", "iscrowd", "x1", "y1", "x2", "y2")


def det(spark: SparkSession, sf: str) -> DataFrame:
    """Jittered copies of the boxes: some mislabelled, some missing, some doubled."""
    s = F.col("s")
    dx, dy = F.col("l_suppkey") % 7 - 3 + 9 * s, F.col("l_partkey") % 5 - 2
    both = _boxes(spark, sf).where("disc > 0").withColumn("s", F.explode(F.when(
        F.col("l_suppkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return both.select(
        (F.col("ann_id") * 2 + s).alias("det_id"), "image_id",
        F.when(F.col("disc") == 7, (F.col("category_id") + 1) % 5).otherwise(F.col("category_id")).alias("category_id"),
        (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"),
        (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
        (((F.col("ann_id") * 611953 + s * 104729) % 1000003) / F.lit(1000003.0)).alias("score"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    return (read(spark, sf, "lineitem")
            .select(F.floor((F.col("l_orderkey") - F.col("l_orderkey") % 10) / 10).cast("long").alias("image_id"))
            .distinct()
            .select("image_id", F.lit(IMAGE_W).cast("long").alias("width"), F.lit(IMAGE_H).cast("long").alias("height")))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """Regions stand in for categories: five rows, with name, group, frequency and split."""
    key = F.col("r_regionkey")
    return read(spark, sf, "region").select(
        key.cast("long").alias("category_id"), F.lower("r_name").alias("name"),
        F.when(key < 2, "group_a").when(key < 4, "group_b").otherwise("group_c").alias("supercategory"),
        F.when(key == 0, "r").when(key == 1, "c").otherwise("f").alias("frequency"),
        F.when(key >= 3, "novel").otherwise("base").alias("split"))


_NUMBERED = """
 l AS (SELECT CAST((l_orderkey - l_orderkey % 10) / 10 AS BIGINT) AS image_id,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
         CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc
       FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l_orderkey, l_linenumber,
         l_partkey, l_suppkey, qty, disc, l_returnflag) AS k FROM l),
 g AS (SELECT image_id, image_id * 1000 + k AS ann_id, k, l_partkey, l_suppkey, qty, disc,
         l_suppkey % 5 AS category_id,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END AS iscrowd,
         CAST((l_partkey * 37) % 200 AS DOUBLE) AS x1, CAST((l_partkey * 53) % 150 AS DOUBLE) AS y1,
         CAST((l_partkey * 37) % 200 + 20 + qty AS DOUBLE) AS x2,
         CAST((l_partkey * 53) % 150 + 20 + l_linenumber * 4 AS DOUBLE) AS y2
       FROM n)"""

SQL = {
    "g": _NUMBERED,
    "gt": "gt AS (SELECT ann_id, image_id, category_id, iscrowd, x1, y1, x2, y2 FROM g)",
    "det": """det AS (SELECT ann_id * 2 + s AS det_id, image_id,
         CASE WHEN disc = 7 THEN (category_id + 1) % 5 ELSE category_id END AS category_id,
         x1 + (l_suppkey % 7) - 3 + 9 * s AS x1, y1 + (l_partkey % 5) - 2 AS y1,
         x2 + (l_suppkey % 7) - 3 + 9 * s AS x2, y2 + (l_partkey % 5) - 2 AS y2,
         ((ann_id * 611953 + s * 104729) % 1000003) / CAST(1000003 AS DOUBLE) AS score
       FROM g CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 AS s) t
       WHERE disc > 0 AND (s = 0 OR l_suppkey % 3 = 0))""",
    "images": f"images AS (SELECT DISTINCT image_id, CAST({IMAGE_W} AS BIGINT) AS width, "
              f"CAST({IMAGE_H} AS BIGINT) AS height FROM g)",
    "categories": """categories AS (SELECT CAST(r_regionkey AS BIGINT) AS category_id, lower(r_name) AS name,
         CASE WHEN r_regionkey < 2 THEN 'group_a' WHEN r_regionkey < 4 THEN 'group_b' ELSE 'group_c' END AS supercategory,
         CASE r_regionkey WHEN 0 THEN 'r' WHEN 1 THEN 'c' ELSE 'f' END AS frequency,
         CASE WHEN r_regionkey >= 3 THEN 'novel' ELSE 'base' END AS split FROM region)""",
}



def inter_sql(a: str, b: str) -> str:
    return ("greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0)"
            "*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0)").format(a=a, b=b)


def area_sql(a: str) -> str:
    return "(({a}.x2-{a}.x1)*({a}.y2-{a}.y1))".format(a=a)


def iou_sql(a: str, b: str) -> str:
    inter = inter_sql(a, b)
    return f"({inter})/greatest({area_sql(a)}+{area_sql(b)}-({inter}),1e-6)"


def with_tables(*names: str) -> str:
    """``WITH`` header defining the named derived tables (and what they need)."""
    parts = [SQL["g"], *[SQL[n] for n in names]]
    return "WITH " + ",\n ".join(parts)


# ---- pixel runs: each row of an image owns fifty pixels; three rows make a segment ---------------------

def gt_runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return _boxes(spark, sf).select(
        "image_id", F.floor((k - 1) / 3).cast("long").alias("segment_id"), ((k - 1) * 50).alias("start"),
        (F.lit(40) + F.col("qty") % 11).alias("length"), F.col("category_id").alias("label"))


def pred_runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return _boxes(spark, sf).where("disc > 0").select(
        "image_id", F.when(F.col("l_suppkey") % 9 == 0, F.floor(k / 3)).otherwise(F.floor((k - 1) / 3)).cast("long").alias("segment_id"),
        ((k - 1) * 50 + F.col("l_partkey") % 5).alias("start"), (F.lit(30) + F.col("l_suppkey") % 15).cast("long").alias("length"),
        F.when(F.col("disc") == 7, (F.col("category_id") + 1) % 5).otherwise(F.col("category_id")).alias("label"))


def gt_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("segment_id")
    return gt_runs(spark, sf).select("image_id", "segment_id").distinct().select(
        "image_id", "segment_id", ((F.col("image_id") + s * 7) % 5).alias("category_id"),
        F.when((F.col("image_id") + s) % 11 == 0, 1).otherwise(0).alias("iscrowd"))


def pred_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("segment_id")
    return pred_runs(spark, sf).select("image_id", "segment_id").distinct().select(
        "image_id", "segment_id", ((F.col("image_id") + s * 7 + F.when((F.col("image_id") + s) % 6 == 0, 1).otherwise(0)) % 5).alias("category_id"))


SQL.update({
    "gt_runs": """gt_runs AS (SELECT image_id, (k - 1) // 3 AS segment_id, (k - 1) * 50 AS start, 40 + qty % 11 AS length,
         category_id AS label FROM g)""",
    "pred_runs": """pred_runs AS (SELECT image_id, CASE WHEN l_suppkey % 9 = 0 THEN k // 3 ELSE (k - 1) // 3 END AS segment_id,
         (k - 1) * 50 + l_partkey % 5 AS start, 30 + l_suppkey % 15 AS length,
         CASE WHEN disc = 7 THEN (category_id + 1) % 5 ELSE category_id END AS label FROM g WHERE disc > 0)""",
    "gt_segments": """gt_segments AS (SELECT DISTINCT image_id, segment_id, (image_id + segment_id * 7) % 5 AS category_id,
         CASE WHEN (image_id + segment_id) % 11 = 0 THEN 1 ELSE 0 END AS iscrowd FROM gt_runs)""",
    "pred_segments": """pred_segments AS (SELECT DISTINCT image_id, segment_id,
         (image_id + segment_id * 7 + CASE WHEN (image_id + segment_id) % 6 = 0 THEN 1 ELSE 0 END) % 5 AS category_id FROM pred_runs)""",
})


# ---- tracks: ten images make a video; positions follow straight lines -----------------------------------

def _track_rows(spark: SparkSession, sf: str) -> DataFrame:
    video, frame = F.floor(F.col("image_id") / 10).cast("long"), F.col("image_id") % 10
    gx, gy = (video * 31 + F.col("k") * 37) % 400, (video * 17 + F.col("k") * 53) % 300
    x, y = gx + frame * (F.col("k") % 5 - 2) * 3, gy + frame * (F.col("k") % 3 - 1) * 2
    return _boxes(spark, sf).select(
        video.alias("video_id"), frame.alias("frame_id"), F.col("k").alias("track_id"), (F.col("k") % 3).alias("category_id"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 30 + F.col("k") % 20).cast("double").alias("x2"),
        (y + 40 + F.col("k") % 10).cast("double").alias("y2"), "disc", "qty", "l_partkey", "l_suppkey", "ann_id")


def gt_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return _track_rows(spark, sf).where("qty % 9 <> 0").select("video_id", "frame_id", "track_id", "category_id", "x1", "y1", "x2", "y2")


def pred_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Shaken copies with some missing; in odd videos neighbouring ids swap after the fifth frame."""
    dx, dy = F.col("l_suppkey") % 5 - 2, F.col("l_partkey") % 5 - 2
    k = F.col("track_id")
    swapped = F.when((F.col("video_id") % 2 == 1) & (F.col("frame_id") > 5) & (F.floor(k / 2) % 3 == 0), k + F.when(k % 2 == 0, 1).otherwise(-1)).otherwise(k)
    return _track_rows(spark, sf).where("disc > 0").select(
        "video_id", "frame_id", (swapped + 500).alias("track_id"), "category_id", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"),
        (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
        (((F.col("ann_id") * 611953) % 1000003) / F.lit(1000003.0)).alias("score"), F.col("ann_id").alias("det_id"))


SQL.update({
    "tr": """tr AS (SELECT image_id // 10 AS video_id, image_id % 10 AS frame_id, k AS track_id, k % 3 AS category_id,
         CAST((image_id // 10 * 31 + k * 37) % 400 + image_id % 10 * (k % 5 - 2) * 3 AS DOUBLE) AS x1,
         CAST((image_id // 10 * 17 + k * 53) % 300 + image_id % 10 * (k % 3 - 1) * 2 AS DOUBLE) AS y1,
         k % 20 + 30 AS w, k % 10 + 40 AS h, disc, qty, l_partkey, l_suppkey, ann_id FROM g)""",
    "gt_tracks": "gt_tracks AS (SELECT video_id, frame_id, track_id, category_id, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM tr WHERE qty % 9 <> 0)",
    "pred_tracks": """pred_tracks AS (SELECT video_id, frame_id, 500 + CASE WHEN video_id % 2 = 1 AND frame_id > 5 AND track_id // 2 % 3 = 0
           THEN track_id + CASE WHEN track_id % 2 = 0 THEN 1 ELSE -1 END ELSE track_id END AS track_id, category_id,
         x1 + l_suppkey % 5 - 2 AS x1, y1 + l_partkey % 5 - 2 AS y1, x1 + w + l_suppkey % 5 - 2 AS x2, y1 + h + l_partkey % 5 - 2 AS y2,
         ((ann_id * 611953) % 1000003) / CAST(1000003 AS DOUBLE) AS score, ann_id AS det_id FROM tr WHERE disc > 0)""",
})
