"""Streaming queries, anchors, user code hooks and the offline evaluation entry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from detframe.operators import anchors as A
from detframe.operators import trackers as TR
from detframe.operators.evaluate import evaluate
from detframe.plans import compose as CP
from detframe.queries import tables as T
from detframe.queries.detection import NPOS, ap_sql, match_sql
from detframe.queries.greedy import COCO_TABLES, proposal_recall_sql
from detframe.queries.tables import with_tables
from detframe.session import shared_dir
from detframe.streaming import monitor as M
from detframe.streaming.tracking import track_stream


def live_curves(spark, sf):
    """Hourly means per event type, from the event table read as a stream."""
    schema = T.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = M.drain_windows(M.metric_curves(stream, "event_type", "value"), spark, ["start", "metric"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "metric", "n", F.round("mean", 6).alias("mean"), "low", "high")


LIVE_CURVES_SQL = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high
 FROM events GROUP BY 1, 2"""


def live_issues(spark, sf):
    """Events as boxes: faulty when their value leaves the frame."""
    schema = T.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("x"), F.lit(1).alias("y"), F.col("value").alias("w"), F.lit(10).alias("h"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    out = M.drain_windows(M.issue_rates(stream), spark, ["start"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "boxes", "faulty", F.round("rate", 9).alias("rate"))


LIVE_ISSUES_SQL = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS boxes, count(*) FILTER (value <= 0 OR user_id % 50 + value > 100) AS faulty,
 round(count(*) FILTER (value <= 0 OR user_id % 50 + value > 100) / CAST(count(*) AS DOUBLE), 9) AS rate
 FROM events GROUP BY 1"""


def live_tracks(spark, sf):
    """The derived detections land as files and are tracked as a stream."""
    landed = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    rows = T.pred_tracks(spark, sf).select("video_id", "frame_id", "det_id", "x1", "y1", "x2", "y2", "score", "category_id",
                                          F.timestamp_seconds(F.col("frame_id") * 10 + 1000).alias("ts"))
    rows.write.parquet(landed)
    stream = spark.readStream.schema(rows.schema).parquet(landed)
    return M.drain(track_stream(stream, TR.SortTracker), spark)


def anchor_clusters(spark, sf):
    shapes, quality = A.kmeans_anchors(T.gt(spark, sf), 6, seed=1)
    return spark.createDataFrame([(i, float(w), float(h), float(quality)) for i, (w, h) in enumerate(shapes)], "anchor int, w double, h double, mean_iou double")


def anchor_evolution(spark, sf):
    shapes, quality = A.evolve_anchors(T.gt(spark, sf), 4, seed=1)
    return spark.createDataFrame([(i, float(w), float(h), float(quality)) for i, (w, h) in enumerate(shapes)], "anchor int, w double, h double, mean_iou double")


def composed_steps(spark, sf):
    """A configured chain: size filter, then resizing."""
    boxes = T.gt(spark, sf).withColumn("width", F.lit(300).cast("long")).withColumn("height", F.lit(250).cast("long"))
    out = CP.compose(boxes, [{"type": "min_size", "width": 40, "height": 30}, {"type": "resize", "width": 600, "height": 500}])
    return out.select("ann_id", "x1", "y1", "x2", "y2", "width", "height")


COMPOSED_SQL = with_tables("gt") + """ SELECT ann_id, x1 * 2 AS x1, y1 * 2 AS y1, x2 * 2 AS x2, y2 * 2 AS y2, CAST(600 AS BIGINT) AS width, CAST(500 AS BIGINT) AS height
 FROM gt WHERE x2 - x1 > 40 AND y2 - y1 > 30"""


def user_records(spark, sf):
    """A per-record function that drops crowds and adds an area."""
    def fn(r):
        return None if r["iscrowd"] else {"ann_id": r["ann_id"], "area": (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])}
    return CP.map_records(T.gt(spark, sf), fn, "ann_id long, area double")


def user_metric(spark, sf):
    """Mean width per class as partial sums and a final division."""
    return CP.partial_metric(T.gt(spark, sf).select("category_id", "x1", "x2"), ["category_id"],
                             lambda p: {"s": float((p["x2"] - p["x1"]).sum()), "n": len(p)}, "category_id long, s double, n long",
                             lambda d: d.groupBy("category_id").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_width")))


def run_table(spark, sf):
    """A table function turns counts into runs: each box as one run of zeros and one of ones."""
    name = CP.run_table_function(spark)
    counts = T.gt(spark, sf).select("ann_id", F.array(F.col("x1").cast("long"), (F.col("x2") - F.col("x1")).cast("long")).alias("counts"))
    return spark.sql(f"SELECT ann_id, r.start, r.length FROM {{t}}, LATERAL {name}(counts) r", t=counts)


def offline_evaluation(spark, sf):
    """Even and odd images as two datasets, all metrics in one table."""
    det, gt = T.det(spark, sf), T.gt(spark, sf)
    parts = {n: (det.where(F.col("image_id") % 2 == p), gt.where(F.col("image_id") % 2 == p)) for p, n in enumerate(("even", "odd"))}
    return evaluate(parts, ("voc", "coco", "recall")).withColumn("value", F.round("value", 6))


def _offline_sql() -> str:
    """Classes of the two datasets are kept apart as even and odd classes; every figure groups by that."""
    def parted(sql: str) -> str:
        for name in ("gt", "det"):
            whole = T.SQL[name].replace(f"{name} AS", f"{name}_all AS", 1)
            sql = sql.replace(T.SQL[name], f"{whole},\n {name} AS (SELECT * REPLACE (category_id * 2 + image_id % 2 AS category_id) FROM {name}_all)", 1)
        return sql
    voc = parted(with_tables("gt", "det") + match_sql(0.5, plus=True) + NPOS + ap_sql()) + """
 SELECT category_id % 2 AS dataset, 'voc_map_50' AS metric, avg(ap) AS value FROM aps GROUP BY 1"""
    coco = parted(COCO_TABLES) + """
 SELECT dataset, 'coco_' || name AS metric, value FROM (
   SELECT category_id % 2 AS dataset, unnest(['AP', 'AP50', 'AP75', 'AP_small', 'AP_medium', 'AP_large']) AS name,
     unnest([avg(CASE WHEN area = 'all' THEN ap END), avg(CASE WHEN area = 'all' AND iou_thr = 0.5 THEN ap END),
       avg(CASE WHEN area = 'all' AND iou_thr = 0.75 THEN ap END), avg(CASE WHEN area = 'small' THEN ap END),
       avg(CASE WHEN area = 'medium' THEN ap END), avg(CASE WHEN area = 'large' THEN ap END)]) AS value FROM aps GROUP BY 1
   UNION ALL SELECT category_id % 2, unnest(['AR_1', 'AR_10', 'AR_100', 'AR_small', 'AR_medium', 'AR_large']),
     unnest([avg(CASE WHEN area = 'all' AND max_det = 1 THEN ar END), avg(CASE WHEN area = 'all' AND max_det = 10 THEN ar END),
       avg(CASE WHEN area = 'all' AND max_det = 100 THEN ar END), avg(CASE WHEN area = 'small' AND max_det = 100 THEN ar END),
       avg(CASE WHEN area = 'medium' AND max_det = 100 THEN ar END), avg(CASE WHEN area = 'large' AND max_det = 100 THEN ar END)]) FROM ars GROUP BY 1) s"""
    recall = f"""SELECT dataset, printf('recall_%d@%.2f', proposals, iou_thr) AS metric, recall AS value
 FROM ({proposal_recall_sql('100, 300', '0.5, 0.75', 'image_id % 2')}) r"""
    return f"""SELECT CASE WHEN dataset = 0 THEN 'even' ELSE 'odd' END AS dataset, metric, round(value, 6) AS value
 FROM (SELECT * FROM ({voc}) a UNION ALL SELECT * FROM ({coco}) b UNION ALL SELECT * FROM ({recall}) c) u"""


QUERIES = {f.__name__: f for f in (live_curves, live_issues, live_tracks, anchor_clusters, anchor_evolution, composed_steps, user_records, user_metric,
                                   run_table, offline_evaluation)}
ORACLES = {
    "live_curves": LIVE_CURVES_SQL,
    "live_issues": LIVE_ISSUES_SQL,
    "composed_steps": COMPOSED_SQL,
    "offline_evaluation": _offline_sql(),
    "user_records": with_tables("gt") + " SELECT ann_id, (x2 - x1) * (y2 - y1) AS area FROM gt WHERE iscrowd = 0",
    "user_metric": with_tables("gt") + " SELECT category_id, round(avg(x2 - x1), 6) AS mean_width FROM gt GROUP BY category_id",
    "run_table": with_tables("gt") + " SELECT ann_id, CAST(x1 AS BIGINT) AS start, CAST(x2 - x1 AS BIGINT) AS length FROM gt",
}
