"""Instance mask metrics on the derived pixel runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.operators import instance_ap as I
from detframe.operators.outlines import outline_rings, ring_measures
from detframe.queries import tables as T
from detframe.queries.tables import with_tables


def _tables(spark, sf):
    """Segments of every thirteenth (image + segment) are void; the rest are instances."""
    void = (F.col("image_id") + F.col("segment_id")) % 13 == 5
    runs, segments = T.gt_runs(spark, sf), T.gt_segments(spark, sf)
    score = ((F.col("image_id") * 611953 + F.col("segment_id") * 104729) % 1009) / F.lit(1009.0)
    return (runs.where(~void).withColumnRenamed("segment_id", "g"), T.pred_runs(spark, sf).withColumnRenamed("segment_id", "p"),
            segments.where(~void).withColumnRenamed("segment_id", "g"), T.pred_segments(spark, sf).withColumn("score", score).withColumnRenamed("segment_id", "p"),
            runs.where(void))


def instance_average_precision(spark, sf):
    out = I.instance_ap(*_tables(spark, sf))
    return out.select("category_id", "num_gts", F.round("ap", 6).alias("ap"), F.round("ap50", 6).alias("ap50"))


def instance_ap_summary(spark, sf):
    out = I.instance_summary(I.instance_ap(*_tables(spark, sf)))
    return out.select(F.round("ap", 6).alias("ap"), F.round("ap50", 6).alias("ap50"), "classes")


def mask_outlines(spark, sf):
    """Rings of every truth segment: their number of sides' length and the area they enclose."""
    runs = T.gt_runs(spark, sf).select("image_id", "segment_id", "start", "length", F.lit(250).cast("long").alias("height"))
    out = ring_measures(outline_rings(runs, ["image_id", "segment_id"]), ["image_id", "segment_id"])
    return out.select("image_id", "segment_id", "area", "perimeter")


OUTLINE_SQL = with_tables("gt_runs") + """,
 px AS (SELECT image_id, segment_id, q // 250 AS x, q % 250 AS y FROM (SELECT image_id, segment_id, unnest(range(start, start + length)) AS q FROM gt_runs) t),
 nb AS (SELECT a.image_id, a.segment_id, a.x + d.dx AS x, a.y + d.dy AS y FROM px a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)),
 pe AS (SELECT image_id, segment_id, count(*) AS perimeter FROM nb ANTI JOIN px USING (image_id, segment_id, x, y) GROUP BY ALL)
 SELECT image_id, segment_id, (SELECT count(*) FROM px WHERE px.image_id = pe.image_id AND px.segment_id = pe.segment_id) AS area, perimeter FROM pe"""


INSTANCE = with_tables("gt_runs", "pred_runs", "gt_segments", "pred_segments") + """,
 th AS (SELECT k AS level, round(0.5 + 0.05 * k, 2) AS t FROM range(10) r(k)),
 vr AS (SELECT * FROM gt_runs WHERE (image_id + segment_id) % 13 = 5),
 gr AS (SELECT * FROM gt_runs WHERE (image_id + segment_id) % 13 <> 5),
 gs AS (SELECT s.image_id, s.segment_id AS g, s.category_id, s.iscrowd, a FROM gt_segments s
   JOIN (SELECT image_id, segment_id, sum(length) AS a FROM gr GROUP BY ALL) x USING (image_id, segment_id)),
 ps AS (SELECT s.image_id, s.segment_id AS p, s.category_id, a, ((s.image_id * 611953 + s.segment_id * 104729) % 1009) / CAST(1009 AS DOUBLE) AS score
   FROM pred_segments s JOIN (SELECT image_id, segment_id, sum(length) AS a FROM pred_runs GROUP BY ALL) x USING (image_id, segment_id)),
 o AS (SELECT g.image_id, g.segment_id AS g, p.segment_id AS p, sum(least(g.start+g.length, p.start+p.length) - greatest(g.start, p.start)) AS n
   FROM gr g JOIN pred_runs p ON g.image_id = p.image_id AND g.start < p.start+p.length AND p.start < g.start+g.length GROUP BY ALL),
 v AS (SELECT p.image_id, p.segment_id AS p, sum(least(g.start+g.length, p.start+p.length) - greatest(g.start, p.start)) AS n
   FROM vr g JOIN pred_runs p ON g.image_id = p.image_id AND g.start < p.start+p.length AND p.start < g.start+g.length GROUP BY ALL),
 pr AS (SELECT o.image_id, o.g, o.p, gs.category_id, ps.score, o.n, CAST(o.n AS DOUBLE) / (gs.a + ps.a - o.n) AS iou, iscrowd, gs.a < 100 AS small
   FROM o JOIN gs ON gs.image_id = o.image_id AND gs.g = o.g JOIN ps ON ps.image_id = o.image_id AND ps.p = o.p AND ps.category_id = gs.category_id),
 m AS (SELECT th.level, pr.*, row_number() OVER (PARTITION BY th.level, image_id, g ORDER BY score DESC, p) AS r FROM pr JOIN th ON iou > t WHERE iscrowd = 0 AND NOT small),
 ig AS (SELECT image_id, p, sum(CASE WHEN iscrowd = 1 THEN n ELSE 0 END + CASE WHEN small THEN n ELSE 0 END) AS n FROM pr GROUP BY ALL),
 f AS (SELECT th.level, ps.category_id, ps.score FROM ps CROSS JOIN th LEFT JOIN ig ON ig.image_id = ps.image_id AND ig.p = ps.p LEFT JOIN v ON v.image_id = ps.image_id AND v.p = ps.p
   WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image_id = ps.image_id AND pr.p = ps.p AND pr.iou > t)
     AND CAST(coalesce(ig.n, 0) + coalesce(v.n, 0) AS DOUBLE) / ps.a <= t),
 e AS (SELECT level, category_id, score, CASE WHEN r = 1 THEN 1 ELSE 0 END AS tp FROM m UNION ALL SELECT level, category_id, score, 0 FROM f),
 d AS (SELECT level, category_id, score, sum(tp) AS tp, count(*) AS n FROM e GROUP BY ALL),
 ng AS (SELECT category_id, count(*) AS num_gts FROM gs WHERE iscrowd = 0 AND a >= 100 GROUP BY category_id),
 c AS (SELECT d.*, num_gts, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM d JOIN ng USING (category_id) WINDOW w AS (PARTITION BY level, category_id ORDER BY score DESC)),
 q AS (SELECT level, category_id, score, CAST(ctp AS DOUBLE) / cn AS p, CAST(ctp AS DOUBLE) / num_gts AS r FROM c
   UNION ALL SELECT DISTINCT level, category_id, 9.0, 1.0, 0.0 FROM c),
 s AS (SELECT level, category_id, p, coalesce(lead(r) OVER w, r) - coalesce(lag(r) OVER w, 0) AS w2 FROM q WINDOW w AS (PARTITION BY level, category_id ORDER BY score DESC)),
 ap AS (SELECT level, category_id, sum(p * w2) / 2 AS ap FROM s GROUP BY ALL),
 pc AS (SELECT ng.category_id, num_gts, coalesce((SELECT sum(ap) FROM ap WHERE ap.category_id = ng.category_id), 0) / 10 AS ap,
   coalesce((SELECT ap FROM ap WHERE ap.category_id = ng.category_id AND level = 0), 0) AS ap50 FROM ng)"""
INSTANCE_AP_SQL = INSTANCE + " SELECT category_id, num_gts, round(ap, 6) AS ap, round(ap50, 6) AS ap50 FROM pc"
INSTANCE_SUMMARY_SQL = INSTANCE + " SELECT round(avg(ap), 6) AS ap, round(avg(ap50), 6) AS ap50, count(*) AS classes FROM pc"

QUERIES = {f.__name__: f for f in (instance_average_precision, instance_ap_summary, mask_outlines)}
ORACLES = {"instance_average_precision": INSTANCE_AP_SQL, "instance_ap_summary": INSTANCE_SUMMARY_SQL,
           "mask_outlines": OUTLINE_SQL}
