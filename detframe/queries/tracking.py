"""Tracking queries on the derived tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.operators import coco_metrics as C
from detframe.operators import trackers as TR
from detframe.operators import tracks as K
from detframe.operators.logs import parameter_grid
from detframe.queries import tables as T
from detframe.queries.detection import ap_sql
from detframe.queries.greedy import COCO_TABLES, _recursive
from detframe.queries.tables import area_sql, inter_sql, iou_sql, with_tables

COORDS = ("x1", "y1", "x2", "y2")
GT, BOTH = with_tables("tr", "gt_tracks"), with_tables("tr", "gt_tracks", "pred_tracks")


def interpolated_tracks(spark, sf):
    out = K.interpolate_gaps(T.pred_tracks(spark, sf), 4, 4)
    return out.select("video_id", "frame_id", "track_id", *[F.round(c, 6).alias(c) for c in COORDS], F.round("score", 9).alias("score"))


INTERPOLATED_SQL = BOTH + f""",
 s AS (SELECT *, count(*) OVER (PARTITION BY video_id, track_id) AS n, lead(frame_id) OVER w AS f2, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1, lead(x2) OVER w AS a2, lead(y2) OVER w AS b2
   FROM pred_tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)),
 h AS (SELECT *, unnest(range(frame_id + 1, f2)) AS j FROM s WHERE n > 4 AND f2 - frame_id > 1 AND f2 - frame_id < 4),
 o AS (SELECT video_id, frame_id, track_id, x1, y1, x2, y2, score FROM s WHERE n > 2
   UNION ALL SELECT video_id, j, track_id, x1 + (j - frame_id) / CAST(f2 - frame_id AS DOUBLE) * (a1 - x1), y1 + (j - frame_id) / CAST(f2 - frame_id AS DOUBLE) * (b1 - y1),
     x2 + (j - frame_id) / CAST(f2 - frame_id AS DOUBLE) * (a2 - x2), y2 + (j - frame_id) / CAST(f2 - frame_id AS DOUBLE) * (b2 - y2), 1 FROM h)
 SELECT video_id, frame_id, track_id, {', '.join(f'round({c}, 6) AS {c}' for c in COORDS)}, round(score, 9) AS score FROM o"""


def track_gaps(spark, sf):
    return K.frame_gaps(T.gt_tracks(spark, sf))


GAPS_SQL = GT + """ SELECT * FROM (SELECT video_id, track_id, frame_id, lead(frame_id) OVER (PARTITION BY video_id, track_id ORDER BY frame_id) - frame_id AS gap
 FROM gt_tracks) t WHERE gap > 1"""


def track_velocity(spark, sf):
    out = K.velocity(T.gt_tracks(spark, sf), 2)
    return out.select("video_id", "frame_id", "track_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


VELOCITY_SQL = GT + """,
 d AS (SELECT video_id, frame_id, track_id, (x1 + x2) / 2 - lag((x1 + x2) / 2, 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2, 2) OVER w AS dy
   FROM gt_tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id))
 SELECT video_id, frame_id, track_id, round(dx / (sqrt(dx*dx + dy*dy) + 1e-6), 6) AS vx, round(dy / (sqrt(dx*dx + dy*dy) + 1e-6), 6) AS vy FROM d"""


def smoothed_tracks(spark, sf):
    return K.smooth_tracks(T.pred_tracks(spark, sf))


def shared_frames(spark, sf):
    return K.shared_frames(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf))


SHARED_SQL = BOTH + f""" SELECT g.video_id, g.track_id AS gt_track, p.track_id AS pred_track, count(*) AS frames
 FROM gt_tracks g JOIN pred_tracks p ON g.video_id = p.video_id AND g.frame_id = p.frame_id WHERE {iou_sql('g', 'p')} >= 0.5 GROUP BY ALL"""


def track_alignment(spark, sf):
    out = K.alignment(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf))
    return out.select("video_id", "gt_track", "pred_track", F.round("align", 6).alias("align"))


ALIGNMENT_SQL = BOTH + f""",
 p AS (SELECT * FROM (SELECT g.video_id, g.frame_id, g.track_id AS gt_track, p.track_id AS pred_track, {iou_sql('g', 'p')} AS sim
   FROM gt_tracks g JOIN pred_tracks p ON g.video_id = p.video_id AND g.frame_id = p.frame_id) t WHERE sim > 0),
 s AS (SELECT video_id, gt_track, pred_track, sim / (sum(sim) OVER (PARTITION BY video_id, frame_id, gt_track) + sum(sim) OVER (PARTITION BY video_id, frame_id, pred_track) - sim) AS s FROM p),
 q AS (SELECT video_id, gt_track, pred_track, sum(s) AS s FROM s GROUP BY ALL),
 ng AS (SELECT video_id, track_id AS gt_track, count(*) AS ng FROM gt_tracks GROUP BY ALL), nn AS (SELECT video_id, track_id AS pred_track, count(*) AS np FROM pred_tracks GROUP BY ALL)
 SELECT video_id, gt_track, pred_track, round(s / (ng + np - s), 6) AS align FROM q JOIN ng USING (video_id, gt_track) JOIN nn USING (video_id, pred_track)"""


def tracking_errors(spark, sf):
    gt, pred = T.gt_tracks(spark, sf), T.pred_tracks(spark, sf)
    return K.tracking_errors(gt, pred, K.clear_matches(gt, pred))


def clear_summary(spark, sf):
    from detframe.session import cut_lineage

    gt, pred = T.gt_tracks(spark, sf), T.pred_tracks(spark, sf)
    return K.clear_summary(gt, pred, cut_lineage(K.clear_matches(gt, pred)))


def identity_summary(spark, sf):
    return K.identity_summary(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf))


def hota(spark, sf):
    return K.hota(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf))


def tube_overlaps(spark, sf):
    out = K.tube_overlaps(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf))
    return out.withColumn("iou", F.round("iou", 6))


TUBE_SQL = BOTH + f""",
 i AS (SELECT g.video_id, g.track_id AS gt_track, p.track_id AS pred_track, sum({inter_sql('g', 'p')}) AS i FROM gt_tracks g JOIN pred_tracks p
   ON g.video_id = p.video_id AND g.frame_id = p.frame_id GROUP BY ALL),
 a AS (SELECT video_id, track_id AS gt_track, sum({area_sql('gt_tracks')}) AS a FROM gt_tracks GROUP BY ALL),
 b AS (SELECT video_id, track_id AS pred_track, sum({area_sql('pred_tracks')}) AS b FROM pred_tracks GROUP BY ALL)
 SELECT video_id, gt_track, pred_track, round(i / (a + b - i), 6) AS iou FROM i JOIN a USING (video_id, gt_track) JOIN b USING (video_id, pred_track) WHERE i > 0"""


def video_average_precision(spark, sf):
    """AP50 over whole tubes: a video stands for an image, a track for a box."""
    from detframe.operators.average_precision import average_precision
    from detframe.operators.greedy import match_by_score

    gt, pred = T.gt_tracks(spark, sf), T.pred_tracks(spark, sf)
    results = K.track_results(pred).select("video_id", "track_id", "score", "category_id", F.shiftleft("video_id", 32).bitwiseOR(F.col("track_id")).alias("row_id"))
    truth = gt.select("video_id", "track_id", "category_id").distinct()
    tubes = (K.tube_overlaps(gt, pred).where("iou >= 0.5")
             .join(truth.select("video_id", F.col("track_id").alias("gt_track"), F.col("category_id").alias("g_cat")), ["video_id", "gt_track"])
             .join(results.withColumnRenamed("track_id", "pred_track"), ["video_id", "pred_track"]).where("g_cat = category_id"))
    pairs = tubes.select("video_id", "category_id", F.col("pred_track").alias("det_id"), "score", F.col("gt_track").alias("ann_id"), F.col("iou").alias("value"))
    got = match_by_score(pairs, ["video_id", "category_id"]).select("video_id", "category_id", F.col("det_id").alias("track_id"), F.lit(1).alias("tp"))
    flags = results.join(got, ["video_id", "category_id", "track_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", 1 - F.col("tp"))
    npos = truth.groupBy("category_id").agg(F.count(F.lit(1)).alias("num_gts"))
    return average_precision(flags, npos, ["category_id"]).withColumn("ap", F.round("ap", 6))


_RANGES = {"all": (0.0, 1e10), "small": (0.0, 1650.0), "medium": (1650.0, 1900.0), "large": (1900.0, 1e10)}


def video_precision(spark, sf):
    """AP of tubes at ten thresholds in four ranges of mean area."""
    matches, npos = K.video_matches(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf), _RANGES)
    return C.precision_table(matches, npos, areas=_RANGES).select("category_id", "area", "iou_thr", F.round("ap", 6).alias("ap"))


def video_recall(spark, sf):
    matches, npos = K.video_matches(T.gt_tracks(spark, sf), T.pred_tracks(spark, sf), _RANGES)
    out = C.recall_table(matches, npos, areas=_RANGES)
    return out.select("category_id", "area", F.col("max_det").cast("long").alias("max_det"), F.round("ar", 6).alias("ar"))


def _video_tables() -> str:
    """The detection protocol's SQL with tubes for boxes."""
    tables = COCO_TABLES
    head, rest = tables.index(" cells AS"), tables.index(" pr AS (")
    after = tables.index(" cs AS (")
    tubes = _recursive(BOTH) + f""",
 v AS (SELECT video_id, track_id, category_id, count(*) AS n, sum(score) AS s FROM pred_tracks GROUP BY ALL),
 re AS (SELECT video_id, track_id, sum(s) / sum(n) AS score, first(category_id ORDER BY n DESC, category_id) AS category_id FROM v GROUP BY ALL),
 det AS (SELECT re.video_id AS image_id, re.track_id, re.video_id * 4294967296 + re.track_id AS det_id, re.category_id, round(re.score, 9) AS score, a AS area FROM re
   JOIN (SELECT video_id, track_id, avg({area_sql('pred_tracks')}) AS a FROM pred_tracks GROUP BY ALL) x USING (video_id, track_id)),
 gt AS (SELECT video_id AS image_id, track_id, video_id * 4294967296 + track_id AS ann_id, category_id, 0 AS iscrowd, avg({area_sql('gt_tracks')}) AS area FROM gt_tracks GROUP BY ALL),
 ti AS (SELECT g.video_id, g.track_id AS gt_track, p.track_id AS pred_track, sum({inter_sql('g', 'p')}) AS i FROM gt_tracks g JOIN pred_tracks p
   ON g.video_id = p.video_id AND g.frame_id = p.frame_id GROUP BY ALL),
 ta AS (SELECT video_id, track_id, sum({area_sql('gt_tracks')}) AS a FROM gt_tracks GROUP BY ALL), tb AS (SELECT video_id, track_id, sum({area_sql('pred_tracks')}) AS b FROM pred_tracks GROUP BY ALL),
 tu AS (SELECT ti.video_id, gt_track, pred_track, i / (a + b - i) AS v FROM ti JOIN ta ON ta.video_id = ti.video_id AND ta.track_id = gt_track
   JOIN tb ON tb.video_id = ti.video_id AND tb.track_id = pred_track WHERE i > 0),"""
    pairs = """ pr AS (SELECT d.det_id, g.ann_id, 0 AS c, g.area AS ga, tu.v FROM top d JOIN tu ON tu.video_id = d.image_id AND tu.pred_track = d.track_id
   JOIN gt g ON g.image_id = tu.video_id AND g.track_id = tu.gt_track AND g.category_id = d.category_id WHERE tu.v >= 0.5),
"""
    text = tubes + "\n" + tables[head:rest] + pairs + tables[after:]
    text = text.replace(area_sql("t"), "t.area").replace(area_sql("g"), "g.area")
    return text.replace("'hi': 1024.0", "'hi': 1650.0").replace("'lo': 1024.0", "'lo': 1650.0").replace("'hi': 9216.0", "'hi': 1900.0").replace("'lo': 9216.0", "'lo': 1900.0")


VIDEO_PRECISION_SQL = _video_tables() + " SELECT category_id, area, iou_thr, round(ap, 6) AS ap FROM aps"
VIDEO_RECALL_SQL = _video_tables() + " SELECT category_id, area, CAST(max_det AS BIGINT) AS max_det, round(ar, 6) AS ar FROM ars"


def track_results(spark, sf):
    out = K.track_results(T.pred_tracks(spark, sf))
    return out.withColumn("score", F.round("score", 6))


TRACK_RESULTS_SQL = BOTH + """,
 v AS (SELECT video_id, track_id, category_id, count(*) AS n, sum(score) AS s FROM pred_tracks GROUP BY ALL)
 SELECT video_id, track_id, round(sum(s) / sum(n), 6) AS score, CAST(sum(n) AS BIGINT) AS frames, first(category_id ORDER BY n DESC, category_id) AS category_id FROM v GROUP BY ALL"""


def link_candidates(spark, sf):
    """Tracks are broken at frame five into two parts."""
    cut = T.gt_tracks(spark, sf).withColumn("track_id", F.col("track_id") * 2 + (F.col("frame_id") >= 5).cast("long"))
    out = K.link_candidates(cut, 4, 25.0)
    return out.withColumn("dist", F.round("dist", 6))


LINK_SQL = GT + """,
 c AS (SELECT video_id, track_id * 2 + CASE WHEN frame_id >= 5 THEN 1 ELSE 0 END AS track_id, frame_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM gt_tracks),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id) AS r FROM c) t WHERE r = 1),
 z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id DESC) AS r FROM c) t WHERE r = 1)
 SELECT z.video_id, z.track_id, a.track_id AS next_id, a.frame_id - z.frame_id AS gap, round(sqrt(power(a.cx - z.cx, 2) + power(a.cy - z.cy, 2)), 6) AS dist
 FROM z JOIN a ON z.video_id = a.video_id AND z.track_id <> a.track_id WHERE a.frame_id - z.frame_id BETWEEN 1 AND 4 AND sqrt(power(a.cx - z.cx, 2) + power(a.cy - z.cy, 2)) <= 25"""


def linked_tracks(spark, sf):
    cut = T.gt_tracks(spark, sf).withColumn("track_id", F.col("track_id") * 2 + (F.col("frame_id") >= 5).cast("long"))
    cost = K.link_candidates(cut, 4, 25.0).withColumn("cost", F.col("dist"))
    return K.link_tracks(cut, cost, 25.0)


def least_cost_tracks(spark, sf):
    cut = T.gt_tracks(spark, sf).withColumn("track_id", F.col("track_id") * 2 + (F.col("frame_id") >= 5).cast("long"))
    cost = K.link_candidates(cut, 4, 25.0).withColumn("cost", F.col("dist") + 2 * F.col("gap"))
    return K.link_tracks(cut, cost, 25.0, least_cost=True)


LINKED_SQL = LINK_SQL.replace("WITH", "WITH RECURSIVE", 1).replace(" SELECT z.video_id, z.track_id", ", cd AS (SELECT z.video_id, z.track_id", 1).replace(
    "round(sqrt(power(a.cx - z.cx, 2) + power(a.cy - z.cy, 2)), 6) AS dist", "sqrt(power(a.cx - z.cx, 2) + power(a.cy - z.cy, 2)) AS dist") + """),
 k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY dist, next_id, track_id) AS r FROM cd),
 w AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS t, CAST([] AS BIGINT[]) AS n FROM k
   UNION ALL SELECT w.video_id, k.r, CASE WHEN list_contains(t, k.track_id) OR list_contains(n, k.next_id) THEN t ELSE list_append(t, k.track_id) END,
     CASE WHEN list_contains(t, k.track_id) OR list_contains(n, k.next_id) THEN n ELSE list_append(n, k.next_id) END FROM w JOIN k ON k.video_id = w.video_id AND k.r = w.r + 1),
 f AS (SELECT w.video_id, unnest(t) AS prev, unnest(n) AS track_id FROM w JOIN (SELECT video_id, max(r) AS r FROM k GROUP BY video_id) e ON e.video_id = w.video_id AND e.r = w.r),
 ch AS (SELECT DISTINCT video_id, track_id, track_id AS root_id FROM c
   UNION ALL SELECT ch.video_id, ch.track_id, f.prev FROM ch JOIN f ON f.video_id = ch.video_id AND f.track_id = ch.root_id)
 SELECT video_id, track_id, root_id FROM ch ANTI JOIN f ON f.video_id = ch.video_id AND f.track_id = ch.root_id"""


VIDEO_AP_SQL = TUBE_SQL.replace("WITH", "WITH RECURSIVE", 1).replace(" SELECT video_id, gt_track, pred_track, round(i / (a + b - i), 6) AS iou FROM i", ", tu AS (SELECT video_id, gt_track, pred_track, i / (a + b - i) AS iou FROM i") + """),
 v AS (SELECT video_id, track_id, category_id, count(*) AS n, sum(score) AS s FROM pred_tracks GROUP BY ALL),
 re AS (SELECT video_id, track_id, sum(s) / sum(n) AS score, first(category_id ORDER BY n DESC, category_id) AS category_id FROM v GROUP BY ALL),
 truth AS (SELECT DISTINCT video_id, track_id, category_id FROM gt_tracks),
 pr AS (SELECT tu.video_id, re.category_id, re.track_id, re.score, list(tu.gt_track ORDER BY tu.iou DESC, tu.gt_track) AS cands
   FROM tu JOIN re ON re.video_id = tu.video_id AND re.track_id = tu.pred_track
   JOIN truth ON truth.video_id = tu.video_id AND truth.track_id = tu.gt_track AND truth.category_id = re.category_id WHERE tu.iou >= 0.5 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY video_id, category_id ORDER BY score DESC, track_id) AS r FROM pr),
 w AS (SELECT DISTINCT video_id, category_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS track_id, false AS hit FROM k
   UNION ALL SELECT k.video_id, k.category_id, k.r, CASE WHEN len(list_filter(k.cands, lambda x: NOT list_contains(w.used, x))) > 0
       THEN list_append(w.used, list_filter(k.cands, lambda x: NOT list_contains(w.used, x))[1]) ELSE w.used END,
     k.track_id, len(list_filter(k.cands, lambda x: NOT list_contains(w.used, x))) > 0
   FROM w JOIN k ON k.video_id = w.video_id AND k.category_id = w.category_id AND k.r = w.r + 1),
 flags AS (SELECT re.category_id, re.score, re.video_id * 4294967296 + re.track_id AS det_id, CASE WHEN w.hit THEN 1 ELSE 0 END AS tp, CASE WHEN w.hit THEN 0 ELSE 1 END AS fp
   FROM re LEFT JOIN w ON w.video_id = re.video_id AND w.category_id = re.category_id AND w.track_id = re.track_id),
 npos AS (SELECT category_id, count(*) AS num_gts FROM truth GROUP BY category_id)""" + ap_sql() + """
 SELECT category_id, num_gts, num_dets, round(ap, 6) AS ap FROM aps"""


def _dets(spark, sf):
    return T.pred_tracks(spark, sf).select("video_id", "frame_id", "det_id", *COORDS, "score", "category_id")


def byte_tracks(spark, sf):
    return TR.run_tracker(_dets(spark, sf), TR.ByteTracker)


def sort_tracks(spark, sf):
    return TR.run_tracker(_dets(spark, sf), TR.SortTracker)


def observation_tracks(spark, sf):
    return TR.run_tracker(_dets(spark, sf), TR.ObservationTracker)


def _embedded(spark, sf):
    """Detections carry a stored vector that follows from their video and track number; all vectors are dealt out."""
    vectors = T.read(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    place = (F.col("video_id") * 37 + F.col("track_id")) % vectors.count()
    both = T.pred_tracks(spark, sf).withColumn("vec_id", place).join(vectors, "vec_id")
    return both.select("video_id", "frame_id", "det_id", *COORDS, "score", "category_id", "embedding")


def appearance_tracks(spark, sf):
    return TR.run_tracker(_embedded(spark, sf), lambda: TR.SortTracker(momentum=0.1, motion_weight=0.02, reid_thr=0.5))


def similarity_tracks(spark, sf):
    return TR.run_tracker(_embedded(spark, sf), TR.SimilarityTracker)


def tracker_sweep(spark, sf):
    grid = parameter_grid(spark, {"high": [0.4, 0.6], "init": [0.5, 0.7]}).withColumn("setting_id", (F.col("high") * 100 + F.col("init") * 10).cast("int"))
    out = TR.sweep(_dets(spark, sf), grid, lambda o: TR.ByteTracker(**o))
    return out.groupBy("setting_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("video_id", "track_id").alias("tracks"))


QUERIES = {f.__name__: f for f in (
    interpolated_tracks, track_gaps, track_velocity, smoothed_tracks, shared_frames, track_alignment, tracking_errors, clear_summary,
    identity_summary, hota, tube_overlaps, video_average_precision, video_precision, video_recall, track_results, link_candidates, linked_tracks, least_cost_tracks, byte_tracks, sort_tracks,
    observation_tracks, appearance_tracks, similarity_tracks, tracker_sweep)}
ORACLES = {
    "interpolated_tracks": INTERPOLATED_SQL,
    "track_gaps": GAPS_SQL,
    "track_velocity": VELOCITY_SQL,
    "shared_frames": SHARED_SQL,
    "track_alignment": ALIGNMENT_SQL,
    "tube_overlaps": TUBE_SQL,
    "track_results": TRACK_RESULTS_SQL,
    "link_candidates": LINK_SQL,
    "linked_tracks": LINKED_SQL,
    "video_average_precision": VIDEO_AP_SQL,
    "video_precision": VIDEO_PRECISION_SQL,
    "video_recall": VIDEO_RECALL_SQL,
}
