"""Suppression and fusion on the derived detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.functions import boxes as B
from detframe.operators import suppression as S
from detframe.queries import tables as T
from detframe.queries.tables import iou_sql, with_tables


def greedy_nms(spark, sf):
    return S.nms(T.det(spark, sf), 0.5).select("det_id", "image_id", "category_id", "score")


def nms_sql(source: str, thr: float, keys: str = "image_id, category_id") -> str:
    """Recursive CTE ``kept(det_id)``: walks each group in score order with the list of kept boxes."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"o.{k} = w.{k}" for k in names)
    return f""",
 ordered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_id) AS r FROM {source}),
 walk AS (
   SELECT {keys}, r, det_id, TRUE AS keep, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ordered WHERE r = 1
   UNION ALL
   SELECT {', '.join('o.' + k for k in names)}, o.r, o.det_id, o.keep,
     CASE WHEN o.keep THEN list_append(o.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE o.kept END
   FROM (SELECT o.*, w.kept, len(list_filter(w.kept, lambda k: {iou_sql('k', 'o')} > {thr})) = 0 AS keep
         FROM walk w JOIN ordered o ON {same} AND o.r = w.r + 1) o),
 kept AS (SELECT det_id FROM walk WHERE keep)"""


def _recursive(header: str) -> str:
    return header.replace("WITH ", "WITH RECURSIVE ", 1)


GREEDY_NMS_SQL = _recursive(with_tables("det")) + nms_sql("det", 0.5) + """
 SELECT det_id, image_id, category_id, score FROM det JOIN kept USING (det_id)"""


def multiclass_nms(spark, sf):
    out = S.multiclass_nms(T.det(spark, sf), 0.05, 0.6, 20, score_factor=F.lit(0.5) + F.col("category_id") / 10.0)
    return out.select("det_id", "image_id", "category_id", F.round("score", 9).alias("score"))


MULTICLASS_NMS_SQL = _recursive(with_tables("det")) + """,
 f AS (SELECT det_id, image_id, category_id, x1, y1, x2, y2, score * (CAST(0.5 AS DOUBLE) + category_id / CAST(10 AS DOUBLE)) AS score
       FROM det WHERE score > 0.05)""" + nms_sql("f", 0.6) + """
 SELECT det_id, image_id, category_id, round(score, 9) AS score FROM (
   SELECT f.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rr
   FROM f JOIN kept USING (det_id)) t WHERE rr <= 20"""


def fast_nms(spark, sf):
    return S.fast_nms(T.det(spark, sf), 0.1, 0.5, 8, 20).select("det_id", "image_id", "category_id", "score")


FAST_NMS_SQL = with_tables("det") + f""",
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS r
       FROM det WHERE score > 0.1) t WHERE r <= 8),
 k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b h WHERE h.image_id = b.image_id AND h.category_id = b.category_id
       AND h.r < b.r AND {iou_sql('h', 'b')} > 0.5))
 SELECT det_id, image_id, category_id, score FROM (
   SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rr FROM k) t WHERE rr <= 20"""


def _matrix(kernel):
    def run(spark, sf):
        out = S.matrix_nms(T.det(spark, sf), kernel, 2.0, 0.05, 20)
        return out.select("det_id", "image_id", F.round("decayed", 6).alias("decayed"))
    return run


def _matrix_sql(factor: str) -> str:
    return with_tables("det") + f""",
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS r FROM det),
 p AS (SELECT h.det_id AS hi, l.det_id AS lo, {iou_sql('h', 'l')} AS iou FROM o h JOIN o l
       ON h.image_id = l.image_id AND h.category_id = l.category_id AND h.r < l.r),
 c AS (SELECT lo AS hi, max(iou) AS comp FROM p GROUP BY lo),
 d AS (SELECT lo AS det_id, least(min({factor}), 1) AS decay FROM (
       SELECT p.*, coalesce(comp, 0) AS comp FROM p LEFT JOIN c USING (hi)) q WHERE iou > 0 GROUP BY lo),
 s AS (SELECT det_id, image_id, score * coalesce(decay, 1) AS decayed FROM det LEFT JOIN d USING (det_id))
 SELECT det_id, image_id, round(decayed, 6) AS decayed FROM (
   SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY decayed DESC, det_id) AS rr FROM s WHERE decayed >= 0.05) t
 WHERE rr <= 20"""


def drop_backdrops(spark, sf):
    return S.drop_backdrops(T.det(spark, sf), 0.5, 0.3, 0.7).select("det_id", "image_id", "score")


DROP_BACKDROPS_SQL = with_tables("det") + f""",
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM det)
 SELECT det_id, image_id, score FROM o WHERE NOT EXISTS (SELECT 1 FROM o h WHERE h.image_id = o.image_id AND h.r < o.r
   AND {iou_sql('h', 'o')} > CASE WHEN o.score < 0.5 THEN 0.3 ELSE 0.7 END)"""


def _tiles(spark, sf):
    """Each image is one of four tiles of a larger image of 600 x 500."""
    return T.images(spark, sf).select(
        F.col("image_id").alias("tile_id"), F.floor(F.col("image_id") / 4).cast("long").alias("image_id"),
        ((F.col("image_id") % 2) * 250).cast("double").alias("off_x"),
        ((F.floor(F.col("image_id") / 2) % 2) * 200).cast("double").alias("off_y"))


def merge_tiles(spark, sf):
    det = T.det(spark, sf).withColumnRenamed("image_id", "tile_id")
    return S.merge_tiles(det, _tiles(spark, sf), 0.5).select("det_id", "image_id", "x1", "y1", "x2", "y2")


MERGE_TILES_SQL = _recursive(with_tables("det")) + """,
 f AS (SELECT det_id, image_id // 4 AS image_id, category_id, score,
   x1 + (image_id % 2) * 250 AS x1, y1 + (image_id // 2 % 2) * 200 AS y1,
   x2 + (image_id % 2) * 250 AS x2, y2 + (image_id // 2 % 2) * 200 AS y2 FROM det)""" + nms_sql("f", 0.5) + """
 SELECT det_id, image_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2,
   CAST(y2 AS DOUBLE) AS y2 FROM f JOIN kept USING (det_id)"""


def _views(spark, sf):
    """Even detections come from a plain view, odd ones from a mirrored view at twice the scale."""
    det = T.det(spark, sf).withColumn("view_id", F.col("image_id") * 2 + F.col("det_id") % 2)
    views = (T.images(spark, sf).withColumn("odd", F.explode(F.array(F.lit(0), F.lit(1))))
             .select((F.col("image_id") * 2 + F.col("odd")).alias("view_id"), "width", "height",
                     F.when(F.col("odd") == 1, 2.0).otherwise(1.0).alias("scale"),
                     F.when(F.col("odd") == 1, "horizontal").alias("direction")))
    seen = det.join(views, "view_id").select(
        "det_id", "image_id", "category_id", "score", "view_id",
        *[F.when(F.col("direction").isNotNull(),
                 B.map_forward(B.box(), F.col("width"), F.col("height"), F.lit(2.0), "horizontal")[i])
          .otherwise(F.col(c)).alias(c) for i, c in enumerate(B.COORDS)])
    return seen, views


def merge_views(spark, sf):
    seen, views = _views(spark, sf)
    return S.merge_views(seen, views, 0.5, 30).select("det_id", "image_id", "x1", "y1", "x2", "y2", "score")


MERGE_VIEWS_SQL = _recursive(with_tables("det")) + nms_sql("det", 0.5) + """
 SELECT det_id, image_id, x1, y1, x2, y2, score FROM (
   SELECT det.*, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rr
   FROM det JOIN kept USING (det_id)) t WHERE rr <= 30"""


def average_views(spark, sf):
    """Mean of doubled detections of the same object (copies differ only in the last bit of the id)."""
    seen, views = _views(spark, sf)
    out = S.average_views(seen.withColumn("object_id", F.floor(F.col("det_id") / 2).cast("long")), views,
                          ["image_id", "object_id"])
    return out.withColumn("score", F.round("score", 9))


AVERAGE_VIEWS_SQL = with_tables("det") + """
 SELECT image_id, det_id // 2 AS object_id, avg(x1) AS x1, avg(y1) AS y1, avg(x2) AS x2, avg(y2) AS y2,
   round(avg(score), 9) AS score FROM det GROUP BY image_id, det_id // 2"""


def weighted_fusion(spark, sf):
    det = T.det(spark, sf).withColumn("model", (F.col("det_id") % 2).cast("int"))
    out = S.weighted_fusion(det, [2.0, 1.0], 0.55, 0.05)
    return out.select("image_id", "category_id", "members",
                      *[F.round(c, 5).alias(c) for c in (*B.COORDS, "score")])


WEIGHTED_FUSION_SQL = _recursive(with_tables("det")) + f""",
 f AS (SELECT *, score * CASE WHEN det_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS ws FROM det WHERE score >= 0.05),
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY ws DESC, det_id) AS r,
         count(*) OVER (PARTITION BY image_id, category_id) AS n FROM f),
 walk AS (
   SELECT image_id, category_id, n, 1::BIGINT AS r, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ws': ws, 'm': 1::BIGINT}}] AS cl
   FROM o WHERE r = 1
   UNION ALL
   SELECT image_id, category_id, n, r, CASE WHEN hit THEN
       list_concat(list_concat(cl[1:(pos - 1)], [{{'x1': (cl[pos].x1 * cl[pos].ws + x1 * ws) / (cl[pos].ws + ws),
         'y1': (cl[pos].y1 * cl[pos].ws + y1 * ws) / (cl[pos].ws + ws),
         'x2': (cl[pos].x2 * cl[pos].ws + x2 * ws) / (cl[pos].ws + ws),
         'y2': (cl[pos].y2 * cl[pos].ws + y2 * ws) / (cl[pos].ws + ws), 'ws': cl[pos].ws + ws, 'm': cl[pos].m + 1}}]), cl[(pos + 1):])
     ELSE list_append(cl, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ws': ws, 'm': 1::BIGINT}}) END
   FROM (SELECT *, list_position(ious, list_max(ious)) AS pos, list_max(ious) > 0.55 AS hit FROM (
     SELECT o.*, w.cl, list_transform(w.cl, lambda k: {iou_sql('k', 'o')}) AS ious
     FROM walk w JOIN o ON o.image_id = w.image_id AND o.category_id = w.category_id AND o.r = w.r + 1) a) b)
 SELECT image_id, category_id, c.m AS members, round(c.x1, 5) AS x1, round(c.y1, 5) AS y1, round(c.x2, 5) AS x2,
   round(c.y2, 5) AS y2, round(c.ws / c.m * least(c.m, 2) / 3, 5) AS score
 FROM (SELECT image_id, category_id, unnest(cl) AS c FROM walk WHERE r = n) t"""


def hierarchy_expansion(spark, sf):
    """Children 1..4 of class 0; ancestors are allowed on images with an even id."""
    kinds = T.categories(spark, sf)
    closure = kinds.select(F.col("category_id").alias("child"), F.explode(
        F.when(F.col("category_id") == 0, F.array("category_id"))
        .otherwise(F.array(F.lit(0).cast("long"), "category_id"))).alias("ancestor"))
    allowed = T.images(spark, sf).select("image_id", F.explode(
        F.when(F.col("image_id") % 2 == 0, F.sequence(F.lit(0), F.lit(4)))
        .otherwise(F.sequence(F.lit(1), F.lit(4)))).alias("category_id"))
    allowed = allowed.withColumn("category_id", F.col("category_id").cast("long"))
    out = S.expand_hierarchy(T.det(spark, sf), closure, allowed, "det_id")
    return out.select("det_id", "image_id", "category_id", "score")


HIERARCHY_SQL = with_tables("det") + """
 SELECT det_id, image_id, category_id, score FROM det WHERE category_id <> 0
 UNION ALL SELECT det_id, image_id, 0, score FROM det WHERE image_id % 2 = 0"""


QUERIES = {
    "greedy_nms": greedy_nms,
    "multiclass_nms": multiclass_nms,
    "fast_nms": fast_nms,
    "matrix_nms_gaussian": _matrix("gaussian"),
    "matrix_nms_linear": _matrix("linear"),
    "drop_backdrops": drop_backdrops,
    "merge_tiles": merge_tiles,
    "merge_views": merge_views,
    "average_views": average_views,
    "weighted_fusion": weighted_fusion,
    "hierarchy_expansion": hierarchy_expansion,
}
ORACLES = {
    "greedy_nms": GREEDY_NMS_SQL,
    "multiclass_nms": MULTICLASS_NMS_SQL,
    "fast_nms": FAST_NMS_SQL,
    "matrix_nms_gaussian": _matrix_sql("exp(-2.0*(iou*iou)) / exp(-2.0*(comp*comp))"),
    "matrix_nms_linear": _matrix_sql("(1 - iou) / greatest(1 - comp, 1e-12)"),
    "drop_backdrops": DROP_BACKDROPS_SQL,
    "merge_tiles": MERGE_TILES_SQL,
    "merge_views": MERGE_VIEWS_SQL,
    "average_views": AVERAGE_VIEWS_SQL,
    "weighted_fusion": WEIGHTED_FUSION_SQL,
    "hierarchy_expansion": HIERARCHY_SQL,
}
