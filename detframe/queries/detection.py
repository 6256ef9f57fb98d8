"""Detection metrics on the derived box tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.operators import average_precision as AP
from detframe.operators import matching as M
from detframe.operators import table_metrics as TM
from detframe.operators.overlap import overlap_pairs
from detframe.queries import tables as T
from detframe.queries.tables import area_sql, inter_sql, iou_sql, with_tables


def _gt(spark: SparkSession, sf: str) -> DataFrame:
    return T.gt(spark, sf).withColumn("ignore", F.col("iscrowd") == 1)


def iou_join(spark, sf):
    pairs = overlap_pairs(T.det(spark, sf).select("det_id", "image_id", "category_id", "x1", "y1", "x2", "y2"),
                          T.gt(spark, sf).select("ann_id", "image_id", "category_id", "x1", "y1", "x2", "y2"),
                          ["image_id", "category_id"], "d_", "g_", min_overlap=0.5)
    return pairs.select("image_id", F.col("d_det_id").alias("det_id"), F.col("g_ann_id").alias("ann_id"), "iou")


IOU_JOIN_SQL = with_tables("gt", "det") + f"""
 SELECT * FROM (SELECT d.image_id, d.det_id, g.ann_id, {iou_sql('d', 'g')} AS iou
   FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) t WHERE iou >= 0.5"""


def overlap_measures(spark, sf):
    """IoF, GIoU and the "+1" IoU of touching same-class pairs, with both areas."""
    from detframe.functions import boxes as B

    cols = ["image_id", "category_id", "x1", "y1", "x2", "y2"]
    pairs = overlap_pairs(T.det(spark, sf).select("det_id", *cols), T.gt(spark, sf).select("ann_id", *cols),
                          ["image_id", "category_id"], "d_", "g_", min_overlap=0.7)
    d, g = B.box("d_"), B.box("g_")
    return pairs.select(F.col("d_det_id").alias("det_id"), F.col("g_ann_id").alias("ann_id"),
                        B.iou(d, g, "iof").alias("iof"), F.round(B.iou(d, g, "giou"), 9).alias("giou"),
                        B.iou(d, g, legacy=True).alias("iou_plus_one"), B.area(d).alias("det_area"),
                        F.round(B.center_distance(d, g), 9).alias("center_distance"))


_PLUS = ("greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1)+1,0.0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1)+1,0.0)")
OVERLAP_MEASURES_SQL = with_tables("gt", "det") + f"""
 SELECT det_id, ann_id, iof, round(iou - (hull - un) / hull, 9) AS giou, iou_plus_one, det_area, center_distance FROM (
   SELECT d.det_id, g.ann_id, {iou_sql('d', 'g')} AS iou, ({inter_sql('d', 'g')}) / {area_sql('d')} AS iof,
     {area_sql('d')} + {area_sql('g')} - ({inter_sql('d', 'g')}) AS un,
     (greatest(d.x2,g.x2)-least(d.x1,g.x1))*(greatest(d.y2,g.y2)-least(d.y1,g.y1)) AS hull,
     ({_PLUS}) / ((d.x2-d.x1+1)*(d.y2-d.y1+1) + (g.x2-g.x1+1)*(g.y2-g.y1+1) - {_PLUS}) AS iou_plus_one,
     {area_sql('d')} AS det_area,
     round(sqrt(power((d.x1+d.x2)/2-(g.x1+g.x2)/2, 2) + power((d.y1+d.y2)/2-(g.y1+g.y2)/2, 2)), 9) AS center_distance
   FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) t WHERE iou >= 0.7"""


def voc_match(spark, sf):
    out = M.match_default(T.det(spark, sf), _gt(spark, sf), 0.5)
    return out.select("det_id", F.when(F.col("iou") >= 0.5, F.col("ann_id")).alias("ann_id"),
                      F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


def match_sql(thr: float, plus: bool = False, low: float | None = None, high: float | None = None) -> str:
    """CTEs ``tied`` and ``flags(det_id, image_id, category_id, score, ann_id, iou, tp, fp)``."""
    p = "+1" if plus else ""
    inter = (f"greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1){p},0.0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1){p},0.0)")
    size = "({a}.x2-{a}.x1" + p + ")*({a}.y2-{a}.y1" + p + ")"
    da, ga = size.format(a="d"), size.format(a="g")
    bounded = low is not None
    out_g = f"OR NOT ({ga} >= {low} AND {ga} < {high})" if bounded else ""
    in_d = f"CASE WHEN {da} >= {low} AND {da} < {high} THEN 1 ELSE 0 END" if bounded else "1"
    return f""",
 pairs AS (SELECT d.det_id, g.ann_id, (g.iscrowd = 1 {out_g}) AS ign,
     ({inter}) / greatest({da} + {ga} - ({inter}), 1e-6) AS iou
   FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id),
 tied AS (SELECT d.det_id, d.image_id, d.category_id, d.score, p.ann_id, p.ign, coalesce(p.iou, 0) AS iou, {in_d} AS in_range
   FROM det d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, ign, ann_id) AS r
     FROM pairs WHERE iou > 0) p ON d.det_id = p.det_id AND p.r = 1),
 flags AS (SELECT *, CASE WHEN hit AND NOT ign AND r = 1 THEN 1 ELSE 0 END AS tp,
     CASE WHEN hit THEN CASE WHEN ign OR r = 1 THEN 0 ELSE 1 END ELSE in_range END AS fp
   FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN hit AND NOT ign THEN ann_id ELSE -det_id END
       ORDER BY score DESC, det_id) AS r
     FROM (SELECT *, coalesce(ann_id IS NOT NULL AND iou >= {thr}, FALSE) AS hit FROM tied) a) b)"""


VOC_MATCH_SQL = with_tables("gt", "det") + match_sql(0.5) + """
 SELECT det_id, CASE WHEN iou >= 0.5 THEN ann_id END AS ann_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM flags"""


def ap_sql(flags: str = "flags", npos: str = "npos", by: str = "category_id", ident: str = "det_id") -> str:
    """CTE ``aps(by, num_gts, num_dets, ap)`` from flags and box counts."""
    on = " AND ".join(f"n.{c.strip()} = a.{c.strip()}" for c in by.split(","))
    n_by = ", ".join(f"n.{c.strip()}" for c in by.split(","))
    return f""",
 cum AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM {flags}
   WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, {ident} ROWS UNBOUNDED PRECEDING)),
 env AS (SELECT *, max(CASE WHEN ctp + cfp > 0 THEN CAST(ctp AS DOUBLE) / CAST(ctp + cfp AS DOUBLE) ELSE 0 END)
     OVER (PARTITION BY {by} ORDER BY score DESC, {ident}
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM cum),
 sums AS (SELECT {by}, count(*) AS num_dets, sum(tp * envelope) AS s FROM env GROUP BY {by}),
 aps AS (SELECT {n_by}, CAST(n.num_gts AS BIGINT) AS num_gts, coalesce(num_dets, 0) AS num_dets,
     coalesce(s, 0) / CAST(n.num_gts AS DOUBLE) AS ap
   FROM {npos} n LEFT JOIN sums a ON {on} WHERE n.num_gts > 0)"""


NPOS = ", npos AS (SELECT category_id, sum(1 - iscrowd) AS num_gts FROM gt GROUP BY category_id)"


def voc_average_precision(spark, sf):
    out = AP.eval_map(T.det(spark, sf), _gt(spark, sf), 0.5)
    return out.withColumn("ap", F.round("ap", 6))


VOC_AP_SQL = with_tables("gt", "det") + match_sql(0.5) + NPOS + ap_sql() + """
 SELECT category_id, num_gts, num_dets, round(ap, 6) AS ap FROM aps"""


def voc_11_points(spark, sf):
    out = AP.eval_map(T.det(spark, sf), _gt(spark, sf), 0.5, mode="11points", legacy=True)
    return out.withColumn("ap", F.round("ap", 6))


VOC_11_SQL = with_tables("gt", "det") + match_sql(0.5, plus=True) + NPOS + """,
 cum AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM flags
   WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
 pr AS (SELECT c.category_id, CAST(ctp AS DOUBLE) / num_gts AS rec, CASE WHEN ctp + cfp > 0 THEN CAST(ctp AS DOUBLE) / (ctp + cfp) ELSE 0 END AS prec
   FROM cum c JOIN npos n ON n.category_id = c.category_id),
 pts AS (SELECT category_id, q, max(CASE WHEN rec >= q / CAST(10 AS DOUBLE) THEN prec END) AS p
   FROM pr, (SELECT unnest(range(11)) AS q) GROUP BY category_id, q)
 SELECT n.category_id, CAST(num_gts AS BIGINT) AS num_gts, (SELECT count(*) FROM det d WHERE d.category_id = n.category_id) AS num_dets,
   round(avg(coalesce(p, 0)), 6) AS ap FROM npos n JOIN pts ON pts.category_id = n.category_id GROUP BY n.category_id, num_gts"""


def voc_area_range(spark, sf):
    """AP over boxes of 900 to 2500 square pixels."""
    out = AP.eval_map(T.det(spark, sf), _gt(spark, sf), 0.5, area_range=(900.0, 2500.0))
    return out.withColumn("ap", F.round("ap", 6))


VOC_AREA_SQL = with_tables("gt", "det") + match_sql(0.5, low=900, high=2500) + """,
 npos AS (SELECT category_id, sum(CASE WHEN iscrowd = 0 AND (x2-x1)*(y2-y1) >= 900 AND (x2-x1)*(y2-y1) < 2500 THEN 1 ELSE 0 END) AS num_gts
   FROM gt GROUP BY category_id)""" + ap_sql() + " SELECT category_id, num_gts, num_dets, round(ap, 6) AS ap FROM aps"


def mean_average_precision(spark, sf):
    """Mean over classes at three thresholds, from one match."""
    out = AP.mean_ap(AP.eval_maps(T.det(spark, sf), _gt(spark, sf), (0.5, 0.6, 0.7)), ["iou_thr"])
    return out.select("iou_thr", "classes", F.round("map", 6).alias("map"))


MEAN_AP_SQL = with_tables("gt", "det") + ", " + ", ".join(
    f"""aps{i} AS ({'WITH ' + (match_sql(t) + NPOS + ap_sql()).lstrip().lstrip(',')} SELECT * FROM aps)"""
    for i, t in enumerate((0.5, 0.6, 0.7))) + " " + " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS iou_thr, count(*) AS classes, round(avg(ap), 6) AS map FROM aps{i}"
    for i, t in enumerate((0.5, 0.6, 0.7)))


def group_of_ap(spark, sf):
    """Crowd boxes act as group boxes."""
    gt = T.gt(spark, sf).withColumn("is_group_of", F.col("iscrowd") == 1).withColumn("ignore", F.lit(False))
    return AP.eval_group_of_map(T.det(spark, sf), gt).withColumn("ap", F.round("ap", 6))


def _group_of_sql(extra: str = "", det: str = "det", gt: str = "gt") -> str:
    return with_tables("gt", "det") + extra + f""",
 pairs AS (SELECT d.det_id, g.ann_id, {iou_sql('d', 'g')} AS iou FROM {det} d JOIN {gt} g
   ON d.image_id = g.image_id AND d.category_id = g.category_id AND g.iscrowd = 0),
 tied AS (SELECT d.*, p.ann_id, coalesce(p.iou, 0) AS iou FROM {det} d LEFT JOIN (SELECT *, row_number() OVER
     (PARTITION BY det_id ORDER BY iou DESC, ann_id) AS r FROM pairs WHERE iou > 0) p ON d.det_id = p.det_id AND p.r = 1),
 st AS (SELECT *, CASE WHEN iou >= 0.5 AND row_number() OVER (PARTITION BY CASE WHEN iou >= 0.5 THEN ann_id ELSE -det_id END
     ORDER BY score DESC, det_id) = 1 THEN 1 ELSE 0 END AS tp FROM tied),
 ins AS (SELECT * FROM (SELECT s.det_id, s.score, g.ann_id, row_number() OVER (PARTITION BY s.det_id ORDER BY
     ({inter_sql('s', 'g')}) / {area_sql('s')} DESC, g.ann_id) AS r, ({inter_sql('s', 'g')}) / {area_sql('s')} AS f
   FROM st s JOIN {gt} g ON s.image_id = g.image_id AND s.category_id = g.category_id AND g.iscrowd = 1 WHERE tp = 0) x
   WHERE r = 1 AND f >= 0.5),
 flags AS (SELECT det_id, category_id, score, tp, 1 - tp AS fp FROM st WHERE det_id NOT IN (SELECT det_id FROM ins)
   UNION ALL SELECT -g.ann_id, g.category_id, coalesce(b.s, 0), CASE WHEN b.s IS NULL THEN 0 ELSE 1 END, CASE WHEN b.s IS NULL THEN 1 ELSE 0 END
   FROM {gt} g LEFT JOIN (SELECT ann_id, max(score) AS s FROM ins GROUP BY ann_id) b USING (ann_id) WHERE g.iscrowd = 1),
 npos AS (SELECT category_id, count(*) AS num_gts FROM {gt} GROUP BY category_id)""" + ap_sql() + """
 SELECT category_id, num_gts, num_dets, round(ap, 6) AS ap FROM aps"""


GROUP_OF_SQL = _group_of_sql()


def open_images_ap(spark, sf):
    """Classes 1..4 are children of class 0: truth and predictions count for their ancestors too, predictions only where
    the image allows the class (class 0 on images with an even id); then AP with group boxes."""
    from detframe.operators.suppression import expand_hierarchy

    closure = T.categories(spark, sf).select(F.col("category_id").alias("child"), F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), "category_id"))).alias("ancestor"))
    allowed = T.images(spark, sf).select("image_id", F.explode(F.sequence(F.when(F.col("image_id") % 2 == 0, 0).otherwise(1).cast("long"), F.lit(4).cast("long"))).alias("category_id"))
    gt = T.gt(spark, sf).withColumn("is_group_of", F.col("iscrowd") == 1).withColumn("ignore", F.lit(False))
    det = expand_hierarchy(T.det(spark, sf), closure, allowed, "det_id")
    return AP.eval_group_of_map(det, expand_hierarchy(gt, closure, None, "ann_id")).withColumn("ap", F.round("ap", 6))


OPEN_IMAGES_SQL = _group_of_sql(""",
 gx AS (SELECT ann_id * 8 + category_id AS ann_id, image_id, category_id, iscrowd, x1, y1, x2, y2 FROM gt
   UNION ALL SELECT ann_id * 8, image_id, 0, iscrowd, x1, y1, x2, y2 FROM gt WHERE category_id <> 0),
 dx AS (SELECT det_id * 8 + category_id AS det_id, image_id, category_id, x1, y1, x2, y2, score FROM det WHERE category_id <> 0 OR image_id % 2 = 0
   UNION ALL SELECT det_id * 8, image_id, 0, x1, y1, x2, y2, score FROM det WHERE category_id <> 0 AND image_id % 2 = 0)""", "dx", "gx")


def reusable_match(spark, sf):
    out = M.match_reusable(T.det(spark, sf), _gt(spark, sf), 0.5)
    return out.select("det_id", F.col("tp").cast("long").alias("tp"))


REUSABLE_SQL = with_tables("gt", "det") + f"""
 SELECT det_id, CAST(max(CASE WHEN g.ann_id IS NOT NULL AND {iou_sql('d', 'g')} > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
 FROM det d LEFT JOIN gt g ON d.image_id = g.image_id AND g.iscrowd = 0 GROUP BY det_id"""


def anchor_coverage(spark, sf):
    out = M.match_max_iou(T.det(spark, sf), T.gt(spark, sf), 0.6, 0.4, 0.3)
    return out.select("det_id", "assigned", F.round("max_iou", 9).alias("max_iou"))


ANCHOR_COVERAGE_SQL = with_tables("gt", "det") + f""",
 p AS (SELECT * FROM (SELECT d.det_id, g.ann_id, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id) t WHERE iou > 0),
 own AS (SELECT det_id, ann_id AS own_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, ann_id) AS r FROM p) t WHERE r = 1),
 cl AS (SELECT det_id, max(ann_id) AS claimed FROM (SELECT *, max(iou) OVER (PARTITION BY ann_id) AS top FROM p) t
   WHERE iou = top AND top >= 0.3 GROUP BY det_id)
 SELECT d.det_id, coalesce(claimed, CASE WHEN coalesce(iou, 0) >= 0.6 THEN own_id WHEN coalesce(iou, 0) < 0.4 THEN 0 ELSE -1 END) AS assigned,
   round(coalesce(iou, 0), 9) AS max_iou FROM det d LEFT JOIN own USING (det_id) LEFT JOIN cl USING (det_id)"""


def nearest_center_match(spark, sf):
    def centred(df, ident, name):
        return df.select("image_id", F.col(ident).alias(name), ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
                         ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    out = M.match_nearest_center(centred(T.gt(spark, sf), "ann_id", "a_id"), centred(T.det(spark, sf), "det_id", "b_id"), 15.0)
    return out.select("image_id", "a_id", "b_id", F.round("dist", 6).alias("dist"))


NEAREST_CENTER_SQL = with_tables("gt", "det") + """,
 p AS (SELECT * FROM (SELECT g.image_id, g.ann_id AS a_id, d.det_id AS b_id,
     sqrt(power((g.x1+g.x2)/2-(d.x1+d.x2)/2, 2) + power((g.y1+g.y2)/2-(d.y1+d.y2)/2, 2)) AS dist
   FROM gt g JOIN det d ON g.image_id = d.image_id) t WHERE dist <= 15),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS r FROM p) t WHERE r = 1)
 SELECT image_id, a_id, b_id, round(dist, 6) AS dist FROM (
   SELECT image_id, a_id, b_id, dist, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS rr FROM a) t WHERE rr = 1"""


def per_image_map(spark, sf):
    out = AP.per_image_map(T.det(spark, sf), _gt(spark, sf), (0.5, 0.75))
    return out.withColumn("map", F.round("map", 6))


def _per_image_cte(tag: str, thr: float) -> str:
    body = (match_sql(thr) + ", npos AS (SELECT image_id, category_id, sum(1 - iscrowd) AS num_gts FROM gt GROUP BY ALL)"
            + ap_sql(by="image_id, category_id")).lstrip().lstrip(",")
    return f"{tag} AS (WITH {body} SELECT image_id, category_id, ap FROM aps)"


PER_IMAGE = with_tables("gt", "det") + ", " + _per_image_cte("t1", 0.5) + ", " + _per_image_cte("t2", 0.75) + """,
 maps AS (SELECT image_id, avg(ap) AS map FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) u GROUP BY image_id)"""
PER_IMAGE_SQL = PER_IMAGE + " SELECT image_id, round(map, 6) AS map FROM maps"


def best_and_worst_images(spark, sf):
    return TM.best_and_worst(per_image_map(spark, sf), 20)


BEST_WORST_SQL = PER_IMAGE + """, rounded AS (SELECT image_id, round(map, 6) AS map FROM maps)
 SELECT * FROM (SELECT image_id, map, 'best' AS side FROM rounded ORDER BY map DESC, image_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT image_id, map, 'worst' AS side FROM rounded ORDER BY map, image_id LIMIT 20)"""


def confusion_matrix(spark, sf):
    out = TM.confusion_matrix(T.det(spark, sf), T.gt(spark, sf), 0.3, 0.5)
    return out.withColumn("share", F.round("share", 6))


CONFUSION_SQL = with_tables("gt", "det") + f""",
 p AS (SELECT * FROM (SELECT d.det_id, g.ann_id, g.category_id AS gt_label, d.category_id AS det_label, {iou_sql('d', 'g')} AS iou
   FROM det d JOIN gt g ON d.image_id = g.image_id WHERE d.score >= 0.3) t WHERE iou >= 0.5),
 c AS (SELECT gt_label, det_label FROM p
   UNION ALL SELECT -1, category_id FROM det WHERE score >= 0.3 AND det_id NOT IN (SELECT det_id FROM p)
   UNION ALL SELECT category_id, -1 FROM gt WHERE ann_id NOT IN (SELECT ann_id FROM p WHERE gt_label = det_label)),
 cells AS (SELECT gt_label, det_label, count(*) AS n FROM c GROUP BY ALL)
 SELECT gt_label, det_label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY gt_label), 6) AS share FROM cells"""


def multi_dataset_ap(spark, sf):
    """AP per (dataset, class) and the mean per dataset, with images dealt to three datasets."""
    det = T.det(spark, sf).withColumn("dataset", F.col("image_id") % 3)
    gt = _gt(spark, sf).withColumn("dataset", F.col("image_id") % 3)
    per = AP.eval_map(det, gt, 0.5, by=("dataset", "category_id"))
    return AP.mean_ap(per, ["dataset"]).select("dataset", "classes", F.round("map", 6).alias("map"))


MULTI_DATASET_SQL = with_tables("gt", "det") + match_sql(0.5) + """,
 npos AS (SELECT image_id % 3 AS dataset, category_id, sum(1 - iscrowd) AS num_gts FROM gt GROUP BY ALL),
 dflags AS (SELECT *, image_id % 3 AS dataset FROM flags)""" + ap_sql("dflags", by="dataset, category_id") + """
 SELECT dataset, count(*) AS classes, round(avg(ap), 6) AS map FROM aps GROUP BY dataset"""


QUERIES = {
    "iou_join": iou_join,
    "overlap_measures": overlap_measures,
    "voc_match": voc_match,
    "voc_average_precision": voc_average_precision,
    "voc_11_points": voc_11_points,
    "voc_area_range": voc_area_range,
    "mean_average_precision": mean_average_precision,
    "group_of_ap": group_of_ap,
    "open_images_ap": open_images_ap,
    "reusable_match": reusable_match,
    "anchor_coverage": anchor_coverage,
    "nearest_center_match": nearest_center_match,
    "per_image_map": per_image_map,
    "best_and_worst_images": best_and_worst_images,
    "confusion_matrix": confusion_matrix,
    "multi_dataset_ap": multi_dataset_ap,
}
ORACLES = {
    "iou_join": IOU_JOIN_SQL,
    "overlap_measures": OVERLAP_MEASURES_SQL,
    "voc_match": VOC_MATCH_SQL,
    "voc_average_precision": VOC_AP_SQL,
    "voc_11_points": VOC_11_SQL,
    "voc_area_range": VOC_AREA_SQL,
    "mean_average_precision": MEAN_AP_SQL,
    "group_of_ap": GROUP_OF_SQL,
    "open_images_ap": OPEN_IMAGES_SQL,
    "reusable_match": REUSABLE_SQL,
    "anchor_coverage": ANCHOR_COVERAGE_SQL,
    "nearest_center_match": NEAREST_CENTER_SQL,
    "per_image_map": PER_IMAGE_SQL,
    "best_and_worst_images": BEST_WORST_SQL,
    "confusion_matrix": CONFUSION_SQL,
    "multi_dataset_ap": MULTI_DATASET_SQL,
}
