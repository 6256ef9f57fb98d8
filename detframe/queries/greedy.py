"""Order-dependent matching and the metrics built on it, with recursive SQL as the check."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.operators import coco_metrics as C
from detframe.operators import crowd_metrics as CM
from detframe.operators import greedy as G
from detframe.operators.average_precision import average_precision, count_boxes
from detframe.queries import tables as T
from detframe.queries.detection import NPOS, _gt, ap_sql
from detframe.queries.suppression import _recursive
from detframe.queries.tables import area_sql, inter_sql, iou_sql, with_tables
from detframe.session import cut_lineage


def size_threshold_ap(spark, sf):
    flags = G.match_size_threshold(T.det(spark, sf), _gt(spark, sf), 0.5).withColumnRenamed("det_id", "row_id")
    out = average_precision(flags, count_boxes(_gt(spark, sf), ["category_id"]), ["category_id"])
    return out.withColumn("ap", F.round("ap", 6))


def walk_sql(source: str, keys: str, pairs: str) -> str:
    """CTE ``got(det_id, a)``: each detection in score order takes its best candidate still free.

    ``pairs(det_id, a, v)`` lists candidates; lowest ``a`` wins ties.
    """
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"o.{k} = w.{k}" for k in names)
    return f""",
 cands AS (SELECT det_id, list({{'v': -v, 'a': a}} ORDER BY -v, a) AS cs FROM {pairs} GROUP BY det_id),
 ordered AS (SELECT d.*, c.cs, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_id) AS r
   FROM {source} d JOIN cands c USING (det_id)),
 walk AS (
   SELECT {keys}, r, det_id, cs[1].a AS a, [cs[1].a] AS taken FROM ordered WHERE r = 1
   UNION ALL
   SELECT {keys}, r, det_id, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END
   FROM (SELECT {', '.join('o.' + k for k in names)}, o.r, o.det_id, w.taken,
           list_filter(o.cs, lambda c: NOT list_contains(w.taken, c.a))[1].a AS pick
         FROM walk w JOIN ordered o ON {same} AND o.r = w.r + 1) s),
 got AS (SELECT det_id, a FROM walk WHERE a IS NOT NULL)"""


SIZE_THRESHOLD_SQL = _recursive(with_tables("gt", "det")) + """,
 s AS (SELECT ann_id, image_id, category_id, iscrowd, x1-1 AS x1, y1-1 AS y1, x2-1 AS x2, y2-1 AS y2 FROM gt),
 p AS (SELECT * FROM (SELECT d.det_id, s.iscrowd * 1152921504606846976 + s.ann_id AS a, """ + iou_sql("d", "s") + """ AS v,
     least((s.x2-s.x1)*(s.y2-s.y1)/((s.x2-s.x1+10)*(s.y2-s.y1+10)), 0.5) AS thr
   FROM det d JOIN s ON d.image_id = s.image_id AND d.category_id = s.category_id) t WHERE v >= thr AND v > 0)""" + walk_sql(
    "det", "image_id, category_id", "p") + """,
 flags AS (SELECT d.det_id, d.category_id, d.score, CASE WHEN g.a < 1152921504606846976 THEN 1 ELSE 0 END AS tp,
     CASE WHEN g.a IS NULL THEN 1 ELSE 0 END AS fp FROM det d LEFT JOIN got g USING (det_id))""" + NPOS + ap_sql() + """
 SELECT category_id, num_gts, num_dets, round(ap, 6) AS ap FROM aps"""


def caltech_match(spark, sf):
    return G.match_caltech(T.det(spark, sf), _gt(spark, sf), 0.5).select(
        "det_id", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))


CALTECH = _recursive(with_tables("gt", "det")) + f""",
 p AS (SELECT * FROM (SELECT d.det_id, g.ann_id AS a, {iou_sql('d', 'g')} AS v
   FROM det d JOIN gt g ON d.image_id = g.image_id AND g.iscrowd = 0) t WHERE v > 0.5)""" + walk_sql("det", "image_id", "p") + f""",
 neutral AS (SELECT DISTINCT det_id FROM (SELECT d.det_id, ({inter_sql('d', 'g')}) / {area_sql('d')} AS v
   FROM det d JOIN gt g ON d.image_id = g.image_id AND g.iscrowd = 1) t WHERE v > 0.5),
 cflags AS (SELECT d.det_id, d.score, CAST(CASE WHEN g.a IS NULL THEN 0 ELSE 1 END AS BIGINT) AS tp,
     CAST(CASE WHEN g.a IS NULL AND n.det_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS fp
   FROM det d LEFT JOIN got g USING (det_id) LEFT JOIN neutral n USING (det_id))"""
CALTECH_SQL = CALTECH + " SELECT det_id, tp, fp FROM cflags"


def crowd_metrics(spark, sf):
    out = CM.crowd_metrics(G.match_caltech(T.det(spark, sf), _gt(spark, sf), 0.5), _gt(spark, sf))
    return out.select("num_gts", "num_images", F.round("ap", 6).alias("ap"), F.round("mr", 6).alias("mr"))


CROWD_SQL = CALTECH + """,
 tot AS (SELECT CAST(sum(1 - iscrowd) AS BIGINT) AS num_gts, count(DISTINCT image_id) AS num_images FROM gt),
 cum AS (SELECT row_number() OVER w AS i, CAST(sum(tp) OVER w AS DOUBLE) AS ctp, CAST(sum(fp) OVER w AS DOUBLE) AS cfp
   FROM cflags WHERE tp + fp > 0 WINDOW w AS (ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT i, num_gts, num_images, ctp / num_gts AS rec, ctp / (ctp + cfp) AS prec, cfp / num_images AS fppi FROM cum, tot),
 steps AS (SELECT *, lag(rec) OVER (ORDER BY i) AS r0, lag(prec) OVER (ORDER BY i) AS p0, 1 AS one FROM c),
 ref AS (SELECT unnest([0.0100, 0.0178, 0.03160, 0.0562, 0.1000, 0.1778, 0.3162, 0.5623, 1.000]) AS p),
 reads AS (SELECT p, coalesce(min(CASE WHEN fppi >= CAST(p AS DOUBLE) THEN i END), max(i)) AS i FROM ref, c GROUP BY p),
 m AS (SELECT exp(avg(ln(1 - rec))) AS mr FROM reads JOIN c USING (i))
 SELECT num_gts, num_images, round(sum((rec - r0) * (prec + p0) / 2), 6) AS ap, round(max(mr), 6) AS mr
 FROM steps, m GROUP BY num_gts, num_images"""


def max_matching_index(spark, sf):
    out = G.max_matching_index(T.det(spark, sf), _gt(spark, sf), [i / 10 for i in range(10)])
    return out.select("score_thr", F.round("ji", 6).alias("ji"))


def proposal_recall(spark, sf):
    out = G.proposal_recall(T.det(spark, sf), T.gt(spark, sf), (10, 30, 100), (0.5, 0.7, 0.9))
    return out.select(F.col("proposals").cast("long").alias("proposals"), "iou_thr", F.round("recall", 6).alias("recall"))


def proposal_recall_sql(nums: str, thrs: str, dataset: str = "0") -> str:
    """Twin of the operator: recall per (dataset, number of proposals, IoU), the dataset an expression of ``image_id``."""
    return _recursive(with_tables("gt", "det")) + f""",
 top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rank FROM det),
 nums AS (SELECT unnest([{nums}]) AS n),
 pairs AS (SELECT n, image_id, ann_id, det_id, v, row_number() OVER (PARTITION BY n, image_id ORDER BY v DESC, ann_id, det_id) AS r
   FROM (SELECT n, t.image_id, g.ann_id, t.det_id, {iou_sql('t', 'g')} AS v
         FROM nums JOIN top t ON t.rank <= n JOIN gt g ON g.image_id = t.image_id) p WHERE v > 0),
 walk AS (
   SELECT n, image_id, r, v, TRUE AS hit, [ann_id] AS ga, [det_id] AS da FROM pairs WHERE r = 1
   UNION ALL
   SELECT n, image_id, r, v, hit, CASE WHEN hit THEN list_append(ga, ann_id) ELSE ga END,
     CASE WHEN hit THEN list_append(da, det_id) ELSE da END
   FROM (SELECT p.*, w.ga, w.da, NOT list_contains(w.ga, p.ann_id) AND NOT list_contains(w.da, p.det_id) AS hit
         FROM walk w JOIN pairs p ON p.n = w.n AND p.image_id = w.image_id AND p.r = w.r + 1) s),
 whole AS (SELECT {dataset} AS dataset, count(*) AS total FROM gt GROUP BY 1),
 hits AS (SELECT {dataset} AS dataset, n, v FROM walk WHERE hit)
 SELECT w.dataset, CAST(nums.n AS BIGINT) AS proposals, t AS iou_thr, round(count(h.v) / CAST(max(total) AS DOUBLE), 6) AS recall
 FROM whole w CROSS JOIN nums CROSS JOIN (SELECT CAST(unnest([{thrs}]) AS DOUBLE) AS t) x
   LEFT JOIN hits h ON h.dataset = w.dataset AND h.n = nums.n AND h.v >= t GROUP BY w.dataset, nums.n, t"""


PROPOSAL_RECALL_SQL = f"SELECT proposals, iou_thr, recall FROM ({proposal_recall_sql('10, 30, 100', '0.5, 0.7, 0.9')}) t"


def _targets(spark, sf):
    """Every seventh image refers to nothing."""
    return T.gt(spark, sf).withColumn("no_target", F.col("image_id") % 7 == 0)


def referring_scores(spark, sf):
    out = G.referring_scores(T.det(spark, sf), _targets(spark, sf), 0.6, 0.5, 0.5)
    return out.select("image_id", F.col("tp").cast("long").alias("tp"), "preds", F.round("f1", 9).alias("f1"), "correct")


REFERRING = _recursive(with_tables("gt", "det")) + f""",
 pairs AS (SELECT image_id, ann_id, det_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, ann_id, det_id) AS r
   FROM (SELECT d.image_id, g.ann_id, d.det_id, {iou_sql('d', 'g')} AS v
         FROM det d JOIN gt g ON g.image_id = d.image_id WHERE d.score >= 0.6 AND d.image_id % 7 <> 0) p WHERE v >= 0.5),
 walk AS (
   SELECT image_id, r, TRUE AS hit, [ann_id] AS ga, [det_id] AS da FROM pairs WHERE r = 1
   UNION ALL
   SELECT image_id, r, hit, CASE WHEN hit THEN list_append(ga, ann_id) ELSE ga END,
     CASE WHEN hit THEN list_append(da, det_id) ELSE da END
   FROM (SELECT p.*, w.ga, w.da, NOT list_contains(w.ga, p.ann_id) AND NOT list_contains(w.da, p.det_id) AS hit
         FROM walk w JOIN pairs p ON p.image_id = w.image_id AND p.r = w.r + 1) s),
 per AS (SELECT g.image_id, coalesce(tp, 0) AS tp, coalesce(preds, 0) AS preds,
     CASE WHEN g.image_id % 7 = 0 THEN CASE WHEN coalesce(preds, 0) = 0 THEN 1.0 ELSE 0.0 END
          ELSE 2 * coalesce(tp, 0) / CAST(coalesce(preds, 0) + boxes AS DOUBLE) END AS f1
   FROM (SELECT image_id, count(*) AS boxes FROM gt GROUP BY 1) g
   LEFT JOIN (SELECT image_id, count(*) AS tp FROM walk WHERE hit GROUP BY 1) t USING (image_id)
   LEFT JOIN (SELECT image_id, count(*) AS preds FROM det WHERE score >= 0.6 GROUP BY 1) p USING (image_id))"""
REFERRING_SQL = REFERRING + " SELECT image_id, tp, preds, round(CAST(f1 AS DOUBLE), 9) AS f1, f1 >= 0.5 AS correct FROM per"


def referring_summary(spark, sf):
    out = G.referring_summary(G.referring_scores(T.det(spark, sf), _targets(spark, sf), 0.6, 0.5, 0.5))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


REFERRING_SUMMARY_SQL = REFERRING + """
 SELECT round(avg(CASE WHEN f1 >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS f1_score,
   round(avg(CASE WHEN image_id % 7 <> 0 THEN CASE WHEN preds > 0 THEN 1.0 ELSE 0.0 END END), 6) AS t_acc,
   round(avg(CASE WHEN image_id % 7 = 0 THEN CASE WHEN preds = 0 THEN 1.0 ELSE 0.0 END END), 6) AS n_acc FROM per"""


def _coco(spark, sf):
    det, gt = T.det(spark, sf), T.gt(spark, sf)
    return cut_lineage(C.coco_match(det, gt)), C.count_real(gt)  # read by both tables


def coco_match(spark, sf):
    """Matched and ignored flags of every (threshold, area range), one column of 40 bits each."""
    return C.coco_match(T.det(spark, sf), T.gt(spark, sf)).select(
        "det_id", F.col("det_rank").cast("long").alias("det_rank"), "tp_mask", "ignore_mask")


_AREAS = ("[{'a': 0, 'lo': 0.0, 'hi': 1e10}, {'a': 1, 'lo': 0.0, 'hi': 1024.0}, {'a': 2, 'lo': 1024.0, 'hi': 9216.0}, "
          "{'a': 3, 'lo': 9216.0, 'hi': 1e10}]")
COCO = _recursive(with_tables("gt", "det")) + f""",
 cells AS (SELECT r.a AS a, CAST(r.lo AS DOUBLE) AS lo, CAST(r.hi AS DOUBLE) AS hi, i, (50 + 5 * i) / CAST(100 AS DOUBLE) AS t
   FROM (SELECT unnest({_AREAS}) AS r) x, (SELECT unnest([0,1,2,3,4,5,6,7,8,9]) AS i) y),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, det_id) AS rank
   FROM det) s WHERE rank <= 100),
 pr AS (SELECT * FROM (SELECT d.det_id, g.ann_id, g.iscrowd AS c, {area_sql('g')} AS ga,
     CASE WHEN g.iscrowd = 1 THEN ({inter_sql('d', 'g')}) / {area_sql('d')} ELSE {iou_sql('d', 'g')} END AS v
   FROM top d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) s WHERE v >= 0.5),
 cs AS (SELECT det_id, a, i, list({{'g': g, 'n': n, 'id': ann_id, 'c': c}} ORDER BY g, n, -ann_id) AS cs
   FROM (SELECT det_id, a, i, ann_id, c, -v AS n, CASE WHEN c = 1 OR ga < lo OR ga > hi THEN 1 ELSE 0 END AS g
         FROM pr JOIN cells ON v >= t) s GROUP BY det_id, a, i),
 ordered AS (SELECT d.image_id, d.category_id, cs.*, row_number() OVER (PARTITION BY d.image_id, d.category_id, a, i ORDER BY rank) AS r
   FROM top d JOIN cs USING (det_id)),
 walk AS (
   SELECT image_id, category_id, a, i, r, det_id, cs[1] AS pick, [cs[1].id] AS taken FROM ordered WHERE r = 1
   UNION ALL
   SELECT image_id, category_id, a, i, r, det_id, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.id) END
   FROM (SELECT o.image_id, o.category_id, o.a, o.i, o.r, o.det_id, w.taken,
           list_filter(o.cs, lambda k: k.c = 1 OR NOT list_contains(w.taken, k.id))[1] AS pick
         FROM walk w JOIN ordered o ON o.image_id = w.image_id AND o.category_id = w.category_id AND o.a = w.a AND o.i = w.i
           AND o.r = w.r + 1) s),
 m AS (SELECT t.det_id, t.image_id, t.category_id, t.score, t.rank, c.a, c.i, c.t,
     CASE WHEN w.pick.g = 0 THEN 1 ELSE 0 END AS tp,
     CASE WHEN w.pick.g = 1 OR (w.pick IS NULL AND ({area_sql('t')} < lo OR {area_sql('t')} > hi)) THEN 1 ELSE 0 END AS ig
   FROM top t CROSS JOIN cells c LEFT JOIN walk w ON w.det_id = t.det_id AND w.a = c.a AND w.i = c.i)"""
COCO_MATCH_SQL = COCO + """
 SELECT det_id, rank AS det_rank, CAST(sum(tp * (1::BIGINT << (a * 10 + i))) AS BIGINT) AS tp_mask,
   CAST(sum(ig * (1::BIGINT << (a * 10 + i))) AS BIGINT) AS ignore_mask FROM m GROUP BY det_id, rank"""
_NAMES = "CASE a WHEN 0 THEN 'all' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END"
COCO_TABLES = COCO + f""",
 npos AS (SELECT category_id, a, count(*) AS npos FROM gt g JOIN (SELECT DISTINCT a, lo, hi FROM cells) c
   ON {area_sql('g')} >= lo AND {area_sql('g')} <= hi WHERE iscrowd = 0 GROUP BY category_id, a),
 cum AS (SELECT category_id, a, i, t, sum(tp) OVER w AS ctp, sum(1 - ig) OVER w AS n
   FROM m WINDOW w AS (PARTITION BY category_id, a, i ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
 pr2 AS (SELECT category_id, a, i, t, CAST(ctp AS DOUBLE) / n AS p, floor(ctp * 100 / npos) AS pt
   FROM cum JOIN npos USING (category_id, a) WHERE n > 0),
 pmax AS (SELECT category_id, a, i, pt, max(p) AS p FROM pr2 GROUP BY category_id, a, i, pt),
 pts AS (SELECT unnest(range(101)) AS q),
 grid AS (SELECT n.category_id, n.a, c.i, c.t, q FROM npos n JOIN cells c USING (a), pts),
 prec AS (SELECT g.category_id, g.a, g.i, g.t, g.q, coalesce(max(p), 0) AS p FROM grid g
   LEFT JOIN pmax x ON x.category_id = g.category_id AND x.a = g.a AND x.i = g.i AND x.pt >= g.q GROUP BY ALL),
 aps AS (SELECT category_id, {_NAMES} AS area, t AS iou_thr, avg(p) AS ap FROM prec GROUP BY category_id, a, t),
 ars AS (SELECT n.category_id, {_NAMES} AS area, md AS max_det, sum(CASE WHEN rank <= md THEN tp ELSE 0 END) / 10.0 / max(npos) AS ar
   FROM npos n JOIN m USING (category_id, a), (SELECT unnest([1, 10, 100]) AS md) x GROUP BY n.category_id, a, md)"""


def coco_precision(spark, sf):
    m, npos = _coco(spark, sf)
    return C.precision_table(m, npos).select("category_id", "area", "iou_thr", F.round("ap", 6).alias("ap"))


COCO_PRECISION_SQL = COCO_TABLES + " SELECT category_id, area, iou_thr, round(ap, 6) AS ap FROM aps"


def coco_recall(spark, sf):
    m, npos = _coco(spark, sf)
    return C.recall_table(m, npos).select("category_id", "area", F.col("max_det").cast("long").alias("max_det"),
                                          F.round("ar", 6).alias("ar"))


COCO_RECALL_SQL = COCO_TABLES + " SELECT category_id, area, CAST(max_det AS BIGINT) AS max_det, round(ar, 6) AS ar FROM ars"


def coco_summary(spark, sf):
    m, npos = _coco(spark, sf)
    out = C.summarise(C.precision_table(m, npos), C.recall_table(m, npos))
    return out.withColumn("value", F.round("value", 6))


COCO_SUMMARY_SQL = COCO_TABLES + """
 SELECT metric, round(value, 6) AS value FROM (
   SELECT 'AP' AS metric, avg(CASE WHEN area = 'all' THEN ap END) AS value FROM aps
   UNION ALL SELECT 'AP50', avg(CASE WHEN area = 'all' AND iou_thr = 0.5 THEN ap END) FROM aps
   UNION ALL SELECT 'AP75', avg(CASE WHEN area = 'all' AND iou_thr = 0.75 THEN ap END) FROM aps
   UNION ALL SELECT 'AP_' || k, avg(CASE WHEN area = k THEN ap END) FROM aps, (SELECT unnest(['small','medium','large']) AS k) GROUP BY k
   UNION ALL SELECT 'AR_' || k, avg(CASE WHEN area = 'all' AND max_det = k THEN ar END) FROM ars, (SELECT unnest([1,10,100]) AS k) GROUP BY k
   UNION ALL SELECT 'AR_' || k, avg(CASE WHEN area = k AND max_det = 100 THEN ar END) FROM ars, (SELECT unnest(['small','medium','large']) AS k) GROUP BY k) u"""


def coco_classwise(spark, sf):
    m, npos = _coco(spark, sf)
    out = C.classwise(C.precision_table(m, npos))
    return out.select("category_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "category_id"])


COCO_CLASSWISE_SQL = COCO_TABLES + """
 SELECT category_id, round(avg(CASE WHEN area = 'all' THEN ap END), 6) AS ap,
   round(avg(CASE WHEN area = 'all' AND iou_thr = 0.5 THEN ap END), 6) AS ap50,
   round(avg(CASE WHEN area = 'all' AND iou_thr = 0.75 THEN ap END), 6) AS ap75,
   round(avg(CASE WHEN area = 'small' THEN ap END), 6) AS ap_small,
   round(avg(CASE WHEN area = 'medium' THEN ap END), 6) AS ap_medium,
   round(avg(CASE WHEN area = 'large' THEN ap END), 6) AS ap_large FROM aps GROUP BY category_id"""


def _split(column):
    def run(spark, sf):
        m, npos = _coco(spark, sf)
        out = C.split_means(C.precision_table(m, npos), T.categories(spark, sf), column)
        return out.select(column, F.round("ap", 6).alias("ap"), F.round("ap50", 6).alias("ap50"))
    return run


def _split_sql(column: str) -> str:
    return COCO_TABLES + ", " + T.SQL["categories"] + f"""
 SELECT {column}, round(avg(ap), 6) AS ap, round(avg(CASE WHEN iou_thr = 0.5 THEN ap END), 6) AS ap50
 FROM aps JOIN categories USING (category_id) WHERE area = 'all' GROUP BY {column}"""


def coco_error_breakdown(spark, sf):
    out = C.error_breakdown(T.det(spark, sf), T.gt(spark, sf), T.categories(spark, sf))
    return out.withColumn("ap", F.round("ap", 6))


def coco_proposal_recall(spark, sf):
    """Average recall without classes."""
    gt = T.gt(spark, sf)
    m = C.coco_match(T.det(spark, sf), gt, use_category=False)
    npos = C.count_real(gt, by=()).withColumn("one", F.lit(1))
    out = C.recall_table(m.withColumn("one", F.lit(1)), npos, by=("one",))
    return out.select("area", F.col("max_det").cast("long").alias("max_det"), F.round("ar", 6).alias("ar"))


COCO_PROPOSAL_RECALL_SQL = (COCO.replace("d.category_id = g.category_id", "1 = 1")
                            .replace("PARTITION BY image_id, category_id ORDER", "PARTITION BY image_id ORDER")
                            .replace("PARTITION BY d.image_id, d.category_id, a, i", "PARTITION BY d.image_id, a, i")
                            .replace("AND o.category_id = w.category_id ", "")) + f""",
 npos AS (SELECT a, count(*) AS npos FROM gt g JOIN (SELECT DISTINCT a, lo, hi FROM cells) c
   ON {area_sql('g')} >= lo AND {area_sql('g')} <= hi WHERE iscrowd = 0 GROUP BY a)
 SELECT {_NAMES} AS area, CAST(md AS BIGINT) AS max_det, round(sum(CASE WHEN rank <= md THEN tp ELSE 0 END) / 10.0 / max(npos), 6) AS ar
 FROM npos n JOIN m USING (a), (SELECT unnest([1, 10, 100]) AS md) x GROUP BY a, md"""


def fixed_ap(spark, sf):
    """AP50 where each class keeps its best detections over the whole dataset and only judged classes count."""
    gt = T.gt(spark, sf)
    verified = gt.select("image_id", "category_id").distinct()
    best = C.top_per_category(C.federated(T.det(spark, sf), verified), 5000)
    table = C.precision_table(C.coco_match(best, gt, (0.5,), max_det=5000), C.count_real(gt), (0.5,))
    out = C.split_means(table, T.categories(spark, sf), "frequency")
    return out.select("frequency", F.round("ap", 6).alias("ap"))


FIXED_AP_SQL = _recursive(with_tables("gt", "det", "categories")) + f""",
 best AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, det_id) AS k
   FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.category_id = d.category_id)) s WHERE k <= 5000),
 p AS (SELECT det_id, ann_id AS a, v, c FROM (SELECT d.det_id, g.ann_id, g.iscrowd AS c,
     CASE WHEN g.iscrowd = 1 THEN ({inter_sql('d', 'g')}) / {area_sql('d')} ELSE {iou_sql('d', 'g')} END AS v
   FROM best d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id) s WHERE v >= 0.5),
 p2 AS (SELECT det_id, -a AS a, v FROM p WHERE c = 0)""" + walk_sql("best", "image_id, category_id", "p2") + """,
 f AS (SELECT b.det_id, b.category_id, b.score, CASE WHEN g.a IS NULL THEN 0 ELSE 1 END AS tp,
     CASE WHEN g.a IS NULL AND EXISTS (SELECT 1 FROM p WHERE p.det_id = b.det_id AND c = 1) THEN 1 ELSE 0 END AS ig
   FROM best b LEFT JOIN got g USING (det_id)),
 npos AS (SELECT category_id, count(*) AS npos FROM gt WHERE iscrowd = 0 GROUP BY category_id),
 cum AS (SELECT category_id, sum(tp) OVER w AS ctp, sum(1 - ig) OVER w AS n FROM f
   WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
 pr2 AS (SELECT category_id, CAST(ctp AS DOUBLE) / n AS p, floor(ctp * 100 / npos) AS pt FROM cum JOIN npos USING (category_id) WHERE n > 0),
 prec AS (SELECT n.category_id, q, coalesce(max(p), 0) AS p FROM npos n CROSS JOIN (SELECT unnest(range(101)) AS q)
   LEFT JOIN pr2 x ON x.category_id = n.category_id AND x.pt >= q GROUP BY ALL),
 aps AS (SELECT category_id, avg(p) AS ap FROM prec GROUP BY category_id)
 SELECT frequency, round(avg(ap), 6) AS ap FROM aps JOIN categories USING (category_id) GROUP BY frequency"""


QUERIES = {
    "size_threshold_ap": size_threshold_ap,
    "caltech_match": caltech_match,
    "crowd_metrics": crowd_metrics,
    "max_matching_index": max_matching_index,
    "proposal_recall": proposal_recall,
    "referring_scores": referring_scores,
    "referring_summary": referring_summary,
    "coco_match": coco_match,
    "coco_precision": coco_precision,
    "coco_recall": coco_recall,
    "coco_summary": coco_summary,
    "coco_classwise": coco_classwise,
    "coco_open_vocabulary": _split("split"),
    "coco_by_frequency": _split("frequency"),
    "coco_error_breakdown": coco_error_breakdown,
    "coco_proposal_recall": coco_proposal_recall,
    "fixed_ap": fixed_ap,
}
ORACLES = {
    "size_threshold_ap": SIZE_THRESHOLD_SQL,
    "caltech_match": CALTECH_SQL,
    "crowd_metrics": CROWD_SQL,
    "proposal_recall": PROPOSAL_RECALL_SQL,
    "referring_scores": REFERRING_SQL,
    "referring_summary": REFERRING_SUMMARY_SQL,
    "coco_match": COCO_MATCH_SQL,
    "coco_precision": COCO_PRECISION_SQL,
    "coco_recall": COCO_RECALL_SQL,
    "coco_summary": COCO_SUMMARY_SQL,
    "coco_classwise": COCO_CLASSWISE_SQL,
    "coco_open_vocabulary": _split_sql("split"),
    "coco_by_frequency": _split_sql("frequency"),
    "coco_proposal_recall": COCO_PROPOSAL_RECALL_SQL,
    "fixed_ap": FIXED_AP_SQL,
}
