"""Augmentation queries; random parameters are repeated by the SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.functions.hashing import hash_key_sql, uniform, uniform_sql
from detframe.operators import augment as A
from detframe.operators.segments import box_run_list
from detframe.plans.once import rounded
from detframe.queries import tables as T
from detframe.queries.sampling import _rank
from detframe.queries.tables import area_sql, with_tables

COORDS = ("x1", "y1", "x2", "y2")


def _boxes(spark, sf):
    return T.gt(spark, sf).select("image_id", "ann_id", *COORDS).withColumn("width", F.lit(T.IMAGE_W).cast("long")).withColumn("height", F.lit(T.IMAGE_H).cast("long"))


def _show(df, *more, keys=("image_id", "ann_id")):
    shown = df.select(*keys, *COORDS, *more)
    return rounded(shown, {c: F.col(c) for c in COORDS}, 5).select(*shown.columns)


def _shown(source: str, more: str = "", keys: str = "image_id, ann_id") -> str:
    cols = ", ".join(f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in COORDS)
    return f" SELECT {keys}, {cols}{more} FROM {source}"


GT = with_tables("gt")


def random_flip(spark, sf):
    return _show(A.random_flip(_boxes(spark, sf), {"horizontal": 0.3, "vertical": 0.3, "diagonal": 0.2}, 3), "flip")


RANDOM_FLIP_SQL = GT + f""",
 u AS (SELECT *, {uniform_sql(3, 'image_id')} AS u FROM gt),
 f AS (SELECT *, CASE WHEN u < 0.3 THEN 'horizontal' WHEN u < 0.6 THEN 'vertical' WHEN u < 0.8 THEN 'diagonal' END AS flip FROM u),
 o AS (SELECT image_id, ann_id, flip, CASE WHEN flip IN ('horizontal', 'diagonal') THEN 300 - x2 ELSE x1 END AS x1,
   CASE WHEN flip IN ('vertical', 'diagonal') THEN 250 - y2 ELSE y1 END AS y1, CASE WHEN flip IN ('horizontal', 'diagonal') THEN 300 - x1 ELSE x2 END AS x2,
   CASE WHEN flip IN ('vertical', 'diagonal') THEN 250 - y1 ELSE y2 END AS y2 FROM f)""" + _shown("o", ", flip")


def flipped_polygons(spark, sf):
    """A slanted quadrangle in every box, flipped with it."""
    made = _boxes(spark, sf).withColumn("poly", F.array("x1", "y1", "x2", F.col("y1") + 5, F.col("x2") - 3, "y2", "x1", F.col("y2") - 7))
    out = A.random_flip(made, {"horizontal": 0.3, "vertical": 0.3, "diagonal": 0.2}, 3, polygon="poly")
    return out.select("ann_id", "flip", *[F.get("poly", F.lit(i)).alias(f"p{i}") for i in range(8)])


def _flipped_polygons_sql() -> str:
    corners = ("x1", "y1", "x2", "y1 + 5", "x2 - 3", "y2", "x1", "y2 - 7")
    turned = [f"CASE WHEN flip IN ('{'vertical' if i % 2 else 'horizontal'}', 'diagonal') THEN {250 if i % 2 else 300} - ({c}) ELSE {c} END AS p{i}" for i, c in enumerate(corners)]
    return RANDOM_FLIP_SQL[:RANDOM_FLIP_SQL.index(" o AS (")].rstrip().rstrip(",") + f" SELECT ann_id, flip, {', '.join(turned)} FROM f"


def _clip(w: str, h: str) -> str:
    return (f"least(greatest(x1, 0), {w}) AS x1, least(greatest(y1, 0), {h}) AS y1, least(greatest(x2, 0), {w}) AS x2, least(greatest(y2, 0), {h}) AS y2")


def _warp_sql(head: str, px: str, py: str, w: str = "300", h: str = "250") -> str:
    """CTE ``hull`` from rows ``src`` and corner formulas in ``cx, cy``."""
    pts = [("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")]

    def corner(text, a, b):
        return "(" + text.replace("CX", a).replace("CY", b) + ")"
    xs, ys = [corner(px, *p) for p in pts], [corner(py, *p) for p in pts]
    return head + f""",
 hull AS (SELECT image_id, ann_id, old, least({', '.join(xs)}) AS x1, least({', '.join(ys)}) AS y1, greatest({', '.join(xs)}) AS x2, greatest({', '.join(ys)}) AS y2 FROM src),
 vis AS (SELECT * FROM hull WHERE x1 < {w} AND y1 < {h} AND x2 > 0 AND y2 > 0),
 cut AS (SELECT image_id, ann_id, old, {_clip(w, h)} FROM hull),
 viscut AS (SELECT image_id, ann_id, {_clip(w, h)} FROM vis)"""


def random_rotate(spark, sf):
    return _show(A.random_rotate(_boxes(spark, sf), 30.0, 5))


RANDOM_ROTATE_SQL = _warp_sql(GT + f""",
 src AS (SELECT *, {area_sql('gt')} AS old, radians(-30 + {uniform_sql(5, 'image_id')} * 60) AS a FROM gt)""",
                              "cos(a) * (CX - 150) - sin(a) * (CY - 125) + 150", "sin(a) * (CX - 150) + cos(a) * (CY - 125) + 125") + _shown(
    "cut") + " WHERE (x2 - x1) * (y2 - y1) >= old * 0.2 AND (x2 - x1) * (y2 - y1) >= 10"


def random_crop(spark, sf):
    return _show(A.random_crop(_boxes(spark, sf), 0.3, 1.0, 11), "width", "height")


RANDOM_CROP_SQL = GT + f""",
 c AS (SELECT *, CAST(floor(300 * (0.3 + {uniform_sql(11, 'image_id')} * CAST(0.7 AS DOUBLE))) AS BIGINT) AS cw,
   CAST(floor(250 * (0.3 + {uniform_sql(12, 'image_id')} * CAST(0.7 AS DOUBLE))) AS BIGINT) AS ch FROM gt),
 k AS (SELECT *, floor({uniform_sql(13, 'image_id')} * (300 - cw + 1)) AS ox, floor({uniform_sql(14, 'image_id')} * (250 - ch + 1)) AS oy FROM c),
 m AS (SELECT image_id, ann_id, {area_sql('k')} AS old, cw, ch, x1 - ox AS x1, y1 - oy AS y1, x2 - ox AS x2, y2 - oy AS y2 FROM k),
 cut AS (SELECT image_id, ann_id, old, cw, ch, {_clip('cw', 'ch')} FROM m)""" + _shown("cut", ", cw AS width, ch AS height") + """
 WHERE (x2 - x1) * (y2 - y1) >= old * 0.2 AND (x2 - x1) * (y2 - y1) >= 10"""


def min_iou_crop(spark, sf):
    """Fifty trials of windows with at least seven tenths of each side, and low overlap limits."""
    out = A.min_iou_crop(_boxes(spark, sf), T.images(spark, sf), (0.01, 0.02), 21, 50, 0.7)
    return _show(out, "width", "height")


MIN_IOU_SQL = with_tables("gt", "images") + f""",
 md AS (SELECT image_id, [1.0, 0.01, 0.02, 0.0][{hash_key_sql(21, 'image_id')} % 4 + 1] AS mode FROM images),
 tr AS (SELECT image_id, mode, unnest(range(1, 51)) AS trial FROM md WHERE mode < 1),
 sz AS (SELECT *, 300 * (0.7 + {uniform_sql(22, 'image_id', 'trial')} * CAST(0.3 AS DOUBLE)) AS nw, 250 * (0.7 + {uniform_sql(23, 'image_id', 'trial')} * CAST(0.3 AS DOUBLE)) AS nh FROM tr),
 ps AS (SELECT *, floor({uniform_sql(24, 'image_id', 'trial')} * (300 - nw)) AS px, floor({uniform_sql(25, 'image_id', 'trial')} * (250 - nh)) AS py FROM sz WHERE nh / nw BETWEEN 0.5 AND 2),
 wd AS (SELECT image_id, mode, trial, px, py, floor(px + nw) AS qx, floor(py + nh) AS qy FROM ps),
 ix AS (SELECT w.*, x1, y1, x2, y2, greatest(least(x2, qx) - greatest(x1, px), 0) * greatest(least(y2, qy) - greatest(y1, py), 0) AS it FROM wd w JOIN gt USING (image_id)),
 jd AS (SELECT image_id, trial, mode, px, py, qx, qy, min(it / greatest((qx-px)*(qy-py) + (x2-x1)*(y2-y1) - it, 1e-6)) AS low,
   max(CASE WHEN (x1+x2)/2 > px AND (y1+y2)/2 > py AND (x1+x2)/2 < qx AND (y1+y2)/2 < qy THEN 1 ELSE 0 END) AS yes FROM ix GROUP BY ALL),
 ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY trial) AS r FROM jd WHERE low >= mode AND yes = 1) t WHERE r = 1),
 o AS (SELECT gt.image_id, ann_id, CASE WHEN px IS NULL THEN x1 ELSE greatest(x1, px) - px END AS x1, CASE WHEN px IS NULL THEN y1 ELSE greatest(y1, py) - py END AS y1,
   CASE WHEN px IS NULL THEN x2 ELSE least(x2, qx) - px END AS x2, CASE WHEN px IS NULL THEN y2 ELSE least(y2, qy) - py END AS y2,
   CAST(CASE WHEN px IS NULL THEN 300 ELSE qx - px END AS BIGINT) AS width, CAST(CASE WHEN px IS NULL THEN 250 ELSE qy - py END AS BIGINT) AS height
   FROM gt LEFT JOIN ch USING (image_id) WHERE px IS NULL OR ((x1+x2)/2 > px AND (y1+y2)/2 > py AND (x1+x2)/2 < qx AND (y1+y2)/2 < qy))""" + _shown("o", ", width, height")


def expanded_canvas(spark, sf):
    return _show(A.expand(_boxes(spark, sf), 1.0, 4.0, 0.5, 31), "width", "height")


EXPAND_SQL = GT + f""",
 r AS (SELECT *, CASE WHEN {uniform_sql(31, 'image_id')} < 0.5 THEN 1 + {uniform_sql(32, 'image_id')} * 3 ELSE 1 END AS r FROM gt),
 k AS (SELECT *, floor({uniform_sql(33, 'image_id')} * (300 * r - 300)) AS ox, floor({uniform_sql(34, 'image_id')} * (250 * r - 250)) AS oy FROM r),
 o AS (SELECT image_id, ann_id, x1 + ox AS x1, y1 + oy AS y1, x2 + ox AS x2, y2 + oy AS y2, CAST(floor(300 * r) AS BIGINT) AS width, CAST(floor(250 * r) AS BIGINT) AS height FROM k)""" + _shown("o", ", width, height")


def random_shift(spark, sf):
    return _show(A.random_shift(_boxes(spark, sf), 0.5, 32, 1.0, 41))


RANDOM_SHIFT_SQL = GT + f""",
 k AS (SELECT *, CASE WHEN {uniform_sql(41, 'image_id')} < 0.5 THEN {hash_key_sql(42, 'image_id')} % 64 - 32 ELSE 0 END AS dx,
   CASE WHEN {uniform_sql(41, 'image_id')} < 0.5 THEN {hash_key_sql(43, 'image_id')} % 64 - 32 ELSE 0 END AS dy FROM gt),
 m AS (SELECT image_id, ann_id, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2 FROM k),
 o AS (SELECT image_id, ann_id, {_clip('300', '250')} FROM m)""" + _shown("o") + " WHERE x2 - x1 > 1 AND y2 - y1 > 1"


def resized_boxes(spark, sf):
    """Fit into 640 x 400, then the short edge to 320, then padding to a multiple of 32."""
    out = A.resize(_boxes(spark, sf).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 640, 400)
    return _show(A.pad(A.resize_shortest(out, 320, 1000), 32), "width", "height", F.round("area", 4).alias("area"))


RESIZE_SQL = GT + f""",
 o AS (SELECT image_id, ann_id, x1 * 1.6 * 0.8 AS x1, y1 * 1.6 * 0.8 AS y1, x2 * 1.6 * 0.8 AS x2, y2 * 1.6 * 0.8 AS y2, {area_sql('gt')} * 1.6 * 1.6 AS area FROM gt)""" + _shown(
    "o", ", CAST(384 AS BIGINT) AS width, CAST(320 AS BIGINT) AS height, round(CAST(area AS DOUBLE), 4) AS area")


def sheared_boxes(spark, sf):
    return _show(A.shear(_boxes(spark, sf), 20.0, "x", 51))


SHEAR_SQL = _warp_sql(GT + f", src AS (SELECT *, 0 AS old, tan(radians(-20 + {uniform_sql(51, 'image_id')} * 40)) AS t FROM gt)", "CX + t * CY", "CY") + _shown("viscut")


def translated_boxes(spark, sf):
    return _show(A.translate(_boxes(spark, sf), 0.3, "y", 53))


TRANSLATE_SQL = _warp_sql(GT + f", src AS (SELECT *, 0 AS old, (-0.3 + {uniform_sql(53, 'image_id')} * CAST(0.6 AS DOUBLE)) * 250 AS t FROM gt)", "CX", "CY + t") + _shown("viscut")


def random_affine(spark, sf):
    return _show(A.random_affine(_boxes(spark, sf), 10.0, 0.1, (0.5, 1.5), 2.0, 61))


def _u(seed, low, high):
    return f"({low} + {uniform_sql(seed, 'image_id')} * CAST({high - low} AS DOUBLE))"


AFFINE_SQL = _warp_sql(GT + f""",
 pa AS (SELECT *, radians({_u(61, -10, 10)}) AS a, {_u(62, 0.5, 1.5)} AS s, tan(radians({_u(63, -2, 2)})) AS kx, tan(radians({_u(64, -2, 2)})) AS ky,
   {_u(65, -0.1, 0.1)} * 300 AS tx, {_u(66, -0.1, 0.1)} * 250 AS ty FROM gt),
 src AS (SELECT *, 0 AS old FROM pa)""",
                       "(cos(a)*s*CX - sin(a)*s*CY) + kx * (sin(a)*s*CX + cos(a)*s*CY) + tx",
                       "ky * (cos(a)*s*CX - sin(a)*s*CY) + (sin(a)*s*CX + cos(a)*s*CY) + ty") + _shown("viscut")


def mosaic(spark, sf):
    out = A.mosaic(_boxes(spark, sf), T.images(spark, sf), (320, 320), (0.5, 1.5), 71)
    return _show(out, keys=("mosaic_id", "slot", "ann_id"))


MOSAIC_SQL = with_tables("gt", "images") + f""",
 rk AS (SELECT image_id AS partner_id, {_rank(71, 'image_id')} AS rank FROM images),
 dr AS (SELECT image_id AS mosaic_id, slot FROM images, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS slot)),
 sl AS (SELECT mosaic_id, slot, partner_id AS image_id FROM dr JOIN rk ON rank = {hash_key_sql(72, 'mosaic_id', 'slot')} % (SELECT count(*) FROM images) + 1
   UNION ALL SELECT image_id, 0, image_id FROM images),
 k AS (SELECT *, floor((0.5 + {uniform_sql(73, 'mosaic_id')}) * 320) AS cx, floor((0.5 + {uniform_sql(74, 'mosaic_id')}) * 320) AS cy FROM sl JOIN gt USING (image_id)),
 s AS (SELECT *, CAST(320 AS DOUBLE) / 300 AS f, CASE WHEN slot IN (0, 2) THEN cx - 320 ELSE cx END AS ox, CASE WHEN slot IN (0, 1) THEN cy - 267 ELSE cy END AS oy FROM k),
 hull AS (SELECT mosaic_id, slot, ann_id, x1 * f + ox AS x1, y1 * f + oy AS y1, x2 * f + ox AS x2, y2 * f + oy AS y2 FROM s),
 o AS (SELECT mosaic_id, slot, ann_id, {_clip('640', '640')} FROM hull WHERE x1 < 640 AND y1 < 640 AND x2 > 0 AND y2 > 0)""" + _shown("o", keys="mosaic_id, slot, ann_id")


def mixup(spark, sf):
    out = A.mixup(_boxes(spark, sf), T.images(spark, sf), (320, 320), (0.5, 1.5), 0.5, 81)
    return _show(out.withColumn("guest", F.col("guest").cast("long")), keys=("mix_id", "guest", "ann_id"))


MIXUP_SQL = with_tables("gt", "images") + f""",
 rk AS (SELECT image_id AS partner_id, {_rank(81, 'image_id')} AS rank FROM images),
 dr AS (SELECT image_id AS mix_id, partner_id FROM images JOIN rk ON rank = {hash_key_sql(82, 'image_id', '1')} % (SELECT count(*) FROM images) + 1),
 k AS (SELECT mix_id, ann_id, x1, y1, x2, y2, CAST(320 AS DOUBLE) / 300 * (0.5 + {uniform_sql(83, 'mix_id')}) AS f, {uniform_sql(84, 'mix_id')} < 0.5 AS m
   FROM dr JOIN gt ON gt.image_id = dr.partner_id),
 z AS (SELECT *, floor({uniform_sql(85, 'mix_id')} * greatest(300 * f - 300, 0)) AS ox, floor({uniform_sql(86, 'mix_id')} * greatest(250 * f - 250, 0)) AS oy FROM k),
 hull AS (SELECT mix_id, ann_id, CASE WHEN m THEN 300 * f - x2 * f ELSE x1 * f END - ox AS x1, y1 * f - oy AS y1,
   CASE WHEN m THEN 300 * f - x1 * f ELSE x2 * f END - ox AS x2, y2 * f - oy AS y2 FROM z),
 o AS (SELECT mix_id, 1 AS guest, ann_id, {_clip('300', '250')} FROM hull WHERE x1 < 300 AND y1 < 250 AND x2 > 0 AND y2 > 0
   UNION ALL SELECT image_id, 0, ann_id, x1, y1, x2, y2 FROM gt)""" + _shown("o", keys="mix_id, CAST(guest AS BIGINT) AS guest, ann_id")


def erased_boxes(spark, sf):
    return _show(A.erase(_boxes(spark, sf), A.random_patches(T.images(spark, sf), 4, 0.5, 91), 0.7))


ERASE_SQL = with_tables("gt", "images") + f""",
 nn AS (SELECT image_id, unnest(range(1, {hash_key_sql(91, 'image_id')} % 4 + 2)) AS patch FROM images),
 sz AS (SELECT *, floor({uniform_sql(92, 'image_id', 'patch')} * 0.5 * 300) AS w, floor({uniform_sql(93, 'image_id', 'patch')} * 0.5 * 250) AS h FROM nn),
 ps AS (SELECT *, floor({uniform_sql(94, 'image_id', 'patch')} * (300 - w)) AS px, floor({uniform_sql(95, 'image_id', 'patch')} * (250 - h)) AS py FROM sz),
 lo AS (SELECT ann_id, sum(greatest(least(x2, px + w) - greatest(x1, px), 0) * greatest(least(y2, py + h) - greatest(y1, py), 0)) AS lost FROM gt JOIN ps USING (image_id) GROUP BY 1),
 o AS (SELECT gt.*, lost FROM gt LEFT JOIN lo USING (ann_id))""" + _shown("o") + " WHERE coalesce(lost, 0) / ((x2 - x1) * (y2 - y1)) < 0.7"


def center_crop_pad(spark, sf):
    return _show(A.center_crop_pad(_boxes(spark, sf), 200, 160, 101))


CENTER_CROP_SQL = GT + f""",
 k AS (SELECT *, floor({uniform_sql(101, 'image_id')} * 300) - 100 AS ox, floor({uniform_sql(102, 'image_id')} * 250) - 80 AS oy FROM gt),
 m AS (SELECT image_id, ann_id, x1 - ox AS x1, y1 - oy AS y1, x2 - ox AS x2, y2 - oy AS y2 FROM k),
 o AS (SELECT image_id, ann_id, {_clip('200', '160')} FROM m WHERE (x1+x2)/2 > 0 AND (y1+y2)/2 > 0 AND (x1+x2)/2 < 200 AND (y1+y2)/2 < 160)""" + _shown("o")


def center_crop_search(spark, sf):
    """Windows of a size that many centres leave without a box."""
    return _show(A.center_crop_search(_boxes(spark, sf), T.images(spark, sf), 70, 60, 103, 20), "width", "height")


CENTER_SEARCH_SQL = with_tables("gt", "images") + f""",
 tr AS (SELECT image_id, unnest(range(1, 21)) AS trial FROM images),
 wd AS (SELECT *, floor({uniform_sql(103, 'image_id', 'trial')} * 300) - 35 AS ox, floor({uniform_sql(104, 'image_id', 'trial')} * 250) - 30 AS oy FROM tr),
 ft AS (SELECT DISTINCT image_id, trial, ox, oy FROM wd JOIN gt USING (image_id) WHERE (x1+x2)/2 > ox AND (y1+y2)/2 > oy AND (x1+x2)/2 < ox + 70 AND (y1+y2)/2 < oy + 60),
 ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY trial) AS r FROM ft) t WHERE r = 1),
 o AS (SELECT gt.image_id, ann_id, CASE WHEN ox IS NULL THEN x1 ELSE least(greatest(x1 - ox, 0), 70) END AS x1, CASE WHEN ox IS NULL THEN y1 ELSE least(greatest(y1 - oy, 0), 60) END AS y1,
   CASE WHEN ox IS NULL THEN x2 ELSE least(greatest(x2 - ox, 0), 70) END AS x2, CASE WHEN ox IS NULL THEN y2 ELSE least(greatest(y2 - oy, 0), 60) END AS y2,
   CAST(CASE WHEN ox IS NULL THEN 300 ELSE 70 END AS BIGINT) AS width, CAST(CASE WHEN ox IS NULL THEN 250 ELSE 60 END AS BIGINT) AS height
   FROM gt LEFT JOIN ch USING (image_id) WHERE ox IS NULL OR ((x1+x2)/2 > ox AND (y1+y2)/2 > oy AND (x1+x2)/2 < ox + 70 AND (y1+y2)/2 < oy + 60))""" + _shown("o", ", width, height")


def copy_paste(spark, sf):
    """The first three boxes of each image are pasted over its other boxes."""
    masks = _boxes(spark, sf).select("image_id", "ann_id", *COORDS, "height")
    return A.copy_paste_masks(masks, F.col("ann_id") % 1000 <= 3, 300.0, box_run_list(), F.col("x2") - F.col("x1"))


COPY_PASTE_SQL = GT + """,
 px AS (SELECT image_id, ann_id, x * 250 + unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS q FROM (
   SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM gt) t),
 top AS (SELECT DISTINCT image_id, q, 1 AS hid FROM px WHERE ann_id % 1000 <= 3)
 SELECT image_id, ann_id, count(*) AS area FROM px LEFT JOIN top USING (image_id, q) WHERE ann_id % 1000 > 3 AND hid IS NULL
 GROUP BY image_id, ann_id HAVING count(*) > 300"""


def pasted_objects(spark, sf):
    """About half of the next image's boxes are pasted over those of each image."""
    masks = _boxes(spark, sf).select("image_id", "ann_id", *COORDS, "height")
    pasted = masks.where(uniform(271, F.col("ann_id")) < 0.5).withColumn("image_id", F.col("image_id") - 1)
    out = A.pasted_objects(masks, pasted.join(masks.select("image_id").distinct(), "image_id", "left_semi"), runs=box_run_list())
    return out.select("image_id", "ann_id", "pasted", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "area")


PASTED_SQL = GT + f""",
 px AS (SELECT image_id, ann_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT *, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM (
   SELECT image_id, ann_id, y1, y2, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM gt) t) u),
 src AS (SELECT image_id - 1 AS image_id, ann_id, x1, y1, x2, y2 FROM gt WHERE {uniform_sql(271, 'ann_id')} < 0.5 AND image_id - 1 IN (SELECT image_id FROM gt)),
 top AS (SELECT DISTINCT s.image_id, x, y FROM src s JOIN px USING (ann_id)),
 rest AS (SELECT image_id, ann_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS area FROM px ANTI JOIN top USING (image_id, x, y) GROUP BY ALL)
 SELECT r.image_id, r.ann_id, false AS pasted, r.x1, r.y1, r.x2, r.y2, r.area FROM rest r JOIN gt g USING (ann_id)
 WHERE r.area > 300 OR (abs(r.x1 - g.x1) <= 10 AND abs(r.y1 - g.y1) <= 10 AND abs(r.x2 - g.x2) <= 10 AND abs(r.y2 - g.y2) <= 10)
 UNION ALL SELECT image_id, ann_id, true, x1, y1, x2, y2, CAST((x2 - x1) * (y2 - y1) AS BIGINT) FROM src"""


def random_policy(spark, sf):
    """Half of the images are shifted, half are padded onto a canvas."""
    out = A.random_choice(_boxes(spark, sf), [lambda d: A.translate(d, 0.3, "y", 53), lambda d: A.expand(d, 1.0, 4.0, 0.5, 31)], 111)
    return _show(out.withColumn("policy", F.col("policy").cast("long")), "policy")


def multi_branch(spark, sf):
    """Every image through a weak and a strong branch."""
    out = A.branches(_boxes(spark, sf), {"weak": lambda d: d, "strong": lambda d: A.random_shift(d, 0.5, 32, 1.0, 41)})
    return _show(out, "branch")


def dataset_expansion(spark, sf):
    """The original and two copies of each image; copies are rotated and filtered by what is left."""
    images = T.images(spark, sf).withColumn("file_name", F.concat(F.lit("img_"), F.col("image_id"), F.lit(".png")))
    both = _boxes(spark, sf).drop("width", "height").join(A.copies(images, 2), "image_id")
    kept = both.where("copy = 0").unionByName(A.random_rotate(both.where("copy > 0"), 30.0, 5, ("image_id", "copy")).drop("angle"))
    out = A.renumber(kept, ["ann_id"])
    return _show(out, "file_name", F.col("new_index").cast("long").alias("new_index"), keys=("image_id", "ann_id"))


EXPANSION_SQL = _warp_sql(GT + f""",
 src0 AS (SELECT *, {area_sql('gt')} AS old, unnest([1, 2]) AS copy FROM gt),
 src AS (SELECT image_id * 10 + copy AS image_id, ann_id, old, x1, y1, x2, y2, radians(-30 + {uniform_sql(5, 'image_id', 'copy')} * 60) AS a FROM src0)""",
                          "cos(a) * (CX - 150) - sin(a) * (CY - 125) + 150", "sin(a) * (CX - 150) + cos(a) * (CY - 125) + 125") + """,
 al AS (SELECT image_id // 10 AS image_id, image_id % 10 AS copy, ann_id, x1, y1, x2, y2 FROM cut WHERE (x2 - x1) * (y2 - y1) >= old * 0.2 AND (x2 - x1) * (y2 - y1) >= 10
   UNION ALL SELECT image_id, 0, ann_id, x1, y1, x2, y2 FROM gt)""" + _shown("al", """, 'img_' || image_id || CASE copy WHEN 0 THEN '_orig' ELSE '_aug' || copy END AS file_name,
 row_number() OVER (PARTITION BY image_id, copy ORDER BY ann_id) - 1 AS new_index""")


QUERIES = {f.__name__: f for f in (
    random_flip, flipped_polygons, random_rotate, random_crop, min_iou_crop, expanded_canvas, random_shift, resized_boxes, sheared_boxes,
    translated_boxes, random_affine, mosaic, mixup, erased_boxes, center_crop_pad, center_crop_search, copy_paste, pasted_objects, random_policy, multi_branch,
    dataset_expansion)}


def _sub(name: str, text: str) -> str:
    """One query's SQL as a CTE."""
    return f"{name} AS ({text})"


ORACLES = {
    "random_flip": RANDOM_FLIP_SQL,
    "flipped_polygons": _flipped_polygons_sql(),
    "random_rotate": RANDOM_ROTATE_SQL,
    "random_crop": RANDOM_CROP_SQL,
    "min_iou_crop": MIN_IOU_SQL,
    "expanded_canvas": EXPAND_SQL,
    "random_shift": RANDOM_SHIFT_SQL,
    "resized_boxes": RESIZE_SQL,
    "sheared_boxes": SHEAR_SQL,
    "translated_boxes": TRANSLATE_SQL,
    "random_affine": AFFINE_SQL,
    "mosaic": MOSAIC_SQL,
    "mixup": MIXUP_SQL,
    "erased_boxes": ERASE_SQL,
    "center_crop_pad": CENTER_CROP_SQL,
    "center_crop_search": CENTER_SEARCH_SQL,
    "copy_paste": COPY_PASTE_SQL,
    "pasted_objects": PASTED_SQL,
    "random_policy": "WITH " + _sub("moved", TRANSLATE_SQL) + ", " + _sub("padded", EXPAND_SQL) + f"""
 SELECT image_id, ann_id, x1, y1, x2, y2, CAST(0 AS BIGINT) AS policy FROM moved WHERE {uniform_sql(111, 'image_id')} < 0.5
 UNION ALL SELECT image_id, ann_id, x1, y1, x2, y2, 1 FROM padded WHERE {uniform_sql(111, 'image_id')} >= 0.5""",
    "multi_branch": "WITH " + _sub("strong", RANDOM_SHIFT_SQL) + ", " + _sub("weak", GT + _shown("gt")) + """
 SELECT *, 'strong' AS branch FROM strong UNION ALL SELECT *, 'weak' FROM weak""",
    "dataset_expansion": EXPANSION_SQL,
}
