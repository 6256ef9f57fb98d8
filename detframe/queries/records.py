"""Box functions, cleaning rules, checks, logs and shape measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.functions import boxes as B
from detframe.operators import filters as FL
from detframe.operators import geometry as G
from detframe.operators import logs as L
from detframe.operators import quality as Q
from detframe.plans.once import rounded
from detframe.queries import tables as T
from detframe.queries.tables import area_sql, iou_sql, with_tables

COORDS = ("x1", "y1", "x2", "y2")


def _round(cols, n=6):
    return [F.round(c, n).alias(name) for name, c in cols.items()]


def box_moves(spark, sf):
    """Flip, clip, rescale, resize, rotate and project every detection."""
    b = B.box()
    out = {}
    for name, moved in {"flip": B.flip(b, "diagonal", F.lit(300.0), F.lit(250.0)), "clip": B.clip(b, 300, 250),
                        "half": B.resize_about_center(b, 0.5, 0.25), "turned": B.rotate(b, 150.0, 125.0, 30.0),
                        "warped": B.project(b, [[1.0, 0.1, 5.0], [0.05, 0.9, -3.0], [0.0001, 0.0002, 1.0]]),
                        "view": B.map_forward(b, F.lit(300.0), F.lit(250.0), 2.0, "horizontal"),
                        "back": B.map_back(B.map_forward(b, F.lit(300.0), F.lit(250.0), 2.0, "vertical"), F.lit(300.0), F.lit(250.0), 2.0, "vertical"),
                        "center": B.convert(b, "xyxy", "cxcywh"), "ratio": B.convert(b, "xyxy", "cxcyah")}.items():
        out.update({f"{name}_{i}": v for i, v in enumerate(moved)})
    return rounded(T.det(spark, sf), out, 6).select("det_id", *out)


def _moves_sql() -> str:
    pts = [("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")]
    cs, sn = "cos(radians(30))", "sin(radians(30))"
    tx = [f"{cs}*({x}-150)-{sn}*({y}-125)+150" for x, y in pts]
    ty = [f"{sn}*({x}-150)+{cs}*({y}-125)+125" for x, y in pts]
    wx = [f"({x}+0.1*{y}+5)/(0.0001*{x}+0.0002*{y}+1)" for x, y in pts]
    wy = [f"(0.05*{x}+0.9*{y}-3)/(0.0001*{x}+0.0002*{y}+1)" for x, y in pts]

    def hull(xs, ys):
        return [f"least({','.join(xs)})", f"least({','.join(ys)})", f"greatest({','.join(xs)})", f"greatest({','.join(ys)})"]
    cx, cy, w, h = "((x1+x2)/2)", "((y1+y2)/2)", "(x2-x1)", "(y2-y1)"
    cols = {"flip": ["300-x2", "250-y2", "300-x1", "250-y1"],
            "clip": ["least(greatest(x1,0),300)", "least(greatest(y1,0),250)", "least(greatest(x2,0),300)", "least(greatest(y2,0),250)"],
            "half": [f"{cx}-{w}*0.25", f"{cy}-{h}*0.125", f"{cx}+{w}*0.25", f"{cy}+{h}*0.125"],
            "turned": hull(tx, ty), "warped": hull(wx, wy), "view": ["600-2*x2", "2*y1", "600-2*x1", "2*y2"],
            "back": list(COORDS), "center": [cx, cy, w, h], "ratio": [cx, cy, f"{w}/{h}", h]}
    body = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}_{i}" for n, es in cols.items() for i, e in enumerate(es))
    return with_tables("det") + f" SELECT det_id, {body} FROM det"


def box_deltas(spark, sf):
    """Encode each well-overlapping pair in four ways, and decode again to the box."""
    from detframe.operators.overlap import overlap_pairs

    cols = ["image_id", "category_id", *COORDS]
    pairs = overlap_pairs(T.det(spark, sf).select("det_id", *cols), T.gt(spark, sf).select("ann_id", *cols), ["image_id", "category_id"],
                          "d_", "g_", min_overlap=0.6)
    d, g = B.box("d_"), B.box("g_")
    stds = (0.1, 0.1, 0.2, 0.2)
    e1 = B.encode_xywh_delta(d, g, stds=stds)
    e2 = B.encode_xywh_delta(d, g, legacy=True)
    e3 = B.encode_tblr(d, g)
    e4 = B.encode_grid_delta(d, g, 64.0)
    px, py = B.center(d)
    out = {}
    for name, v in {"xywh": e1, "legacy": e2, "tblr": e3, "grid": e4, "dist": B.box_to_distance(px, py, g),
                    "xywh_back": B.decode_xywh_delta(d, e1, stds=stds), "legacy_back": B.decode_xywh_delta(d, e2, legacy=True),
                    "tblr_back": B.decode_tblr(d, e3), "grid_back": B.decode_grid_delta(d, e4, 64.0),
                    "dist_back": B.distance_to_box(px, py, *B.box_to_distance(px, py, g))}.items():
        out.update({f"{name}_{i}": c for i, c in enumerate(v)})
    return rounded(pairs, out, 6).select(F.col("d_det_id").alias("det_id"), F.col("g_ann_id").alias("ann_id"), *out)


def _deltas_sql() -> str:
    cols = {"xywh": ["(gx-px)/pw/0.1", "(gy-py)/ph/0.1", "ln(gw/pw)/0.2", "ln(gh/ph)/0.2"],
            "legacy": ["(gx-px)/(pw+1)", "(gy-py)/(ph+1)", "ln((gw+1)/(pw+1))", "ln((gh+1)/(ph+1))"],
            "tblr": ["(py-b1)/ph/4", "(b3-py)/ph/4", "(px-b0)/pw/4", "(b2-px)/pw/4"],
            "grid": ["(gx-px)/64+0.5", "(gy-py)/64+0.5", "ln(gw/pw)", "ln(gh/ph)"], "dist": ["px-b0", "py-b1", "b2-px", "b3-py"],
            **{f"{n}_back": ["b0", "b1", "b2", "b3"] for n in ("xywh", "legacy", "tblr", "grid", "dist")}}
    body = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}_{i}" for n, es in cols.items() for i, e in enumerate(es))
    return with_tables("gt", "det") + f""",
 p AS (SELECT det_id, ann_id, (d.x1+d.x2)/2 AS px, (d.y1+d.y2)/2 AS py, d.x2-d.x1 AS pw, d.y2-d.y1 AS ph, (g.x1+g.x2)/2 AS gx, (g.y1+g.y2)/2 AS gy,
   g.x2-g.x1 AS gw, g.y2-g.y1 AS gh, g.x1 AS b0, g.y1 AS b1, g.x2 AS b2, g.y2 AS b3, {iou_sql('d', 'g')} AS iou
   FROM det d JOIN gt g ON d.image_id = g.image_id AND d.category_id = g.category_id)
 SELECT det_id, ann_id, {body} FROM p WHERE iou >= 0.6"""


def box_predicates(spark, sf):
    b = B.box()
    return T.det(spark, sf).select("det_id", B.is_inside(b, 260, 190, all_inside=True).alias("whole"), B.is_inside(b, 180, 120).alias("part"),
                                   B.is_inside(b, 260, 190, True, 5).alias("bordered"), B.contains_point(b, F.lit(100.0), F.lit(80.0)).alias("holds"))


PREDICATES_SQL = with_tables("det") + """ SELECT det_id, x1 >= 0 AND y1 >= 0 AND x2 < 260 AND y2 < 190 AS whole,
 x1 < 180 AND y1 < 120 AND x2 > 0 AND y2 > 0 AS part, x1 >= -5 AND y1 >= -5 AND x2 < 265 AND y2 < 195 AS bordered,
 x1 <= 100 AND x2 >= 100 AND y1 <= 80 AND y2 >= 80 AS holds FROM det"""


def valid_annotations(spark, sf):
    """Images are taken as 200 x 150, so that some boxes lie outside; class 4 is unknown."""
    ann = T.gt(spark, sf).withColumn("ignore", F.col("iscrowd"))
    images = T.images(spark, sf).withColumn("width", F.when(F.col("image_id") % 2 == 0, 150).otherwise(300)).withColumn("height", F.lit(100))
    return FL.valid_annotations(ann, images, T.categories(spark, sf).where("category_id < 4")).select("ann_id")


VALID_SQL = with_tables("gt") + """ SELECT ann_id FROM gt WHERE iscrowd = 0 AND category_id < 4
 AND x1 < CASE WHEN image_id % 2 = 0 THEN 150 ELSE 300 END AND y1 < 100"""


def filtered_images(spark, sf):
    """Images with a box of class 4 that is not small; all-crowd images drop out."""
    ann = T.gt(spark, sf)
    kept = FL.filter_images(T.images(spark, sf), FL.filter_small(ann, 60, 40), T.categories(spark, sf).where("category_id = 4"), min_size=100)
    return FL.drop_all_crowd(kept, ann)


FILTERED_IMAGES_SQL = with_tables("gt", "images") + """ SELECT * FROM images i
 WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = i.image_id AND category_id = 4 AND x2 - x1 > 60 AND y2 - y1 > 40)
   AND EXISTS (SELECT 1 FROM gt g WHERE g.image_id = i.image_id AND iscrowd = 0)"""


def filtered_frames(spark, sf):
    frames = T.images(spark, sf).select("image_id", F.floor(F.col("image_id") / 10).cast("long").alias("video_id"), "width", "height")
    return FL.filter_frames(frames, T.gt(spark, sf).where("category_id = 2 AND x1 < 20")).select("image_id", "video_id", "video_length")


FILTERED_FRAMES_SQL = with_tables("gt") + """, f AS (SELECT DISTINCT image_id, image_id // 10 AS video_id FROM gt WHERE category_id = 2 AND x1 < 20)
 SELECT image_id, video_id, count(*) OVER (PARTITION BY video_id) AS video_length FROM f"""


def class_split(spark, sf):
    images, ann, _ = FL.split_by_class(T.images(spark, sf), T.gt(spark, sf), T.categories(spark, sf), "novel")
    return ann.join(images.select("image_id"), "image_id", "left_semi").groupBy("category_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.countDistinct("image_id").alias("images"))


CLASS_SPLIT_SQL = with_tables("gt", "categories") + """ SELECT category_id, count(*) AS boxes, count(DISTINCT image_id) AS images
 FROM gt JOIN categories USING (category_id) WHERE split = 'novel' GROUP BY category_id"""


def rare_dropped(spark, sf):
    nested = FL.nest_instances(T.gt(spark, sf).select("image_id", "ann_id", "category_id"))
    out = FL.drop_rare(nested, [0, 3])
    return out.select("image_id", F.size("instances").cast("long").alias("n"), F.aggregate("instances", F.lit(0).cast("long"), lambda s, x: s + x["ann_id"]).alias("ids"))


RARE_SQL = with_tables("gt") + """ SELECT image_id, count(*) FILTER (category_id NOT IN (0, 3)) AS n,
 CAST(coalesce(sum(ann_id) FILTER (category_id NOT IN (0, 3)), 0) AS BIGINT) AS ids FROM gt GROUP BY image_id"""


def remapped_classes(spark, sf):
    table = T.categories(spark, sf).where("category_id > 1").select(F.col("category_id").alias("old_id"), (F.col("category_id") - 1).alias("new_id"))
    return FL.remap_classes(T.gt(spark, sf), table).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def selected_annotations(spark, sf):
    out = FL.select_annotations(T.gt(spark, sf), category_ids=[1, 2], area_range=(1000, 2000), crowd=False)
    return FL.border_filter(out.withColumn("width", F.lit(300)).withColumn("height", F.lit(250)), 10).select("ann_id")


SELECTED_SQL = with_tables("gt") + f""" SELECT ann_id FROM gt WHERE category_id IN (1, 2) AND iscrowd = 0 AND {area_sql('gt')} > 1000 AND {area_sql('gt')} < 2000
 AND x1 > 10 AND y1 > 10 AND x2 < 290 AND y2 < 240"""


def concatenated_sources(spark, sf):
    """Truth and detections as two sources; detections have a score of their own."""
    both = FL.concat_datasets({"gt": T.gt(spark, sf), "det": T.det(spark, sf)})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.count("iscrowd").alias("flagged"))


CONCAT_SQL = with_tables("gt", "det") + """ SELECT 'gt' AS source, count(*) AS n, 0 AS scored, count(*) AS flagged FROM gt
 UNION ALL SELECT 'det', count(*), count(score), 0 FROM det"""


def held_out_images(spark, sf):
    det = T.det(spark, sf)
    return FL.minus_ids(T.images(spark, sf), [det.where("score > 0.999"), T.gt(spark, sf).where("iscrowd = 1 AND x1 < 10")]).select("image_id")


HELD_OUT_SQL = with_tables("gt", "det", "images") + """ SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM det WHERE score > 0.999)
 AND image_id NOT IN (SELECT image_id FROM gt WHERE iscrowd = 1 AND x1 < 10)"""


def exploded_instances(spark, sf):
    """Parallel arrays per image, with the flag list cut short on every third image."""
    order = F.sort_array(F.collect_list(F.struct("ann_id", F.array(*COORDS).alias("b"), "category_id", (F.col("iscrowd") == 1).alias("f"))))
    nested = T.gt(spark, sf).groupBy("image_id").agg(order.alias("a")).select(
        "image_id", F.col("a.b").alias("boxes"), F.col("a.category_id").alias("labels"),
        F.when(F.col("image_id") % 3 == 0, F.slice("a.f", F.lit(1), F.size("a") - 1)).otherwise(F.col("a.f")).alias("ignore_flags"))
    return FL.explode_instances(nested).select("image_id", F.col("pos").cast("long").alias("pos"), *COORDS, "category_id", "ignore")


EXPLODED_SQL = with_tables("gt") + """ SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS pos, x1, y1, x2, y2, category_id,
 iscrowd = 1 AND image_id % 3 <> 0 AS ignore FROM gt"""


def renamed_categories(spark, sf):
    names = T.categories(spark, sf).where("category_id < 2").select("category_id", F.when(F.col("category_id") == 0, F.lit("renamed")).otherwise(F.col("name")).alias("new_name"))
    return FL.fix_names(T.categories(spark, sf).select("category_id", "name"), names)


RENAMED_SQL = with_tables("categories") + " SELECT category_id, CASE WHEN category_id = 0 THEN 'renamed' ELSE name END AS name, category_id = 0 AS renamed FROM categories"


def categories_per_image(spark, sf):
    return FL.categories_per_key(T.gt(spark, sf), "image_id")


PER_IMAGE_SQL = with_tables("gt") + " SELECT image_id, list_sort(list(DISTINCT category_id)) AS category_ids, count(*) AS boxes FROM gt GROUP BY image_id"


def _coco_like(spark, sf):
    x1, y1, x2, y2 = (F.col(c) for c in COORDS)
    odd = F.when(F.col("ann_id") % 13 == 0, F.array(x1, y1, x2, y2, x1)).otherwise(F.array(x1, y1, x2, y1, x2, y2, x1, y2))
    seg = F.when(F.col("ann_id") % 7 != 0, F.array(odd))
    return T.gt(spark, sf).select(
        "ann_id", F.when(F.col("ann_id") % 101 == 0, -1).otherwise(F.col("image_id")).alias("image_id"),
        F.when(F.col("ann_id") % 53 == 0, 99).otherwise(F.col("category_id")).alias("category_id"),
        (x1 - 2).alias("x"), y1.alias("y"), (x2 - x1 - F.when(F.col("ann_id") % 17 == 0, 40).otherwise(0)).alias("w"),
        F.when(F.col("ann_id") % 19 == 0, 2.0).otherwise(y2 - y1).alias("h"), ((x2 - x1 - 22) * (y2 - y1)).alias("area"), seg.alias("segmentation"))


def dataset_check(spark, sf):
    images = T.images(spark, sf).withColumn("width", F.lit(240)).withColumn("height", F.lit(180))
    out = Q.check_annotations(_coco_like(spark, sf), images, T.categories(spark, sf))
    return out.withColumn("relative_area_median", F.round("relative_area_median", 9)).withColumn("area_p95", F.round("area_p95", 6))


CHECK_SQL = with_tables("gt") + """,
 c AS (SELECT ann_id, ann_id % 101 <> 0 AS known, ann_id % 53 = 0 AS strange, x1 - 2 AS x, y1 AS y, x2 - x1 - CASE WHEN ann_id % 17 = 0 THEN 40 ELSE 0 END AS w,
   CASE WHEN ann_id % 19 = 0 THEN 2.0 ELSE y2 - y1 END AS h, (x2 - x1 - 22) * (y2 - y1) AS area, ann_id % 7 <> 0 AS seg, ann_id % 13 = 0 AS odd FROM gt),
 k AS (SELECT * FROM c WHERE known)
 SELECT (SELECT count(*) FROM c) AS annotations, (SELECT count(*) FROM c WHERE NOT known) AS unknown_img_id, count(*) FILTER (strange) AS unknown_cat_id,
  count(*) FILTER (w <= 0 OR h <= 0) AS non_positive_wh, count(*) FILTER (x < 0 OR y < 0) AS negative_coords, count(*) FILTER (x + w > 240) AS bbox_out_w,
  count(*) FILTER (y + h > 180) AS bbox_out_h, count(*) FILTER (w < 4 OR h < 4) AS tiny,
  count(*) FILTER (w > 0 AND h > 0 AND greatest(w / nullif(h, 0), h / nullif(w, 0)) > 20) AS extreme_aspect, count(*) FILTER (area <= 0) AS area_le_0,
  count(*) FILTER (NOT seg) AS missing_seg, count(*) FILTER (seg AND odd) AS odd_poly, count(*) FILTER (seg AND odd) AS small_poly,
  min(area) AS area_min, quantile_cont(area, 0.5) AS area_median, round(quantile_cont(area, 0.95), 6) AS area_p95, max(area) AS area_max,
  round(quantile_cont(area / CAST(43200 AS DOUBLE), 0.5), 9) AS relative_area_median FROM k"""


def duplicate_report(spark, sf):
    """Ids are folded so that some repeat."""
    images = T.images(spark, sf).select(F.floor(F.col("image_id") / 2).alias("image_id"), F.concat(F.lit("f"), F.col("image_id") % 100).alias("file_name"))
    return Q.duplicates(images, T.gt(spark, sf).select((F.col("ann_id") % 50000).alias("ann_id")))


DUPLICATES_SQL = with_tables("gt", "images") + """ SELECT 'image_id' AS field, count(*) - count(DISTINCT image_id // 2) AS duplicates FROM images
 UNION ALL SELECT 'file_name', count(*) - count(DISTINCT image_id % 100) FROM images UNION ALL SELECT 'ann_id', count(*) - count(DISTINCT ann_id % 50000) FROM gt"""


def missing_files(spark, sf):
    """Files exist for images that have a crowd box."""
    named = T.images(spark, sf).select("image_id", F.concat(F.lit("img_"), F.col("image_id")).alias("file_name"))
    listing = T.gt(spark, sf).where("iscrowd = 1").select(F.concat(F.lit("img_"), F.col("image_id")).alias("file_name"))
    return Q.missing_files(named, listing).select("image_id", "file_name")


MISSING_SQL = with_tables("gt", "images") + " SELECT image_id, 'img_' || image_id AS file_name FROM images WHERE image_id NOT IN (SELECT image_id FROM gt WHERE iscrowd = 1)"


def split_distance(spark, sf):
    """Class shares of even and odd images."""
    gt, images = T.gt(spark, sf), T.images(spark, sf)
    even, odd = (Q.category_counts(gt.where(F.col("image_id") % 2 == p), images) for p in (0, 1))
    return Q.distribution_distance(even, odd.where("category_id <> 2")).select(F.round("distance", 9).alias("distance"))


SPLIT_DISTANCE_SQL = with_tables("gt") + """,
 s AS (SELECT category_id, count(*) FILTER (image_id % 2 = 0) / CAST((SELECT count(*) FROM gt WHERE image_id % 2 = 0) AS DOUBLE) AS p,
   CASE WHEN category_id = 2 THEN 0 ELSE count(*) FILTER (image_id % 2 = 1) / CAST((SELECT count(*) FROM gt WHERE image_id % 2 = 1) AS DOUBLE) END AS q FROM gt GROUP BY 1)
 SELECT round(sum(abs(p - q)) / 2, 9) AS distance FROM s"""


def busiest_images(spark, sf):
    return Q.busiest_images(T.gt(spark, sf), 10)


def class_count_check(spark, sf):
    return Q.class_count_check(T.gt(spark, sf), 6).withColumn("configured", F.col("configured").cast("long"))


def _log(spark, sf):
    """Events as log lines: users are runs; purchases state the epoch that starts."""
    return T.read(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("run"), F.col("event_id").alias("line_no"), F.col("value").alias("time"),
        F.when(F.col("event_type") == "error", F.datediff("ts", F.lit("1970-01-01").cast("date")) % 1000).cast("long").alias("epoch"))


_LOG_SQL = """WITH l AS (SELECT user_id % 20 AS run, event_id AS line_no, value AS time,
   CASE WHEN event_type = 'error' THEN CAST(floor(epoch(ts) / 86400) AS BIGINT) % 1000 END AS epoch FROM events),
 e AS (SELECT run, line_no, time, coalesce(last_value(epoch IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS epoch FROM l)"""


def log_epochs(spark, sf):
    return L.carry_epoch(_log(spark, sf)).select("run", "line_no", "epoch")


def train_time(spark, sf):
    out = L.train_time(L.carry_epoch(_log(spark, sf)))
    return out.select("run", "slowest_epoch", "fastest_epoch", *[F.round(c, 6).alias(c) for c in ("slowest", "fastest", "std", "mean")])


TRAIN_TIME_SQL = _LOG_SQL + """,
 r AS (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY line_no) AS r FROM e),
 p AS (SELECT run, epoch, avg(time) AS m FROM r WHERE r > 1 GROUP BY ALL)
 SELECT run, first(epoch ORDER BY m DESC, epoch) AS slowest_epoch, first(epoch ORDER BY m, epoch) AS fastest_epoch, round(max(m), 6) AS slowest,
  round(min(m), 6) AS fastest, round(stddev_pop(m), 6) AS std, round(avg(m), 6) AS mean FROM p GROUP BY run"""


def loss_means(spark, sf):
    return L.loss_means(L.carry_epoch(_log(spark, sf)), ["time"]).select("run", "epoch", F.round("time", 6).alias("time"))


def _points(spark, sf):
    """Box corners and centres of each class of an image as one point set."""
    x1, y1, x2, y2 = (F.col(c) for c in COORDS)
    pts = F.explode(F.array(*[F.struct(r.alias("r"), c.alias("c")) for r, c in ((y1, x1), (y2, x2), (F.floor((y1 + y2) / 2).cast("double"), x2))])).alias("p")
    return T.gt(spark, sf).select("image_id", "category_id", pts).select("image_id", "category_id", "p.r", "p.c").distinct()


_POINTS_SQL = with_tables("gt") + """,
 pts AS (SELECT DISTINCT image_id, category_id, p.r AS r, p.c AS c FROM (SELECT image_id, category_id,
   unnest([{'r': y1, 'c': x1}, {'r': y2, 'c': x2}, {'r': floor((y1 + y2) / 2), 'c': x2}]) AS p FROM gt) t)"""


def shape_stats(spark, sf):
    out = G.shape_stats(_points(spark, sf), ["image_id", "category_id"])
    # what rounds to 60 is 0 again
    return out.select("image_id", "category_id", "width", "height", "area", (F.round("orientation", 5) % 60).alias("orientation"))


SHAPE_SQL = _POINTS_SQL + """,
 a AS (SELECT image_id, category_id, max(c) - min(c) AS width, max(r) - min(r) AS height, count(*) AS area,
   degrees(atan2(2 * (count(*) * sum(c * r) - sum(c) * sum(r)), count(*) * sum(c * c - r * r) - (sum(c) * sum(c) - sum(r) * sum(r))) / 2) AS deg FROM pts GROUP BY ALL)
 SELECT image_id, category_id, width, height, area, CASE WHEN area >= 3 THEN round(deg - 60 * floor(deg / 60), 5) % 60 ELSE 0 END AS orientation FROM a"""


def polygon_fit(spark, sf):
    poly = G.fit_polygon(_points(spark, sf), ["image_id", "category_id"], 6)
    out = G.polygon_measures(poly, ["image_id", "category_id"], 6, 0.5)
    return out.select("image_id", "category_id", *[F.round(c, 5).alias(c) for c in ("diagonal", "diagonal_angle", "edge_angle", "side_distance")])


POLYGON_SQL = _POINTS_SQL + """,
 m AS (SELECT image_id, category_id, avg(r) AS mr, avg(c) AS mc FROM pts GROUP BY ALL HAVING count(*) >= 3),
 d AS (SELECT j, cos(pi() / 2 + 2 * pi() * j / 6) AS dr, sin(pi() / 2 + 2 * pi() * j / 6) AS dc FROM (SELECT unnest(range(6)) AS j)),
 b AS (SELECT image_id, category_id, j, r, c FROM (SELECT image_id, category_id, j, r, c, row_number() OVER (PARTITION BY image_id, category_id, j
     ORDER BY round((r - mr) * dr + (c - mc) * dc, 9) DESC, r, c) AS k FROM pts JOIN m USING (image_id, category_id), d) t WHERE k = 1),
 a AS (SELECT image_id, category_id, list({'r': r, 'c': c} ORDER BY j) AS p FROM b GROUP BY ALL),
 f AS (SELECT *, list_position(list_transform(p, lambda s: s.c), list_min(list_transform(p, lambda s: s.c))) AS st FROM a),
 o AS (SELECT image_id, category_id, list_concat(p[st:6], p[1:(st - 1)]) AS p FROM f),
 g2 AS (SELECT *, list_sum(list_transform(range(1, 7), lambda i: (p[i % 6 + 1].r - p[i].r) * (p[i % 6 + 1].c + p[i].c))) AS area FROM o),
 q AS (SELECT image_id, category_id, CASE WHEN area < 0 THEN [p[1], p[6], p[5], p[4], p[3], p[2]] ELSE p END AS p FROM g2),
 w AS (SELECT image_id, category_id, p, degrees(atan2(p[4].c - p[1].c, p[4].r - p[1].r)) AS da, degrees(atan2(p[2].c - p[1].c, p[2].r - p[1].r)) AS ea,
   list_transform(range(1, 7), lambda i: {'r': p[i % 6 + 1].r - p[i].r, 'c': p[i % 6 + 1].c - p[i].c}) AS ed FROM q)
 SELECT image_id, category_id, round(0.5 * sqrt(power(p[1].r - p[4].r, 2) + power(p[1].c - p[4].c, 2)), 5) AS diagonal,
  round(da - 60 * floor(da / 60), 5) AS diagonal_angle, round(ea - 60 * floor(ea / 60), 5) AS edge_angle,
  round(0.5 * list_max(list_transform(ed, lambda e: CASE WHEN e.r = 0 AND e.c = 0 THEN 0 ELSE (list_max(list_transform(p, lambda v: v.c * e.r - v.r * e.c))
    - list_min(list_transform(p, lambda v: v.c * e.r - v.r * e.c))) / sqrt(e.r * e.r + e.c * e.c) END)), 5) AS side_distance FROM w"""


def hull_stats(spark, sf):
    by = ["image_id", "category_id"]
    return G.hull_stats(G.hull_vertices(_points(spark, sf), by), by)


def stepwise_matches(spark, sf):
    """Detections of odd images lie aside, so that few overlap by 0.8 and some images are matched by centre."""
    from detframe.operators.overlap import overlap_pairs

    aside = F.when(F.col("image_id") % 2 == 1, 12.0).otherwise(0.0)
    gt, det = T.gt(spark, sf), T.det(spark, sf).withColumns({"x1": F.col("x1") + aside, "x2": F.col("x2") + aside})
    cols = ["image_id", *COORDS]
    pairs = overlap_pairs(gt.select("ann_id", *cols), det.select("det_id", *cols), ["image_id"], "g_", "d_", min_overlap=0.8)
    common = (F.least("g_x2", "d_x2") - F.greatest("g_x1", "d_x1")) * (F.least("g_y2", "d_y2") - F.greatest("g_y1", "d_y1"))
    overlaps = pairs.select("image_id", F.col("g_ann_id").alias("a_id"), F.col("d_det_id").alias("b_id"), common.alias("n"))

    def placed(df, ident, name):
        cx, cy = B.center(B.box())
        return df.select("image_id", F.col(ident).alias(name), cx.alias("cx"), cy.alias("cy"))
    return G.match_in_steps(placed(gt, "ann_id", "a_id"), placed(det, "det_id", "b_id"), overlaps, 20.0)


def instance_assignment(spark, sf):
    """Truth and detections of an image paired at least total distance between centres, up to 30 pixels apart."""
    from detframe.operators.overlap import overlap_pairs

    cols = ["image_id", *COORDS]
    gt, det = T.gt(spark, sf), T.det(spark, sf)
    pairs = overlap_pairs(gt.select("ann_id", *cols), det.select("det_id", *cols), ["image_id"], "g_", "d_", min_overlap=0.3)
    cost = pairs.select("image_id", F.col("g_ann_id").alias("a_id"), F.col("d_det_id").alias("b_id"), B.center_distance(B.box("g_"), B.box("d_")).alias("cost")).where("cost <= 30")
    return G.match_instances(gt.withColumnRenamed("ann_id", "a_id"), det.withColumnRenamed("det_id", "b_id"), cost)


QUERIES = {f.__name__: f for f in (
    box_moves, box_deltas, box_predicates, valid_annotations, filtered_images, filtered_frames, class_split, rare_dropped, remapped_classes,
    selected_annotations, concatenated_sources, held_out_images, exploded_instances, renamed_categories, categories_per_image, dataset_check,
    duplicate_report, missing_files, split_distance, busiest_images, class_count_check, log_epochs, train_time, loss_means, shape_stats,
    polygon_fit, hull_stats, instance_assignment, stepwise_matches)}
ORACLES = {
    "box_moves": _moves_sql(),
    "box_deltas": _deltas_sql(),
    "box_predicates": PREDICATES_SQL,
    "valid_annotations": VALID_SQL,
    "filtered_images": FILTERED_IMAGES_SQL,
    "filtered_frames": FILTERED_FRAMES_SQL,
    "class_split": CLASS_SPLIT_SQL,
    "rare_dropped": RARE_SQL,
    "remapped_classes": with_tables("gt") + " SELECT CASE WHEN category_id > 1 THEN category_id - 1 ELSE 0 END AS category_id, count(*) AS n FROM gt GROUP BY 1",
    "selected_annotations": SELECTED_SQL,
    "concatenated_sources": CONCAT_SQL,
    "held_out_images": HELD_OUT_SQL,
    "exploded_instances": EXPLODED_SQL,
    "renamed_categories": RENAMED_SQL,
    "categories_per_image": PER_IMAGE_SQL,
    "dataset_check": CHECK_SQL,
    "duplicate_report": DUPLICATES_SQL,
    "missing_files": MISSING_SQL,
    "split_distance": SPLIT_DISTANCE_SQL,
    "busiest_images": with_tables("gt") + " SELECT image_id, count(*) AS n FROM gt GROUP BY image_id ORDER BY n DESC, image_id LIMIT 10",
    "class_count_check": with_tables("gt") + " SELECT count(DISTINCT category_id) AS classes, CAST(6 AS BIGINT) AS configured, count(DISTINCT category_id) = 6 AS matches FROM gt",
    "log_epochs": _LOG_SQL + " SELECT run, line_no, epoch FROM e",
    "train_time": TRAIN_TIME_SQL,
    "loss_means": _LOG_SQL + " SELECT run, epoch, round(avg(time), 6) AS time FROM e GROUP BY ALL",
    "shape_stats": SHAPE_SQL,
    "polygon_fit": POLYGON_SQL,
}
