"""Format conversions, polygons and run-length codes on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.functions import boxes as B
from detframe.functions import polygons as P
from detframe.functions.hashing import hash_key_sql
from detframe.operators.segments import box_run_list
from detframe.queries import tables as T
from detframe.queries.suppression import _recursive, nms_sql
from detframe.queries.tables import with_tables
from detframe.sinks import convert as C
from detframe.sources.annotations import closure
from detframe.sources.grounding import dense_phrases, expression_text, phrase_spans

COORDS = ("x1", "y1", "x2", "y2")


def coco_results(spark, sf):
    out = C.coco_results(T.det(spark, sf))
    return out.select("image_id", "category_id", "score", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")])


def coco_dataset(spark, sf):
    """New ids are contiguous although image and annotation ids are not."""
    def spread(df):
        return df.withColumn("image_id", F.col("image_id") * 3 + 1)
    _, rows = C.coco_dataset(spread(T.images(spark, sf)), spread(T.gt(spark, sf)))
    return rows.select("ann_id", "new_id", "new_image_id", "area")


COCO_DATASET_SQL = with_tables("gt", "images") + """,
 im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS new_image_id FROM images)
 SELECT ann_id, row_number() OVER (ORDER BY ann_id) AS new_id, new_image_id, (x2 - x1) * (y2 - y1) AS area FROM gt JOIN im USING (image_id)"""


def stored_proposals(spark, sf):
    return C.proposals(T.det(spark, sf), 15).select("image_id", "det_id", F.col("rank").cast("long").alias("rank"))


PROPOSALS_SQL = with_tables("det") + """ SELECT * FROM (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rank FROM det) t WHERE rank <= 15"""


def mot_lines(spark, sf):
    return C.mot_lines(T.pred_tracks(spark, sf))


MOT_SQL = with_tables("tr", "pred_tracks") + """ SELECT video_id, frame_id, track_id, printf('%d,%d,%.3f,%.3f,%.3f,%.3f,%.3f,-1,-1,-1',
 frame_id + 1, track_id, x1, y1, x2 - x1, y2 - y1, score) AS line FROM pred_tracks"""


def youtube_vis_results(spark, sf):
    lengths = T.pred_tracks(spark, sf).select("video_id").distinct().withColumn("video_length", F.lit(10).cast("long"))
    out = C.youtube_vis_results(T.pred_tracks(spark, sf), lengths)
    return out.select("video_id", "track_id", "category_id", F.round("score", 6).alias("score"), F.size("bboxes").cast("long").alias("frames"),
                      F.size(F.filter("bboxes", lambda b: b.isNull())).cast("long").alias("gaps"),
                      F.aggregate(F.filter("bboxes", lambda b: b.isNotNull()), F.lit(0.0), lambda s, b: s + b[2]).alias("widths"))


YOUTUBE_SQL = with_tables("tr", "pred_tracks") + """,
 v AS (SELECT video_id, track_id, category_id, count(*) AS n, sum(score) AS s, sum(x2 - x1) AS w FROM pred_tracks GROUP BY ALL)
 SELECT video_id, track_id, first(category_id ORDER BY n DESC, category_id) + 1 AS category_id, round(sum(s) / sum(n), 6) AS score, 10 AS frames,
   CAST(10 - sum(n) AS BIGINT) AS gaps, sum(w) AS widths FROM v GROUP BY video_id, track_id"""


def panoptic_results(spark, sf):
    return C.panoptic_segments(T.pred_runs(spark, sf))


def instance_lines(spark, sf):
    return C.instance_lines(T.det(spark, sf))


INSTANCE_SQL = with_tables("det") + """ SELECT image_id, printf('%d_%d_%d.png %d %.6f', image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) - 1,
 category_id, category_id, score) AS line FROM det"""


def odvg_records(spark, sf):
    """Nested records, shown as text; class 4 has no label and every tenth image is missing."""
    labels = T.categories(spark, sf).where("category_id < 4").select("category_id", F.col("category_id").alias("label"), F.col("name").alias("category"))
    images = T.images(spark, sf).withColumn("file_name", F.concat(F.lit("im"), F.col("image_id"))).withColumn("width", F.lit(150))
    out = C.to_odvg(images, T.gt(spark, sf), labels, images.where("image_id % 10 = 0"), "train/")
    text = F.transform("detection.instances", lambda x: F.concat_ws(" ", x["category"], x["label"].cast("string"), *[x["bbox"][i].cast("long").cast("string") for i in range(4)]))
    return out.select("image_id", "filename", F.size("detection.instances").cast("long").alias("n"), F.array_join(text, ";").alias("instances"))


ODVG_SQL = with_tables("gt", "images", "categories") + """,
 k AS (SELECT gt.*, name FROM gt JOIN categories USING (category_id) WHERE category_id < 4 AND iscrowd = 0 AND x1 < 150 AND image_id % 10 <> 0),
 a AS (SELECT image_id, count(*) AS n, string_agg(name || ' ' || category_id || ' ' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ' ' || CAST(x2 AS BIGINT) || ' ' || CAST(y2 AS BIGINT), ';' ORDER BY ann_id) AS s FROM k GROUP BY 1)
 SELECT image_id, 'train/im' || image_id AS filename, coalesce(n, 0) AS n, coalesce(s, '') AS instances FROM images LEFT JOIN a USING (image_id) WHERE image_id % 10 <> 0"""


def odvg_dump(spark, sf):
    out = C.dump_odvg(T.det(spark, sf), T.images(spark, sf), T.categories(spark, sf), 0.5, 0.5)
    text = F.transform("instances", lambda x: F.concat_ws(" ", x["category"], x["bbox"][0].cast("long").cast("string"), F.format_string("%.2f", x["score"])))
    return out.select("image_id", F.size("instances").cast("long").alias("n"), F.array_join(text, ";").alias("instances")).where("n > 0")


ODVG_DUMP_SQL = _recursive(with_tables("det", "categories")) + ", f AS (SELECT * FROM det WHERE score > 0.5)" + nms_sql("f", 0.5) + """
 SELECT image_id, count(*) AS n, string_agg(name || ' ' || CAST(x1 AS BIGINT) || ' ' || printf('%.2f', score), ';' ORDER BY det_id) AS instances
 FROM f JOIN kept USING (det_id) JOIN categories USING (category_id) GROUP BY image_id"""


def clean_captions(spark, sf):
    """Whole documents as captions."""
    out = C.clean_captions(T.read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


CLEAN_SQL = """WITH c AS (SELECT doc_id, text, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM documents),
 b AS (SELECT *, substring(t, 1, greatest(length(t) - 1, 0)) AS body FROM c)
 SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM b
 WHERE len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) < 240 AND NOT contains(body, '↙️') AND NOT contains(body, '[CLS]') AND NOT contains(body, '[SEP]')"""


def caption_phrases(spark, sf):
    """Three spans per document, spread over the whole text, the first of each phrase cut out of it."""
    base, third = F.col("doc_id") % 17, F.floor(F.length("text") / 3)
    spans = F.array(*[F.array(F.array((base + third * i).cast("long"), (base + third * i + 6).cast("long"))) for i in range(3)])
    rows = T.read(spark, sf, "documents").select("doc_id", "text", spans.alias("tokens"))
    return phrase_spans(rows).select("doc_id", F.col("nth").cast("long").alias("nth"), "phrase")


PHRASES_SQL = """SELECT doc_id, i AS nth, substring(text, CAST(doc_id % 17 + i * (length(text) // 3) + 1 AS BIGINT), 6) AS phrase FROM documents, (SELECT unnest(range(3)) AS i) t"""


def merged_spans(spark, sf):
    """Neighbouring spans joined, and their text joined by blanks."""
    d, third = F.col("doc_id"), F.floor(F.length("text") / 3)
    spans = F.array(*[F.array((third * i).cast("long"), (third * (i + 1) - 3 + (d + i) % 4).cast("long")) for i in (2, 0, 1)])
    rows = T.read(spark, sf, "documents").select("doc_id", "text", C.merged_spans(spans).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("spans"), C.span_text(F.col("text"), F.col("s")).alias("phrase"))


MERGED_SQL = """WITH s AS (SELECT doc_id, text, i, i * (length(text) // 3) AS a, (i + 1) * (length(text) // 3) - 3 + (doc_id + i) % 4 AS b FROM documents, (SELECT unnest(range(3)) AS i) t),
 m AS (SELECT *, CASE WHEN a <= max(b) OVER w + 1 THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a, b, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY a, b, i ROWS UNBOUNDED PRECEDING) AS grp FROM m),
 j AS (SELECT doc_id, text, grp, min(a) AS a, max(b) AS b FROM g GROUP BY ALL)
 SELECT doc_id, count(*) AS spans, string_agg(substring(text, CAST(a + 1 AS BIGINT), CAST(greatest(b - a, 0) AS BIGINT)), ' ' ORDER BY grp) AS phrase FROM j GROUP BY doc_id"""


def expression_texts(spark, sf):
    """Turns of a conversation as the sentences of an expression: first, and all joined."""
    rows = T.read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    s = F.col("s.text")
    return rows.select("conv_id", F.md5(expression_text(s, "select_first", 0)).alias("first"), F.md5(expression_text(s, "concat", 0)).alias("joined"))


EXPRESSION_SQL = """SELECT conv_id, md5(first(text ORDER BY turn, role, text)) AS first, md5(string_agg(text, '.' ORDER BY turn, role, text)) AS joined FROM conversations GROUP BY conv_id"""


def phrase_labels(spark, sf):
    """Sparse phrase ids per image renumbered densely."""
    rows = T.gt(spark, sf).select("image_id", "ann_id", (F.col("category_id") * 7 + 3).alias("phrase_id"))
    return dense_phrases(rows).select("ann_id", F.col("phrase_label").cast("long").alias("phrase_label"))


def half_split(spark, sf):
    frames = T.gt_tracks(spark, sf).select("video_id", "frame_id").distinct()
    return C.half_split(frames)


HALF_SQL = with_tables("tr", "gt_tracks") + """, f AS (SELECT DISTINCT video_id, frame_id FROM gt_tracks)
 SELECT video_id, frame_id, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY frame_id) <= count(*) OVER (PARTITION BY video_id) // 2 + 1 THEN 'train' ELSE 'val' END AS part FROM f"""


def global_instances(spark, sf):
    return C.global_instances(T.gt_tracks(spark, sf))


INSTANCES_SQL = with_tables("tr", "gt_tracks") + """ SELECT video_id, track_id, row_number() OVER (ORDER BY video_id, f, track_id) - 1 AS instance_id
 FROM (SELECT video_id, track_id, min(frame_id) AS f FROM gt_tracks GROUP BY ALL) t"""


def identity_crops(spark, sf):
    rows = T.pred_tracks(spark, sf).select("video_id", "track_id", F.col("det_id").alias("ann_id"), (F.col("category_id") % 2).alias("class_id"), F.col("score").alias("visibility"))
    out = C.identity_crops(rows, 0.2, 0.25, 3, 5, 47)
    return out.select("video_id", "track_id", "ann_id", "person", "part")


IDENTITY_SQL = with_tables("tr", "pred_tracks") + f""",
 k AS (SELECT video_id, track_id, det_id AS ann_id, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM pred_tracks WHERE category_id % 2 = 1 AND score >= 0.2),
 r AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY {hash_key_sql(47, 'ann_id')}, ann_id) AS r FROM k WHERE n >= 3),
 p AS (SELECT *, row_number() OVER (ORDER BY video_id, track_id) AS person, count(*) OVER () AS total FROM (SELECT DISTINCT video_id, track_id FROM r) d)
 SELECT video_id, track_id, ann_id, person - 1 AS person, CASE WHEN person <= CAST(floor(0.75 * total) AS BIGINT) THEN 'train' ELSE 'val' END AS part
 FROM r JOIN p USING (video_id, track_id) WHERE r <= 5"""


def class_closure(spark, sf):
    """Nations below regions below one root, as a class hierarchy."""
    nation, region = T.read(spark, sf, "nation"), T.read(spark, sf, "region")
    edges = (nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
             .unionByName(region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))))
    return closure(edges)


CLOSURE_SQL = """WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
 w AS (SELECT child, child AS ancestor FROM e UNION SELECT w.child, e.parent FROM w JOIN e ON w.ancestor = e.child) SELECT DISTINCT child, ancestor FROM w"""


def _hexagons(spark, sf):
    """A hexagon inside each box."""
    x1, y1, x2, y2 = (F.col(c) for c in COORDS)
    q, m = (x2 - x1) / 4, (y1 + y2) / 2
    return T.gt(spark, sf).select("image_id", "ann_id", F.array(x1, m, x1 + q, y1, x2 - q, y1, x2, m, x2 - q, y2, x1 + q, y2).alias("poly"), *COORDS)


def polygon_measures(spark, sf):
    p = F.col("poly")
    turned = P.affine(P.rescale(P.flip(P.translate(p, 5.0, -3.0), "diagonal", F.lit(300.0), F.lit(250.0)), 2.0, 0.5), [[1.0, 0.5, 1.0], [-0.25, 1.0, 2.0]])
    cut = P.crop(p, F.lit(50.0), F.lit(40.0), F.lit(150.0), F.lit(120.0))
    out = {"area": P.area(p), "turned_area": P.area(turned), "parts_area": P.parts_area(F.array(p, p)), "cut_area": P.area(cut)}
    out.update({f"box_{i}": c for i, c in enumerate(P.bbox(turned))})
    return _hexagons(spark, sf).select("ann_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


POLYGON_SQL = with_tables("gt") + """,
 h AS (SELECT *, (x2 - x1) / 4 AS q, (y1 + y2) / 2 AS m FROM gt),
 v AS (SELECT ann_id, [x1, x1 + q, x2 - q, x2, x2 - q, x1 + q] AS xs, [m, y1, y1, m, y2, y2] AS ys, x1, y1, x2, y2, q, m FROM h),
 t AS (SELECT *, list_transform(xs, lambda a: 2 * (300 - (a + 5))) AS us, list_transform(ys, lambda b: 0.5 * (250 - (b - 3))) AS vs FROM v),
 w AS (SELECT *, list_transform(range(1, 7), lambda i: us[i] + 0.5 * vs[i] + 1) AS ax, list_transform(range(1, 7), lambda i: -0.25 * us[i] + vs[i] + 2) AS ay FROM t),
 cols AS (SELECT ann_id, (x2 - x1) * (y2 - y1) * 0.75 AS area, (x2 - x1) * (y2 - y1) * 0.75 * 1 * (1 + 0.125) AS turned, ax, ay, x1, y1, x2, y2, q, m,
   greatest(x1, 50) AS ca, least(x2, 150) AS cb FROM w),
 brk AS (SELECT ann_id, x1, y1, x2, y2, q, m, ca, cb, list_sort(list_distinct(list_filter([ca, cb, x1 + q, x2 - q,
     x1 + q * (m - 40) / (m - y1), x2 - q * (m - 40) / (m - y1), x1 + q * (120 - m) / (y2 - m), x2 - q * (120 - m) / (y2 - m),
     x1 + q * (40 - m) / (y2 - m), x2 - q * (40 - m) / (y2 - m), x1 + q * (m - 120) / (m - y1), x2 - q * (m - 120) / (m - y1)], lambda z: z >= ca AND z <= cb))) AS zs FROM cols WHERE ca < cb),
 seg AS (SELECT *, zs[i] AS z0, zs[i + 1] AS z1 FROM (SELECT *, unnest(range(1, len(zs))) AS i FROM brk) s),
 hts AS (SELECT ann_id, z1 - z0 AS dz, [z0, z1] AS ends, x1, y1, x2, y2, q, m FROM seg),
 tops AS (SELECT ann_id, dz, list_transform(ends, lambda z: greatest(40, CASE WHEN z < x1 + q THEN m - (m - y1) * (z - x1) / q WHEN z > x2 - q THEN m - (m - y1) * (x2 - z) / q ELSE y1 END)) AS t,
   list_transform(ends, lambda z: least(120, CASE WHEN z < x1 + q THEN m + (y2 - m) * (z - x1) / q WHEN z > x2 - q THEN m + (y2 - m) * (x2 - z) / q ELSE y2 END)) AS b FROM hts),
 ar AS (SELECT ann_id, sum(dz * (greatest(b[1] - t[1], 0) + greatest(b[2] - t[2], 0)) / 2) AS cut FROM tops GROUP BY ann_id)
 SELECT ann_id, round(area, 6) AS area, round(turned, 6) AS turned_area, round(2 * area, 6) AS parts_area, round(coalesce(cut, 0), 6) AS cut_area,
   round(list_min(ax), 6) AS box_0, round(list_min(ay), 6) AS box_1, round(list_max(ax), 6) AS box_2, round(list_max(ay), 6) AS box_3 FROM cols LEFT JOIN ar USING (ann_id)"""


def filled_polygons(spark, sf):
    """Pixels and columns of each hexagon."""
    shapes = _hexagons(spark, sf).select("image_id", "ann_id", F.array("poly").alias("parts"), F.lit(250).alias("height"))
    runs = P.fill(shapes, ["image_id", "ann_id"])
    return runs.groupBy("ann_id").agg(F.sum("length").alias("pixels"), F.count(F.lit(1)).alias("runs"), F.sum("start").alias("starts"))


FILLED_SQL = with_tables("gt") + """,
 h AS (SELECT ann_id, x1, y1, x2, y2, (x2 - x1) / 4 AS q, (y1 + y2) / 2 AS m, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS c FROM gt),
 s AS (SELECT ann_id, c, c + 0.5 AS x, CASE WHEN c + 0.5 < x1 + q THEN (c + 0.5 - x1) / q WHEN c + 0.5 > x2 - q THEN (x2 - c - 0.5) / q ELSE 1 END AS f, y1, y2, m FROM h),
 y AS (SELECT ann_id, c, ceil(m - (m - y1) * f - 0.5) AS a, ceil(m + (y2 - m) * f - 0.5) AS b FROM s)
 SELECT ann_id, CAST(sum(b - a) AS BIGINT) AS pixels, count(*) AS runs, CAST(sum(c * 250 + a) AS BIGINT) AS starts FROM y WHERE b > a GROUP BY ann_id"""


def run_length_codes(spark, sf):
    """Box masks to counts, to the compressed string and back to runs."""
    boxes = T.gt(spark, sf).select("ann_id", *COORDS).withColumn("height", F.lit(250)).where("x2 > x1 AND y2 > y1")
    counts = boxes.select("ann_id", P.list_to_counts(P.merge_runs(box_run_list()), F.lit(75000)).alias("counts"))
    back = counts.withColumn("again", P.decode_rle(P.encode_rle("counts")))
    out = back.select("ann_id", (F.col("counts") == F.col("again")).alias("same"), P.counts_to_runs("again").alias("r"))
    return out.select("ann_id", "same", F.aggregate("r", F.lit(0).cast("long"), lambda s, r: s + r["length"]).alias("pixels"),
                      F.col("r")[0]["start"].alias("first"), F.size("r").cast("long").alias("runs"))


RLE_SQL = with_tables("gt") + """ SELECT ann_id, TRUE AS same, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS pixels, CAST(x1 * 250 + y1 AS BIGINT) AS first, CAST(x2 - x1 AS BIGINT) AS runs FROM gt"""


QUERIES = {f.__name__: f for f in (
    coco_results, coco_dataset, stored_proposals, mot_lines, youtube_vis_results, panoptic_results, instance_lines, odvg_records, odvg_dump,
    clean_captions, caption_phrases, merged_spans, expression_texts, phrase_labels, half_split, global_instances, identity_crops, class_closure,
    polygon_measures, filled_polygons, run_length_codes)}
ORACLES = {
    "coco_results": with_tables("det") + " SELECT image_id, category_id, score, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det",
    "coco_dataset": COCO_DATASET_SQL,
    "stored_proposals": PROPOSALS_SQL,
    "mot_lines": MOT_SQL,
    "youtube_vis_results": YOUTUBE_SQL,
    "panoptic_results": with_tables("pred_runs") + " SELECT image_id, label, CAST(sum(length) AS BIGINT) AS area FROM pred_runs WHERE label <> 0 GROUP BY ALL",
    "instance_lines": INSTANCE_SQL,
    "odvg_records": ODVG_SQL,
    "odvg_dump": ODVG_DUMP_SQL,
    "clean_captions": CLEAN_SQL,
    "caption_phrases": PHRASES_SQL,
    "merged_spans": MERGED_SQL,
    "expression_texts": EXPRESSION_SQL,
    "phrase_labels": with_tables("gt") + " SELECT ann_id, dense_rank() OVER (PARTITION BY image_id ORDER BY category_id) - 1 AS phrase_label FROM gt",
    "half_split": HALF_SQL,
    "global_instances": INSTANCES_SQL,
    "identity_crops": IDENTITY_SQL,
    "class_closure": CLOSURE_SQL,
    "polygon_measures": POLYGON_SQL,
    "filled_polygons": FILLED_SQL,
    "run_length_codes": RLE_SQL,
}
