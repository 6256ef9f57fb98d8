"""Sampling queries; draws use integer arithmetic that plain SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from detframe.functions.hashing import hash_key_sql, uniform_sql
from detframe.operators import sampling as S
from detframe.queries import tables as T
from detframe.queries.tables import with_tables

IMG = with_tables("images")


def _rank(seed: int, ident: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {uniform_sql(seed, ident)}, {ident})"


def labeled_split(spark, sf):
    return S.split_labeled(T.images(spark, sf), 10.0, 7).select("image_id", "labeled")


def labeled_split_replace(spark, sf):
    return S.split_labeled(T.images(spark, sf), 10.0, 7, replace=True).select("image_id", "labeled")


def mini_dataset(spark, sf):
    chosen = S.take_exact(T.images(spark, sf), "image_id", 100, 3)
    return S.follow(chosen, T.gt(spark, sf)).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))


def _by_class(spark, sf):
    return T.gt(spark, sf).select("category_id", "image_id").distinct()


def class_aware_sample(spark, sf):
    """Class 3 is spread over four classes, which are small enough to start over."""
    spread = F.when(F.col("category_id") == 3, 3 + 5 * (F.col("image_id") % 4)).otherwise(F.col("category_id"))
    return S.class_aware(_by_class(spark, sf).withColumn("category_id", spread), 4000, 2, 5)


CLASS_AWARE_SQL = with_tables("gt") + f""",
 bc AS (SELECT DISTINCT CASE WHEN category_id = 3 THEN 3 + 5 * (image_id % 4) ELSE category_id END AS category_id, image_id FROM gt),
 rk AS (SELECT *, {_rank(5, 'image_id', 'category_id')} AS rank, count(*) OVER (PARTITION BY category_id) AS size FROM bc),
 cl AS (SELECT category_id, size, row_number() OVER (ORDER BY {hash_key_sql(6, 'category_id')}, category_id) - 1 AS turn FROM (SELECT DISTINCT category_id, size FROM rk)),
 dr AS (SELECT position, position // 2 % 8 AS turn, position // 16 * 2 + position % 2 AS nth FROM (SELECT unnest(range(4000)) AS position))
 SELECT position, rk.category_id, image_id FROM dr JOIN cl USING (turn) JOIN rk ON rk.category_id = cl.category_id AND rk.rank = nth % cl.size + 1"""


def repeat_factors(spark, sf):
    """Classes 2 to 4 are spread over 20, 30 and 40 classes each, which are rare."""
    c = F.col("category_id")
    rare = _by_class(spark, sf).withColumn("category_id", F.when(c >= 2, c + 5 * (F.col("image_id") % (c * 10))).otherwise(c))
    return S.repeat_factors(rare, 0.2, 9).withColumn("factor", F.round("factor", 9))


REPEAT_SQL = with_tables("gt") + f""",
 bc AS (SELECT DISTINCT CASE WHEN category_id >= 2 THEN category_id + 5 * (image_id % (category_id * 10)) ELSE category_id END AS category_id, image_id FROM gt),
 f AS (SELECT category_id, greatest(1, sqrt(0.2 / (count(*) / CAST((SELECT count(DISTINCT image_id) FROM bc) AS DOUBLE)))) AS r FROM bc GROUP BY 1),
 im AS (SELECT image_id, max(r) AS factor FROM bc JOIN f USING (category_id) GROUP BY 1)
 SELECT image_id, round(factor, 9) AS factor, unnest(range(1, CAST(floor(factor) AS BIGINT) + 1 + CASE WHEN {uniform_sql(9, 'image_id')} < factor - floor(factor) THEN 1 ELSE 0 END)) AS copy FROM im"""


def _sources(spark, sf):
    return T.images(spark, sf).withColumn("source", F.when(F.col("image_id") % 10 < 6, 0).when(F.col("image_id") % 10 < 9, 1).otherwise(2))


_SRC = """ src AS (SELECT *, CASE WHEN image_id % 10 < 6 THEN 0 WHEN image_id % 10 < 9 THEN 1 ELSE 2 END AS source FROM images)"""


def multi_source_batches(spark, sf):
    out = S.multi_source_batches(_sources(spark, sf), 8, (3, 1, 1), 200, 11)
    return out.select("batch", F.col("slot").cast("long").alias("slot"), F.col("source").cast("long").alias("source"), "image_id")


MULTI_SOURCE_SQL = IMG + "," + _SRC + f""",
 rk AS (SELECT *, {_rank(11, 'image_id', 'source')} AS rank, count(*) OVER (PARTITION BY source) AS size FROM src),
 sl AS (SELECT unnest([{{'s': 0, 'q': 6, 'slot': 0, 'j': 0}}, {{'s': 0, 'q': 6, 'slot': 1, 'j': 1}}, {{'s': 0, 'q': 6, 'slot': 2, 'j': 2}},
   {{'s': 0, 'q': 6, 'slot': 3, 'j': 3}}, {{'s': 0, 'q': 6, 'slot': 4, 'j': 4}}, {{'s': 0, 'q': 6, 'slot': 5, 'j': 5}},
   {{'s': 1, 'q': 1, 'slot': 6, 'j': 0}}, {{'s': 2, 'q': 1, 'slot': 7, 'j': 0}}]) AS x)
 SELECT batch, CAST(x.slot AS BIGINT) AS slot, CAST(x.s AS BIGINT) AS source, image_id
 FROM (SELECT unnest(range(200)) AS batch) b CROSS JOIN sl JOIN rk ON rk.source = x.s AND rk.rank = (batch * x.q + x.j) % size + 1"""


def grouped_source_batches(spark, sf):
    """Batches hold either the first or the second third-based shape group."""
    wide = F.when(F.col("image_id") % 3 == 0, 0).otherwise(1)
    out = S.multi_source_batches(_sources(spark, sf), 8, (3, 1, 1), 200, 11, group=wide)
    return out.select("batch", F.col("slot").cast("long").alias("slot"), F.col("source").cast("long").alias("source"), "image_id")


GROUPED_SQL = IMG + "," + _SRC + f""",
 gr AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END AS grp FROM src),
 rk AS (SELECT *, {_rank(11, 'image_id', 'source, grp')} AS rank, count(*) OVER (PARTITION BY source, grp) AS size FROM gr),
 pick AS (SELECT batch, CASE WHEN {uniform_sql(12, 'batch')} < (SELECT count(*) FILTER (WHERE grp = 0) / CAST(count(*) AS DOUBLE) FROM gr) THEN 0 ELSE 1 END AS grp
   FROM (SELECT unnest(range(200)) AS batch) b),
 turns AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY batch) - 1 AS turn FROM pick),
 sl AS (SELECT slot, CASE WHEN slot < 6 THEN 0 ELSE slot - 5 END AS s, CASE WHEN slot < 6 THEN 6 ELSE 1 END AS q, CASE WHEN slot < 6 THEN slot ELSE 0 END AS j
   FROM (SELECT unnest(range(8)) AS slot) x)
 SELECT batch, slot, CAST(s AS BIGINT) AS source, image_id
 FROM turns t CROSS JOIN sl JOIN rk ON rk.source = sl.s AND rk.grp = t.grp AND rk.rank = (turn * q + j) % size + 1"""


def weighted_draws(spark, sf):
    out = S.weighted_draws(_sources(spark, sf), (1.0, 2.0, 1.0), 3000, 13)
    return out.select("position", F.col("source").cast("long").alias("source"), "image_id")


WEIGHTED_SQL = IMG + "," + _SRC + f""",
 rk AS (SELECT *, {_rank(13, 'image_id', 'source')} AS rank, count(*) OVER (PARTITION BY source) AS size FROM src),
 dr AS (SELECT p, CASE WHEN u < 0.25 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS source FROM (SELECT p, {uniform_sql(14, 'p')} AS u FROM (SELECT unnest(range(3000)) AS p)))
 SELECT p AS position, CAST(source AS BIGINT) AS source, image_id FROM dr JOIN rk USING (source) WHERE rank = {hash_key_sql(15, 'p')} % size + 1"""


def sized_sources(spark, sf):
    out = S.sized_sources(_sources(spark, sf), {0: 0.5, 1: 1000, 2: -1}, 17)
    return out.select(F.col("source").cast("long").alias("source"), "position", "image_id")


SIZED_SQL = IMG + "," + _SRC + f""",
 rk AS (SELECT *, {_rank(17, 'image_id', 'source')} AS rank, count(*) OVER (PARTITION BY source) AS size FROM src),
 w AS (SELECT *, CASE source WHEN 0 THEN size // 2 WHEN 1 THEN 1000 ELSE size END AS want FROM rk)
 SELECT CAST(source AS BIGINT) AS source, rank + c * size AS position, image_id
 FROM (SELECT *, unnest(range((want - rank) // size + 1)) AS c FROM w WHERE rank <= want) t"""


def aspect_batches(spark, sf):
    shaped = T.images(spark, sf).withColumn("width", F.when(F.col("image_id") % 3 == 0, 200).otherwise(300))
    out = S.aspect_batches(shaped, 16, 19)
    return out.select(F.col("bucket").cast("long").alias("bucket"), "batch", "slot", "image_id")


ASPECT_SQL = IMG + f""",
 sh AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END AS bucket FROM images),
 rk AS (SELECT *, {_rank(19, 'image_id', 'bucket')} AS rank, count(*) OVER (PARTITION BY bucket) // 16 * 16 AS whole FROM sh)
 SELECT CAST(bucket AS BIGINT) AS bucket, (rank - 1) // 16 AS batch, (rank - 1) % 16 AS slot, image_id FROM rk WHERE rank <= whole
 UNION ALL SELECT 2, i // 16, i % 16, image_id FROM (SELECT image_id, row_number() OVER (ORDER BY bucket, rank) - 1 AS i FROM rk WHERE rank > whole) t"""


def video_chunks(spark, sf):
    videos = T.images(spark, sf).select(F.floor(F.col("image_id") / 10).cast("long").alias("video_id")).distinct()
    return S.video_chunks(videos, 7)


VIDEO_CHUNKS_SQL = IMG + """, v AS (SELECT DISTINCT image_id // 10 AS video_id FROM images)
 SELECT video_id, ntile(7) OVER (ORDER BY video_id) - 1 AS worker FROM v"""


def triplets(spark, sf):
    rows = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("pid"))
    out = S.triplets(rows, 4, 2, 23)
    return out.select("anchor", F.col("slot").cast("long").alias("slot"), "pid", "item")


TRIPLETS_SQL = f"""WITH e AS (SELECT vec_id AS item, CAST(label AS BIGINT) AS pid FROM embeddings),
 rk AS (SELECT *, {_rank(23, 'item', 'pid')} AS rank, count(*) OVER (PARTITION BY pid) AS size FROM e),
 pe AS (SELECT pid, size, row_number() OVER (ORDER BY {uniform_sql(24, 'pid')}, pid) AS person, count(*) OVER () AS total FROM (SELECT DISTINCT pid, size FROM rk)),
 dr AS (SELECT item AS anchor, person AS own, total, slot, slot // 2 AS grp FROM e JOIN pe USING (pid), (SELECT unnest(range(8)) AS slot)),
 ot AS (SELECT *, {hash_key_sql(25, 'anchor', 'grp')} % (total - 1) + 1 AS o FROM dr),
 pk AS (SELECT anchor, slot, CASE WHEN grp = 0 THEN own WHEN o >= own THEN o + 1 ELSE o END AS person FROM ot),
 q AS (SELECT anchor, slot, pe.pid, {hash_key_sql(26, 'anchor', 'slot')} % pe.size + 1 AS rank FROM pk JOIN pe USING (person))
 SELECT anchor, slot, pid, item FROM q JOIN rk USING (pid, rank)"""


def _frames(spark, sf):
    return T.images(spark, sf).select(F.floor(F.col("image_id") / 10).cast("long").alias("video_id"), (F.col("image_id") % 10).alias("frame_id"))


def reference_frames(spark, sf):
    return S.reference_frames(_frames(spark, sf), 3, 2, 29).select("video_id", "key_frame", "ref_frame", F.col("nth").cast("long").alias("nth"))


REFERENCE_SQL = IMG + f""",
 fr AS (SELECT image_id // 10 AS video_id, image_id % 10 AS frame_id FROM images),
 c AS (SELECT a.video_id, a.frame_id AS key_frame, b.frame_id AS ref_frame FROM fr a JOIN fr b ON a.video_id = b.video_id AND a.frame_id <> b.frame_id AND abs(a.frame_id - b.frame_id) <= 3)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, key_frame ORDER BY {hash_key_sql(29, 'video_id', 'key_frame', 'ref_frame')}, ref_frame) AS nth FROM c) t WHERE nth <= 2"""


def label_prompts(spark, sf):
    """On even images classes 1 and 3 are taken for the one below, which leaves classes that are absent."""
    c = F.col("category_id")
    some = _by_class(spark, sf).withColumn("category_id", F.when(F.col("image_id") % 2 == 0, c - c % 2).otherwise(c)).distinct()
    out = S.label_prompts(some, T.categories(spark, sf).withColumn("name", F.expr("trim(repeat(concat(name, ' '), cast(category_id + 1 as int)))")), 2, 14, 31)
    return out.select("image_id", "category_id", "positive", F.col("label").cast("long").alias("label"))


# the region with key 4 has a name of two words; a draw moves up past each place in use
PROMPTS_SQL = with_tables("gt", "categories") + f""",
 bc AS (SELECT DISTINCT CASE WHEN image_id % 2 = 0 THEN category_id - category_id % 2 ELSE category_id END AS category_id, image_id FROM gt),
 w AS (SELECT category_id, (len(string_split(name, ' '))) * (category_id + 1) + 1 AS cost, row_number() OVER (ORDER BY category_id) - 1 AS place FROM categories),
 po AS (SELECT image_id, category_id, cost, true AS positive, row_number() OVER (PARTITION BY image_id ORDER BY {hash_key_sql(31, 'image_id', 'category_id')}, category_id) AS r
   FROM bc JOIN w USING (category_id)),
 us AS (SELECT image_id, list_sort(list(place)) AS used, (SELECT count(*) FROM w) - count(*) AS rest FROM bc JOIN w USING (category_id) GROUP BY image_id),
 d1 AS (SELECT *, list_reduce(list_prepend({hash_key_sql(32, 'image_id', '1')} % rest, used), lambda x, u: CASE WHEN u <= x THEN x + 1 ELSE x END) AS a FROM us WHERE rest >= 1),
 d2 AS (SELECT *, list_reduce(list_prepend({hash_key_sql(32, 'image_id', '2')} % (rest - 1), list_sort(list_append(used, a))), lambda x, u: CASE WHEN u <= x THEN x + 1 ELSE x END) AS b
   FROM d1 WHERE rest >= 2),
 al AS (SELECT * FROM po UNION ALL SELECT image_id, category_id, cost, false, 0 FROM d1 JOIN w ON w.place = a UNION ALL SELECT image_id, category_id, cost, false, 1 FROM d2 JOIN w ON w.place = b),
 k AS (SELECT *, sum(cost) OVER (PARTITION BY image_id ORDER BY positive DESC, r ROWS UNBOUNDED PRECEDING) AS t FROM al)
 SELECT image_id, category_id, positive, row_number() OVER (PARTITION BY image_id ORDER BY positive DESC, r) - 1 AS label FROM k WHERE t <= 14"""


def quota_rows(spark, sf):
    rows = T.det(spark, sf).select("image_id", F.col("det_id").alias("row_id"), (F.col("score") > 0.8).alias("positive"))
    return S.quota_rows(rows, 16, 0.25, 37)


QUOTA_SQL = with_tables("det") + f""",
 rk AS (SELECT image_id, row_id, positive, row_number() OVER (PARTITION BY image_id, positive ORDER BY {hash_key_sql(37, 'row_id')}, row_id) AS r
   FROM (SELECT image_id, det_id AS row_id, score > 0.8 AS positive FROM det) s),
 p AS (SELECT * FROM rk WHERE positive AND r <= 4)
 SELECT image_id, row_id, positive FROM p UNION ALL SELECT image_id, row_id, positive FROM rk
 WHERE NOT positive AND r <= 16 - (SELECT count(*) FROM p WHERE p.image_id = rk.image_id)"""


def balanced_by_overlap(spark, sf):
    """Scores stand in for overlaps."""
    rows = T.det(spark, sf).select("image_id", F.col("det_id").alias("row_id"), F.col("score").alias("iou"))
    return S.balanced_by_overlap(rows, 9, 0.0, 0.75, 3, 41).select("image_id", "row_id", "bin")


BALANCED_SQL = with_tables("det") + f""",
 s AS (SELECT image_id, det_id AS row_id, CAST(floor(score / 0.25) AS BIGINT) AS bin FROM det WHERE score < 0.75),
 h AS (SELECT *, {hash_key_sql(41, 'row_id')} AS h FROM s),
 rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, bin ORDER BY h, row_id) <= 3 AS f FROM h)
 SELECT image_id, row_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f DESC, h, row_id) AS nn FROM rk) t WHERE nn <= 9"""


def balanced_by_instance(spark, sf):
    """A detection's class stands in for the instance it is assigned to."""
    rows = T.det(spark, sf).select("image_id", F.col("det_id").alias("row_id"), F.col("category_id").alias("instance_id"))
    return S.balanced_by_instance(rows, 12, 47)


INSTANCE_SQL = with_tables("det") + f""",
 s AS (SELECT image_id, det_id AS row_id, category_id AS instance_id, {hash_key_sql(47, 'det_id')} AS h FROM det),
 sh AS (SELECT image_id, round_even(CAST(12 AS DOUBLE) / count(DISTINCT instance_id), 0) + 1 AS each, count(*) AS total FROM s GROUP BY image_id),
 rk AS (SELECT s.*, total <= 12 OR row_number() OVER (PARTITION BY image_id, instance_id ORDER BY h, row_id) <= each AS f FROM s JOIN sh USING (image_id))
 SELECT image_id, row_id, instance_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f DESC, h, row_id) AS nn FROM rk) t WHERE nn <= 12"""


def draw_partners(spark, sf):
    return S.draw_partners(T.images(spark, sf), 3, 43).select("image_id", F.col("slot").cast("long").alias("slot"), "partner_id")


PARTNERS_SQL = IMG + f""",
 rk AS (SELECT image_id AS partner_id, {_rank(43, 'image_id')} AS rank FROM images),
 dr AS (SELECT image_id, slot FROM images, (SELECT unnest([1, 2, 3]) AS slot))
 SELECT image_id, CAST(slot AS BIGINT) AS slot, partner_id FROM dr JOIN rk ON rank = {hash_key_sql(44, 'dr.image_id', 'dr.slot')} % (SELECT count(*) FROM images) + 1"""


QUERIES = {f.__name__: f for f in (
    labeled_split, labeled_split_replace, mini_dataset, class_aware_sample, repeat_factors, multi_source_batches,
    grouped_source_batches, weighted_draws, sized_sources, aspect_batches, video_chunks, triplets, reference_frames,
    label_prompts, quota_rows, balanced_by_overlap, balanced_by_instance, draw_partners)}
ORACLES = {
    "balanced_by_instance": INSTANCE_SQL,
    "labeled_split": IMG + f" SELECT image_id, {_rank(7, 'image_id')} <= (SELECT count(*) // 10 FROM images) AS labeled FROM images",
    "labeled_split_replace": IMG + f""", rk AS (SELECT image_id, {_rank(7, 'image_id')} AS rank, count(*) OVER () AS total FROM images),
 dr AS (SELECT DISTINCT {hash_key_sql(8, 'i')} % total + 1 AS rank FROM (SELECT total, unnest(range(total // 10)) AS i FROM (SELECT count(*) AS total FROM images)))
 SELECT image_id, rank IN (SELECT rank FROM dr) AS labeled FROM rk""",
    "mini_dataset": with_tables("images", "gt") + f""", c AS (SELECT image_id FROM (SELECT image_id, {_rank(3, 'image_id')} AS rank FROM images) t WHERE rank <= 100)
 SELECT image_id, count(*) AS boxes FROM gt WHERE image_id IN (SELECT image_id FROM c) GROUP BY image_id""",
    "class_aware_sample": CLASS_AWARE_SQL,
    "repeat_factors": REPEAT_SQL,
    "multi_source_batches": MULTI_SOURCE_SQL,
    "grouped_source_batches": GROUPED_SQL,
    "weighted_draws": WEIGHTED_SQL,
    "sized_sources": SIZED_SQL,
    "aspect_batches": ASPECT_SQL,
    "video_chunks": VIDEO_CHUNKS_SQL,
    "triplets": TRIPLETS_SQL,
    "reference_frames": REFERENCE_SQL,
    "label_prompts": PROMPTS_SQL,
    "quota_rows": QUOTA_SQL,
    "balanced_by_overlap": BALANCED_SQL,
    "draw_partners": PARTNERS_SQL,
}
