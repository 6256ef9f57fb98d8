"""Masks as runs: overlaps, unions, differences, and segmentation metrics.

A run is ``(image_id, start, length)`` in column-major pixel order. Two run tables meet through fixed
blocks of pixels, so a large image is spread over its blocks and no image is collected anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.session import cut_lineage

BLOCK = 65536


def _blocked(runs: DataFrame, block: int) -> DataFrame:
    first = F.floor(F.col("start") / F.lit(block))
    last = F.floor((F.col("start") + F.col("length") - 1) / F.lit(block))
    return runs.where("length > 0").withColumn("_b", F.explode(F.sequence(first, last)))


def run_overlaps(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str],
                 keys: Sequence[str] = ("image_id",), block: int = BLOCK) -> DataFrame:
    """Common pixels ``n`` per combination of ``left`` columns of ``a`` and ``right`` columns of ``b``."""
    keys = list(keys)
    x = _blocked(a, block).select(*keys, "_b", *left, F.col("start").alias("_s1"), (F.col("start") + F.col("length")).alias("_e1"))
    y = _blocked(b, block).select(*keys, "_b", *right, F.col("start").alias("_s2"), (F.col("start") + F.col("length")).alias("_e2"))
    base = F.col("_b") * F.lit(block)
    common = F.least("_e1", "_e2", base + F.lit(block)) - F.greatest("_s1", "_s2", base)
    return (x.join(y, [*keys, "_b"]).where("_s1 < _e2 AND _s2 < _e1").withColumn("_n", common).where("_n > 0")
            .groupBy(*keys, *left, *right).agg(F.sum("_n").alias("n")))


def run_areas(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum("length").alias("area"))


def mask_iou(a: DataFrame, b: DataFrame, a_id: str, b_id: str, keys: Sequence[str] = ("image_id",),
             crowd: bool = False) -> DataFrame:
    """``(keys.., a_id, b_id, inter, iou)`` of every overlapping pair; ``crowd`` divides by the area of ``a``."""
    inter = run_overlaps(a, b, [a_id], [b_id], keys).withColumnRenamed("n", "inter")
    sized = (inter.join(run_areas(a, [*keys, a_id]).withColumnRenamed("area", "_a"), [*keys, a_id])
             .join(run_areas(b, [*keys, b_id]).withColumnRenamed("area", "_b"), [*keys, b_id]))
    union = F.col("_a") if crowd else F.col("_a") + F.col("_b") - F.col("inter")
    return sized.select(*keys, a_id, b_id, "inter", (F.col("inter") / union).alias("iou"))


def union_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge overlapping and touching runs of each key (gaps and islands)."""
    by = list(by)
    order = Window.partitionBy(*by).orderBy("start", "_e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = (runs.where("length > 0").withColumn("_e", F.col("start") + F.col("length"))
              .withColumn("_new", F.when(F.col("start") > F.max("_e").over(before), 1).otherwise(0)))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("_e").alias("_e")).select(
        *by, "start", (F.col("_e") - F.col("start")).alias("length"))


def subtract_runs(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels of ``a`` outside ``b``, as runs, by a sweep over the run edges of each key."""
    by = list(by)

    def edges(df: DataFrame, kind: str) -> DataFrame:
        up, down = F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(
            (F.col("start") + F.col("length")).alias("at"), F.lit(-1).alias("d"))
        e = df.where("length > 0").select(*by, F.explode(F.array(up, down)).alias("e"))
        zero = F.lit(0)
        return e.select(*by, "e.at", (F.col("e.d") if kind == "a" else zero).alias("da"),
                        (F.col("e.d") if kind == "b" else zero).alias("db"))

    points = edges(a, "a").unionByName(edges(b, "b")).groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*by).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.select(*by, F.col("at").alias("start"), F.sum("da").over(run).alias("ca"),
                          F.sum("db").over(run).alias("cb"), (F.lead("at").over(order) - F.col("at")).alias("length"))
    return union_runs(swept.where("ca > 0 AND cb = 0 AND length > 0").select(*by, "start", "length"), by)


def box_runs(boxes: DataFrame, height: str = "height") -> DataFrame:
    """One run per pixel column of an integer box: ``(.., start, length)`` with start = x * height + y."""
    col = F.explode(F.sequence(F.col("x1").cast("long"), F.col("x2").cast("long") - 1)).alias("_c")
    kept = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.where("x2 > x1 AND y2 > y1").select("*", col).select(
        *kept, (F.col("_c") * F.col(height) + F.col("y1").cast("long")).alias("start"),
        (F.col("y2") - F.col("y1")).cast("long").alias("length"))


def box_run_list(height: str = "height") -> Column:
    """:func:`box_runs` of a row's box as one ``array<struct<start, length>>`` in order; empty for a box without area."""
    first, last = F.col("x1").cast("long"), F.col("x2").cast("long") - 1
    run = lambda c: F.struct((c * F.col(height) + F.col("y1").cast("long")).alias("start"), (F.col("y2") - F.col("y1")).cast("long").alias("length"))
    empty = F.array().cast("array<struct<start: bigint, length: bigint>>")
    return F.when((last >= first) & (F.col("y2") > F.col("y1")), F.transform(F.sequence(first, last), run)).otherwise(empty)


def run_boxes(runs: DataFrame, by: Sequence[str], height: str = "height") -> DataFrame:
    """Box (last index + 1) and area of each mask from its runs."""
    h = F.col(height)
    end = F.col("start") + F.col("length") - 1
    c1, c2 = F.floor(F.col("start") / h), F.floor(end / h)
    # a run that crosses a column border touches the first and last row
    low = F.when(c1 == c2, F.col("start") % h).otherwise(F.lit(0))
    high = F.when(c1 == c2, end % h).otherwise(h - 1)
    return runs.groupBy(*by).agg(F.min(c1).alias("x1"), F.min(low).alias("y1"), (F.max(c2) + 1).alias("x2"),
                                 (F.max(high) + 1).alias("y2"), F.sum("length").alias("area"))


def semantic_counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pixels per class: ``(label, inter, pred_area, gt_area)``; pixels without truth are ignored.

    Inputs are runs ``(image_id, start, length, label)`` that do not overlap within an image.
    """
    both = run_overlaps(gt.withColumnRenamed("label", "g"), pred.withColumnRenamed("label", "p"), ["g"], ["p"])
    pairs = both.groupBy("g", "p").agg(F.sum("n").alias("n"))  # classes squared
    inter = pairs.where("g = p").select(F.col("g").alias("label"), F.col("n").alias("inter"))
    seen = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("pred_area"))
    truth = gt.groupBy("label").agg(F.sum("length").alias("gt_area"))
    return truth.join(seen, "label", "full").join(inter, "label", "left").na.fill(0, ["inter", "pred_area", "gt_area"])


def semantic_scores(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """IoU, accuracy, Dice, precision, recall and F per class in per cent; NULL where undefined."""
    def share(a, b):
        return F.when(b != 0, a / b * 100)
    i, p, g = F.col("inter"), F.col("pred_area"), F.col("gt_area")
    precision, recall = F.when(p != 0, i / p), F.when(g != 0, i / g)
    f = (1 + beta ** 2) * precision * recall / F.nullif(beta ** 2 * precision + recall, F.lit(0.0))
    return counts.select("label", share(i, p + g - i).alias("iou"), share(i, g).alias("acc"), share(2 * i, p + g).alias("dice"),
                         (precision * 100).alias("precision"), (recall * 100).alias("recall"), (f * 100).alias("fscore"))


def semantic_summary(counts: DataFrame) -> DataFrame:
    """Class means rounded to two places, with both readings of overall accuracy.

    ``mean_class_acc`` is what the evaluated library reports as its overall accuracy; ``pixel_acc`` is the
    share of correct pixels.
    """
    means = semantic_scores(counts).agg(
        F.round(F.avg("iou"), 2).alias("miou"), F.round(F.avg("acc"), 2).alias("mean_class_acc"),
        F.round(F.avg("dice"), 2).alias("mdice"), F.round(F.avg("fscore"), 2).alias("mfscore"))
    pixels = counts.agg(F.round(F.sum("inter") / F.sum("gt_area") * 100, 2).alias("pixel_acc"))
    return means.join(F.broadcast(pixels))  # one row each


def panoptic_stats(gt_runs: DataFrame, pred_runs: DataFrame, gt_segments: DataFrame, pred_segments: DataFrame) -> DataFrame:
    """Matched overlap and counts per (image, category): ``iou, tp, fp, fn``.

    Runs carry ``segment_id``; segments carry ``(image_id, segment_id, category_id)`` and, for the truth,
    ``iscrowd``. Above one half of the union (without unlabelled pixels) a match is unique.
    """
    # narrow, and read by the sizes of unlabelled parts and by the pairs
    inter = cut_lineage(run_overlaps(gt_runs.withColumnRenamed("segment_id", "g"), pred_runs.withColumnRenamed("segment_id", "p"), ["g"], ["p"]))
    ga = run_areas(gt_runs, ["image_id", "segment_id"]).select("image_id", F.col("segment_id").alias("g"), F.col("area").alias("g_area"))
    pa = run_areas(pred_runs, ["image_id", "segment_id"]).select("image_id", F.col("segment_id").alias("p"), F.col("area").alias("p_area"))
    gs = gt_segments.select("image_id", F.col("segment_id").alias("g"), F.col("category_id").alias("g_cat"), "iscrowd").join(ga, ["image_id", "g"])
    ps = pred_segments.select("image_id", F.col("segment_id").alias("p"), F.col("category_id").alias("p_cat")).join(pa, ["image_id", "p"])
    labelled = inter.groupBy("image_id", "p").agg(F.sum("n").alias("_l"))
    ps = ps.join(labelled, ["image_id", "p"], "left").withColumn("void", F.col("p_area") - F.coalesce("_l", F.lit(0))).drop("_l")
    ps = cut_lineage(ps)
    pairs = cut_lineage(inter.join(gs, ["image_id", "g"]).join(ps, ["image_id", "p"]).where("g_cat = p_cat"))
    iou = F.col("n") / (F.col("g_area") + F.col("p_area") - F.col("n") - F.col("void"))
    tp = pairs.where("iscrowd = 0").withColumn("iou", iou).where("iou > 0.5")
    crowd = pairs.where("iscrowd = 1").groupBy("image_id", "p").agg(F.sum("n").alias("_crowd"))
    fn = gs.where("iscrowd = 0").join(tp.select("image_id", "g"), ["image_id", "g"], "left_anti").select(
        "image_id", F.col("g_cat").alias("category_id"), F.lit(0.0).alias("iou"), F.lit("fn").alias("kind"))
    fp = (ps.join(tp.select("image_id", "p"), ["image_id", "p"], "left_anti").join(crowd, ["image_id", "p"], "left")
          .where((F.col("void") + F.coalesce("_crowd", F.lit(0))) / F.col("p_area") <= 0.5)
          .select("image_id", F.col("p_cat").alias("category_id"), F.lit(0.0).alias("iou"), F.lit("fp").alias("kind")))
    hits = tp.select("image_id", F.col("g_cat").alias("category_id"), "iou", F.lit("tp").alias("kind"))
    return hits.unionByName(fn).unionByName(fp).groupBy("image_id", "category_id").agg(
        F.sum("iou").alias("iou"), *[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")])


def panoptic_quality(stats: DataFrame, by: Sequence[str] = ("category_id",)) -> DataFrame:
    """PQ, SQ and RQ in per cent."""
    s = stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("iou", "tp", "fp", "fn")])
    half = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    some = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return s.where(some).select(*by, (F.col("iou") / half * 100).alias("pq"),
                                F.coalesce(F.col("iou") / F.nullif(F.col("tp"), F.lit(0)) * 100, F.lit(0.0)).alias("sq"),
                                (F.col("tp") / half * 100).alias("rq"))


def panoptic_summary(per_class: DataFrame, categories: DataFrame) -> DataFrame:
    """Class means for all, things and stuff: ``(part, pq, sq, rq, classes)``."""
    named = per_class.join(categories.select("category_id", F.when(F.col("is_thing"), "things").otherwise("stuff").alias("part")), "category_id")
    out = named.rollup("part").agg(F.avg("pq").alias("pq"), F.avg("sq").alias("sq"), F.avg("rq").alias("rq"), F.count(F.lit(1)).alias("classes"))
    return out.withColumn("part", F.coalesce("part", F.lit("all")))


def panoptic_problems(runs: DataFrame, segments: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows ``(image_id, segment_id, problem)``: in the map but not listed, listed but absent, unknown class."""
    key = ["image_id", "segment_id"]
    drawn = runs.select(*key).distinct()
    return (drawn.join(segments, key, "left_anti").select(*key, F.lit("not_listed").alias("problem"))
            .unionByName(segments.join(drawn, key, "left_anti").select(*key, F.lit("not_drawn").alias("problem")))
            .unionByName(segments.join(categories, "category_id", "left_anti").select(*key, F.lit("unknown_class").alias("problem"))))


def panoptic_to_semantic(runs: DataFrame, segments: DataFrame, unlabelled: int = 255) -> DataFrame:
    """Runs with the class of their segment; unknown segments become ``unlabelled``."""
    return (runs.join(segments.select("image_id", "segment_id", "category_id"), ["image_id", "segment_id"], "left")
            .withColumn("label", F.coalesce("category_id", F.lit(unlabelled).cast("long"))).drop("category_id"))


def referring_overlap(a: DataFrame, b: DataFrame, ident: str) -> DataFrame:
    """Cumulative and mean IoU over samples, in per cent; a sample without pixels counts as 0."""
    both = run_overlaps(a, b, [], [], [ident])
    per = (run_areas(a, [ident]).withColumnRenamed("area", "a").join(run_areas(b, [ident]).withColumnRenamed("area", "b"), ident, "full")
           .join(both, ident, "left").na.fill(0, ["a", "b", "n"]).withColumn("u", F.col("a") + F.col("b") - F.col("n")))
    return per.agg((F.sum("n") / F.sum("u") * 100).alias("ciou"),
                   (F.avg(F.coalesce(F.col("n") / F.nullif("u", F.lit(0)), F.lit(0.0))) * 100).alias("miou"))


def pixel_scores(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """IoU, precision, recall and F1 of prediction ``a`` against truth ``b``, unions per key; 0 when undefined."""
    by = list(by)
    a, b = union_runs(a, by), union_runs(b, by)
    per = (run_areas(a, by).withColumnRenamed("area", "a").join(run_areas(b, by).withColumnRenamed("area", "b"), by, "full")
           .join(run_overlaps(a, b, [], [], by), by, "left").na.fill(0, ["a", "b", "n"]))

    def share(x, y):
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))
    i, p, t = F.col("n"), F.col("a"), F.col("b")
    return per.select(*by, share(i, p + t - i).alias("iou"), share(i, p).alias("precision"), share(i, t).alias("recall"),
                      share(2 * i, p + t).alias("f1"))


def flip_runs(runs: DataFrame, direction: str, width: str = "width", height: str = "height") -> DataFrame:
    """Mirror masks; runs are first cut at column borders."""
    h, w = F.col(height), F.col(width)
    cut = columns_of(runs, height)
    x, y = F.floor(F.col("start") / h), F.col("start") % h
    if direction in ("horizontal", "diagonal"):
        x = w - 1 - x
    if direction in ("vertical", "diagonal"):
        y = h - y - F.col("length")
    return cut.withColumn("start", (x * h + y).cast("long"))


def columns_of(runs: DataFrame, height: str = "height") -> DataFrame:
    """Cut runs so that each lies in one pixel column."""
    h = F.col(height)
    end = F.col("start") + F.col("length")
    cols = F.explode(F.sequence(F.floor(F.col("start") / h), F.floor((end - 1) / h)))
    spread = runs.where("length > 0").withColumn("_c", cols)
    a, b = F.greatest(F.col("start"), F.col("_c") * h), F.least(end, (F.col("_c") + 1) * h)
    return spread.withColumn("_a", a).withColumn("length", b - F.col("_a")).withColumn("start", F.col("_a")).drop("_a", "_c")


def crop_runs(runs: DataFrame, x1: Column | int, y1: Column | int, x2: Column | int, y2: Column | int,
              height: str = "height") -> DataFrame:
    """Cut masks to a window and move them to its origin; ``height`` becomes the window's height."""
    x1, y1, x2, y2 = (v if isinstance(v, Column) else F.lit(int(v)) for v in (x1, y1, x2, y2))
    h = F.col(height)
    cut = columns_of(runs, height).withColumn("_x", F.floor(F.col("start") / h)).withColumn("_y", F.col("start") % h)
    top, bottom = F.greatest(F.col("_y"), y1), F.least(F.col("_y") + F.col("length"), y2)
    inside = cut.where((F.col("_x") >= x1) & (F.col("_x") < x2) & (bottom > top))
    moved = inside.withColumn("_t", top).withColumn("length", (bottom - top).cast("long"))
    return (moved.withColumn("start", ((F.col("_x") - x1) * (y2 - y1) + F.col("_t") - y1).cast("long"))
            .withColumn(height, (y2 - y1).cast("long")).drop("_x", "_y", "_t"))


def translate_runs(runs: DataFrame, dx, dy, width: str = "width", height: str = "height") -> DataFrame:
    """Move masks inside their image; what leaves it is lost."""
    h, w = F.col(height), F.col(width)
    cut = columns_of(runs, height)
    x, y = F.floor(F.col("start") / h) + dx, F.col("start") % h + dy
    top, bottom = F.greatest(y, F.lit(0)), F.least(y + F.col("length"), h)
    moved = cut.withColumn("_x", x).withColumn("_t", top).withColumn("_b", bottom)
    return (moved.where("_x >= 0 AND _b > _t").where(F.col("_x") < w)
            .withColumn("start", (F.col("_x") * h + F.col("_t")).cast("long"))
            .withColumn("length", (F.col("_b") - F.col("_t")).cast("long")).drop("_x", "_t", "_b"))


def expand_runs(runs: DataFrame, top: Column | int, left: Column | int, to_height: Column | int, height: str = "height") -> DataFrame:
    """Place masks on a larger canvas of ``to_height`` rows, ``top`` and ``left`` pixels from its origin; with zeros they are padded."""
    top, left, to = (v if isinstance(v, Column) else F.lit(int(v)) for v in (top, left, to_height))
    h = F.col(height)
    start = (F.floor(F.col("start") / h) + left) * to + F.col("start") % h + top
    return columns_of(runs, height).withColumn("start", start.cast("long")).withColumn(height, to.cast("long"))


def cat_masks(parts: Sequence[DataFrame], by: Sequence[str] = ("image_id",), index: str = "mask") -> DataFrame:
    """Masks of several tables behind each other: ``index`` (0.. per key) goes on where the table before ended.

    A table's masks reach to its largest index in the key; a mask without runs behind that leaves no trace.
    """
    by, out, reached = list(by), None, None
    for part in parts:
        rows = part if reached is None else (part.join(reached, by, "left").withColumn(index, F.col(index) + F.coalesce("_end", F.lit(0))).drop("_end"))
        ends = rows.groupBy(*by).agg((F.max(index) + 1).alias("_end"))
        reached = ends if reached is None else reached.unionByName(ends).groupBy(*by).agg(F.max("_end").alias("_end"))
        out = rows if out is None else out.unionByName(rows)
    return out


def reduce_zero_label(runs: DataFrame, ignored: int = 255) -> DataFrame:
    """Label 0 and the ignored label become the ignored one; the others move down by one."""
    label = F.col("label")
    return runs.withColumn("label", F.when((label == 0) | (label == ignored), ignored).otherwise(label - 1).cast("long"))


def outline_pixels(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels ``(r, c)`` of an instance with a 4-neighbour outside it, in angular order about the centre."""
    by = list(by)
    near = pixels.select(*by, "r", "c", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"))
                                                            for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("n"))
    near = near.select(*by, "r", "c", (F.col("r") + F.col("n.dr")).alias("nr"), (F.col("c") + F.col("n.dc")).alias("nc"))
    inside = pixels.select(*by, F.col("r").alias("nr"), F.col("c").alias("nc"))
    rim = near.join(inside, [*by, "nr", "nc"], "left_anti").select(*by, "r", "c").distinct()
    mid = pixels.groupBy(*by).agg(F.avg("r").alias("_mr"), F.avg("c").alias("_mc"))
    placed = rim.join(mid, by).withColumn("angle", F.atan2(F.col("r") - F.col("_mr"), F.col("c") - F.col("_mc")))
    return placed.drop("_mr", "_mc")


def label_map_instances(runs: DataFrame, by: Sequence[str], height: str = "height", crowd_below: int = 1000,
                        first_thing: int = 24) -> DataFrame:
    """Instances of a coded label map: ``label = id / 1000`` (ids below 1000 are crowds), box, area; stuff is dropped."""
    label = F.when(F.col("inst_id") < crowd_below, F.col("inst_id")).otherwise(F.floor(F.col("inst_id") / 1000))
    kept = runs.withColumn("label", label.cast("long")).where(F.col("label") >= first_thing)
    return run_boxes(kept, [*by, "inst_id", "label"], height).withColumn("iscrowd", (F.col("inst_id") < crowd_below).cast("int"))


def remap_labels(runs: DataFrame, table: DataFrame, default: int | None = None) -> DataFrame:
    """Replace ``label`` through ``table(old, new)``."""
    out = runs.join(table, runs.label == table.old, "left").drop("old", "label")
    fill = F.col("new") if default is None else F.coalesce("new", F.lit(default).cast("long"))
    return out.withColumn("label", fill).drop("new")


def run_intersections(a: DataFrame, b: DataFrame, left: Sequence[str], keys: Sequence[str] = ("image_id",), block: int = BLOCK) -> DataFrame:
    """Common pixels as runs ``(keys.., left.., start, length)``; runs of ``b`` must not overlap each other inside a key."""
    keys = list(keys)
    x = _blocked(a, block).select(*keys, "_b", *left, F.col("start").alias("_s1"), (F.col("start") + F.col("length")).alias("_e1"))
    y = _blocked(b, block).select(*keys, "_b", F.col("start").alias("_s2"), (F.col("start") + F.col("length")).alias("_e2"))
    base = F.col("_b") * F.lit(block)
    low, high = F.greatest("_s1", "_s2", base), F.least("_e1", "_e2", base + F.lit(block))
    return x.join(y, [*keys, "_b"]).where("_s1 < _e2 AND _s2 < _e1").where(low < high).select(*keys, *left, low.alias("start"), (high - low).alias("length"))
