"""Average precision from flagged detections, exact for classes of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.operators.matching import counted_boxes, match_default, match_group_of, threshold_masks
from detframe.plans.grouped import scan_states
from detframe.plans.ordered import TARGET_ROWS, crowded, running_sums, suffix_max, with_cells, without_cells
from detframe.session import land

EPS = 2.220446049250313e-16  # double machine epsilon: keeps a precision defined when nothing was counted


def precision_curve(flags: DataFrame, npos: DataFrame, by: Sequence[str], target: int = TARGET_ROWS, stored: bool = False) -> DataFrame:
    """``flags(by.., score, row_id, tp, fp)`` → cumulative ``ctp, cfp``, ``recall``, ``precision``, ``envelope``.

    ``npos(by.., num_gts)`` is small: one row per key. The narrow flag table is written once, because the
    cells, their totals and the rows all read it, unless the flags are ``stored`` and cheap to read.
    """
    by = list(by)
    slim = flags.select(*by, "score", "row_id", F.col("tp").cast("long"), F.col("fp").cast("long"))
    slim = slim if stored else land(slim)
    counted = npos.where("num_gts > 0")

    def rated(df: DataFrame) -> DataFrame:
        return (df.join(counted, by).withColumn("recall", F.col("ctp") / F.col("num_gts"))
                .withColumn("precision", F.col("ctp") / F.greatest(F.col("ctp") + F.col("cfp"), F.lit(EPS))))

    if not crowded(slim, by, target):
        down = Window.partitionBy(*by).orderBy(F.col("score").desc(), "row_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        up = Window.partitionBy(*by).orderBy("score", F.col("row_id").desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        cum = slim.withColumn("ctp", F.sum("tp").over(down)).withColumn("cfp", F.sum("fp").over(down))
        return rated(cum).withColumn("envelope", F.max("precision").over(up))
    celled = with_cells(slim, by, "score", "row_id", target=target)
    cum = running_sums(celled, by, "score", "row_id", {"ctp": "tp", "cfp": "fp"}, keep_cells=True)
    return suffix_max(rated(cum), by, "score", "row_id", "precision", "envelope", target=target)


def average_precision(flags: DataFrame, npos: DataFrame, by: Sequence[str], mode: str = "area",
                      target: int = TARGET_ROWS, stored: bool = False) -> DataFrame:
    """``(by.., num_gts, num_dets, ap)``; a key with boxes and no detections has AP 0.

    ``area`` sums recall steps times the precision envelope: recall grows by 1/num_gts at each true
    positive, so only those rows contribute. ``11points`` averages the best precision at recalls 0, .1 … 1.
    """
    by = list(by)
    curve = precision_curve(flags, npos, by, target, stored)
    counted = curve.groupBy(*by).agg(F.count(F.lit(1)).alias("num_dets"), *_ap_parts(mode))
    value = F.coalesce(_ap_value(mode), F.lit(0.0))
    return (npos.where("num_gts > 0").join(counted, by, "left")
            .select(*by, "num_gts", F.coalesce("num_dets", F.lit(0)).alias("num_dets"), value.alias("ap")))


def masked_precision(masks: DataFrame, npos: DataFrame, iou_thrs: Sequence[float], by: Sequence[str], target: int = TARGET_ROWS) -> DataFrame:
    """``(iou_thr, by.., num_gts, num_dets, ap)`` as :func:`average_precision`, of ``masks(by.., score, det_id, tp, fp)`` with one bit per threshold.

    Rows stream through in score order, once for all thresholds. The envelope falls in steps: of a batch only these leave, as their
    height and their number of true positives, and get the height of later batches where that is larger. A key above ``target``
    rows is cut into score cells, which start from the counts of the cells before.
    """
    by, thrs = list(by), [float(t) for t in iou_thrs]
    kinds, shifts, zero = dict(masks.dtypes), np.arange(len(thrs), dtype=np.int64), F.lit(0).cast("long")
    slim = land(masks.select(*by, F.col("score").cast("double").alias("score"), "det_id", "tp", "fp"))
    cells = crowded(slim, by, target)
    rows = (with_cells(slim, by, "score", "det_id", target=target) if cells else without_cells(slim)).withColumn("_head", F.lit(False))
    if cells:
        bit = lambda c, i: F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1).cast("long"))
        names = [(c, i) for c in ("tp", "fp") for i in range(len(thrs))]
        totals = rows.groupBy(*by, "_cell", "_sub").agg(*[F.sum(bit(c, i)).alias(f"{c}{i}") for c, i in names])
        before = Window.partitionBy(*by).orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select(*by, "_cell", "_sub", *[F.coalesce(F.sum(f"{c}{i}").over(before), zero).alias(f"{c}{i}") for c, i in names])
        heads = F.inline(F.array(*[F.struct(F.lit(i).cast(kinds["det_id"]).alias("det_id"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i in range(len(thrs))]))
        rows = rows.unionByName(sums.select(*by, "_cell", "_sub", heads, F.lit(0.0).alias("score"), F.lit(True).alias("_head")))

    def step(state, rows):
        head = rows["_head"].astype(bool)
        if head.any():
            for c in ("tp", "fp"):
                state[c][rows["det_id"][head].astype(np.int64)] = rows[c][head]
        body = ~head
        hit, miss = ((rows[c][body][:, None] >> shifts) & 1 for c in ("tp", "fp"))
        tp, fp = state["tp"] + np.cumsum(hit, axis=0), state["fp"] + np.cumsum(miss, axis=0)
        if len(tp):
            state["tp"], state["fp"] = tp[-1], fp[-1]
        made = []
        for n in range(len(thrs)):
            at = np.flatnonzero(hit[:, n])  # precision peaks at true positives
            if len(at):
                height = np.maximum.accumulate((tp[at, n] / np.maximum(tp[at, n] + fp[at, n], EPS))[::-1])[::-1]
                ends = np.flatnonzero(np.r_[height[1:] != height[:-1], True])
                made.append((np.full(len(ends), n, np.int32), tp[at[ends], n], np.diff(ends, prepend=-1), height[ends]))
        return dict(zip(("combo", "place", "n", "height"), (np.concatenate(x) for x in zip(*made)))) if made else None

    found = scan_states(rows, [*by, "_cell", "_sub"], [], [F.col("_head").desc(), F.col("score").desc(), "det_id"],
                        lambda: {c: np.zeros(len(thrs), np.int64) for c in ("tp", "fp")}, step,
                        ", ".join(f"{c} {kinds[c]}" for c in by) + ", combo int, place long, n long, height double")
    keys = [*by, "combo"]
    if cells:
        counted = npos.groupBy(*by).agg(F.max("num_gts").alias("_all"))
        spread = land(found).join(F.broadcast(counted), by).withColumn("_x", F.col("place") / F.greatest("_all", F.lit(1)))
        best = suffix_max(spread, keys, "_x", "place", "height", "best", descending=False, target=target)
    else:
        best = found.withColumn("best", F.max("height").over(Window.partitionBy(*keys).orderBy(F.col("place").desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    area = best.groupBy(*keys).agg(F.sum(F.col("best") * F.col("n")).alias("_area"))
    wanted = npos.where("num_gts > 0").select(*by, "num_gts", F.posexplode(F.array(*[F.lit(t) for t in thrs])).alias("combo", "iou_thr"))
    seen = slim.groupBy(*by).agg(F.count(F.lit(1)).alias("num_dets"))
    return wanted.join(area, keys, "left").join(seen, by, "left").select(
        "iou_thr", *by, "num_gts", F.coalesce("num_dets", zero).alias("num_dets"), (F.coalesce("_area", F.lit(0.0)) / F.col("num_gts")).alias("ap"))


def _ap_parts(mode: str):
    if mode == "area":
        return [F.sum(F.when(F.col("tp") == 1, F.col("envelope") / F.col("num_gts"))).alias("_ap")]
    if mode == "11points":
        return [F.max(F.when(F.col("recall") >= i / 10, F.col("precision"))).alias(f"_p{i}") for i in range(11)]
    raise ValueError(f"unknown mode {mode}")


def _ap_value(mode: str):
    if mode == "area":
        return F.col("_ap")
    return sum((F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) for i in range(1, 11)),
               F.coalesce(F.col("_p0"), F.lit(0.0))) / 11


def count_boxes(gt: DataFrame, by: Sequence[str]) -> DataFrame:
    return gt.groupBy(*by).agg(F.sum((~F.col("ignore").cast("boolean")).cast("long")).alias("num_gts"))


def eval_map(det: DataFrame, gt: DataFrame, iou_thr: float = 0.5, by: Sequence[str] = ("category_id",),
             mode: str = "area", legacy: bool = False, area_range: tuple[float, float] | None = None) -> DataFrame:
    """AP per class with the default matching rule."""
    flags = match_default(det, gt, iou_thr, legacy, area_range).withColumnRenamed("det_id", "row_id")
    if area_range is not None:
        plus = 1.0 if legacy else 0.0
        size = (F.col("x2") - F.col("x1") + plus) * (F.col("y2") - F.col("y1") + plus)
        gt = gt.withColumn("ignore", F.col("ignore").cast("boolean")
                           | ~((size >= float(area_range[0])) & (size < float(area_range[1]))))
    return average_precision(flags, count_boxes(gt, by), by, mode)


def eval_maps(det: DataFrame, gt: DataFrame, iou_thrs: Sequence[float], by: Sequence[str] = ("category_id",)) -> DataFrame:
    """:func:`eval_map` at several thresholds, with ``iou_thr``, from one match and one sorted pass."""
    return masked_precision(threshold_masks(det, gt, iou_thrs), count_boxes(gt, by), iou_thrs, by)


def eval_group_of_map(det: DataFrame, gt: DataFrame, iou_thr: float = 0.5, ioa_thr: float = 0.5) -> DataFrame:
    """AP per class where group boxes count as one object each."""
    boxes = counted_boxes(gt)
    npos = boxes.groupBy("category_id").agg(F.sum("num_gts").alias("num_gts"))
    return average_precision(match_group_of(det, gt, iou_thr, ioa_thr, boxes), npos, ["category_id"], stored=True)


def mean_ap(per_class: DataFrame, by: Sequence[str] = (), value: str = "ap") -> DataFrame:
    """Mean over the classes present."""
    return per_class.groupBy(*by).agg(F.avg(value).alias("map"), F.count(F.lit(1)).alias("classes"))


def average_recall(flags: DataFrame, npos: DataFrame, by: Sequence[str]) -> DataFrame:
    hits = flags.groupBy(*by).agg(F.sum("tp").alias("tp"))
    return npos.join(hits, list(by), "left").select(
        *by, (F.coalesce("tp", F.lit(0)) / F.col("num_gts")).alias("recall"))


def per_image_map(det: DataFrame, gt: DataFrame, iou_thrs: Sequence[float]) -> DataFrame:
    """Mean AP of each image over its classes and the thresholds; ranks images from best to worst.

    Images are small keys, so plain windows per (image, class, threshold) suffice. Thresholds are applied
    to one overlap join by exploding the tied boxes.
    """
    from detframe.operators.matching import best_box

    thr = F.explode(F.array(*[F.lit(float(t)) for t in iou_thrs])).alias("iou_thr")
    tied = best_box(det, gt).select("*", thr)
    hit = F.col("ann_id").isNotNull() & (F.col("iou") >= F.col("iou_thr"))
    real = hit & ~F.col("gt_ignore")
    claim = Window.partitionBy("iou_thr", "image_id", "category_id", F.when(real, F.col("ann_id")).otherwise(-F.col("det_id"))
                               ).orderBy(F.col("score").desc(), "det_id")
    flagged = (tied.withColumn("_first", F.row_number().over(claim))
               .withColumn("tp", F.when(real & (F.col("_first") == 1), 1).otherwise(0))
               .withColumn("fp", F.when(hit & (F.col("gt_ignore") | (F.col("_first") == 1)), 0).otherwise(1)))
    key = ["image_id", "category_id", "iou_thr"]
    whole = (Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy(*key).orderBy(F.col("score").desc(), "det_id").rowsBetween(*whole)
    rest = Window.partitionBy(*key).orderBy("score", F.col("det_id").desc()).rowsBetween(*whole)
    npos = count_boxes(gt, ["image_id", "category_id"]).where("num_gts > 0")
    curve = (flagged.withColumn("ctp", F.sum("tp").over(run)).withColumn("cfp", F.sum("fp").over(run))
             .withColumn("precision", F.col("ctp") / F.greatest(F.col("ctp") + F.col("cfp"), F.lit(EPS)))
             .withColumn("envelope", F.max("precision").over(rest)))
    ap = curve.groupBy(*key).agg(F.sum(F.col("tp") * F.col("envelope")).alias("_sum"))
    cells = npos.select("*", thr).join(ap, key, "left")
    return cells.groupBy("image_id").agg(
        F.avg(F.coalesce("_sum", F.lit(0.0)) / F.col("num_gts")).alias("map"))
