"""One-to-one matching rules that consume boxes in order.

Input is a candidate list ``pairs(keys.., det_id, score, ann_id, value)`` from an overlap join, never a
full matrix. Ordinary groups run as one pass of numpy over sorted partitions. Groups above the limit run
as rounds of aggregations over the candidate list, which give the same result without collecting a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions.arrays import assign_sparse
from detframe.operators.assignment import PAIR_LIMIT, least_cost_pairs
from detframe.operators.overlap import overlap_pairs
from detframe.plans.grouped import GROUP_LIMIT, scan_groups, split_by_size
from detframe.plans.images import joint_codes, overlaps, scan_images, sizes_of, split_images, touching
from detframe.plans.ordered import first_rows
from detframe.session import cut_lineage


def match_by_score(pairs: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """In score order each detection takes its best box still free: ``(keys.., det_id, ann_id, value)``.

    Ties on value go to the lowest ``ann_id``.
    """
    slim = pairs.select(*keys, "det_id", "score", "ann_id", "value")
    small, large = split_by_size(slim, keys, limit)
    kinds = dict(slim.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", det_id long, ann_id long, value double"

    def walk(rows):
        taken: set[int] = set()
        det, ann, value = rows["det_id"], rows["ann_id"], rows["value"]
        chosen, done = [], None
        for i in range(len(det)):  # candidates of a detection come together, best first
            if det[i] == done or ann[i] in taken:
                continue
            taken.add(ann[i])
            done = det[i]
            chosen.append(i)
        return {"det_id": det[chosen], "ann_id": ann[chosen], "value": value[chosen]}

    out = scan_groups(small, keys, [F.col("score").desc(), "det_id", F.col("value").desc(), "ann_id"], walk,
                      schema)
    return out if large is None else out.unionByName(score_rounds(large, keys))


def score_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`match_by_score` as rounds of proposals.

    Each detection proposes to its best box that has not refused it; each box keeps its best-scored
    proposer and refuses the others for good. With one common preference over detections the stable
    outcome is unique and equals the sequential one.
    """
    both = [*keys, "det_id", "ann_id"]
    open_pairs = cut_lineage(pairs.select(*both, "score", "value"))
    while True:
        proposals = first_rows(open_pairs, [*keys, "det_id"], [-F.col("value"), F.col("ann_id")], ["ann_id", "value", "score"])
        held = first_rows(proposals, [*keys, "ann_id"], [-F.col("score"), F.col("det_id")], ["det_id"])
        refused = cut_lineage(proposals.join(held, both, "left_anti").select(*both))
        if refused.limit(1).count() == 0:
            return proposals.select(*both, "value")
        open_pairs = cut_lineage(open_pairs.join(refused, both, "left_anti"))


def match_by_value(pairs: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Repeatedly take the largest value and drop its row and column: ``(keys.., det_id, ann_id, value)``.

    Ties go to the lowest ``ann_id``, then the lowest ``det_id``.
    """
    slim = pairs.select(*keys, "det_id", "ann_id", "value")
    small, large = split_by_size(slim, keys, limit)
    kinds = dict(slim.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", det_id long, ann_id long, value double"

    def walk(rows):
        dets: set[int] = set()
        anns: set[int] = set()
        chosen = []
        for i, (d, a) in enumerate(zip(rows["det_id"], rows["ann_id"])):
            if d not in dets and a not in anns:
                dets.add(d)
                anns.add(a)
                chosen.append(i)
        return {c: rows[c][chosen] for c in ("det_id", "ann_id", "value")}

    out = scan_groups(small, keys, [F.col("value").desc(), "ann_id", "det_id"], walk, schema)
    return out if large is None else out.unionByName(value_rounds(large, keys))


def value_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`match_by_value` as rounds: a pair that is best for both of its sides is chosen at once."""
    left = cut_lineage(pairs)
    chosen: DataFrame | None = None
    while left.limit(1).count():
        order = [-F.col("value"), F.col("ann_id"), F.col("det_id")]
        by_det = first_rows(left, [*keys, "det_id"], order, ["ann_id", "value"])
        by_ann = first_rows(left, [*keys, "ann_id"], order, ["det_id"])
        both = cut_lineage(by_det.join(by_ann, [*keys, "det_id", "ann_id"]).select(*keys, "det_id", "ann_id", "value"))
        chosen = both if chosen is None else chosen.unionByName(both)
        left = cut_lineage(left.join(both.select(*keys, "det_id"), [*keys, "det_id"], "left_anti")
                           .join(both.select(*keys, "ann_id"), [*keys, "ann_id"], "left_anti"))
    return pairs.limit(0) if chosen is None else chosen


def match_size_threshold(det: DataFrame, gt: DataFrame, thr: float = 0.5) -> DataFrame:
    """Matching with a threshold per box, lower for small boxes: ``det`` plus ``tp``, ``fp``.

    The threshold is min(w*h / ((w+10)(h+10)), thr). Overlaps are taken with the box shifted by one pixel,
    as in the published evaluation. Ignored boxes are consumed too and make a detection count as neither;
    on equal overlap a real box goes first.
    """
    keys = ["image_id", "category_id"]
    shifted = gt.select("ann_id", *keys, F.col("ignore").cast("int").alias("ignore"),
                        (F.col("x1") - 1).alias("x1"), (F.col("y1") - 1).alias("y1"),
                        (F.col("x2") - 1).alias("x2"), (F.col("y2") - 1).alias("y2"))
    pairs = overlap_pairs(det.select("det_id", *keys, "score", "x1", "y1", "x2", "y2"), shifted, keys, "d_", "g_")
    w, h = F.col("g_x2") - F.col("g_x1"), F.col("g_y2") - F.col("g_y1")
    limit = F.least(w * h / ((w + 10.0) * (h + 10.0)), F.lit(float(thr)))
    fit = pairs.where(F.col("iou") >= limit).select(
        *keys, F.col("d_det_id").alias("det_id"), F.col("d_score").alias("score"),
        # real boxes get the smaller sort id
        (F.col("g_ignore") * F.lit(1 << 60) + F.col("g_ann_id")).alias("ann_id"), F.col("iou").alias("value"))
    got = match_by_score(fit, keys).select("det_id", (F.col("ann_id") >= F.lit(1 << 60)).alias("_ign"))
    out = det.join(got, "det_id", "left")
    return (out.withColumn("tp", F.coalesce((~F.col("_ign")).cast("int"), F.lit(0)))
            .withColumn("fp", F.col("_ign").isNull().cast("int")).drop("_ign"))


def match_caltech(det: DataFrame, gt: DataFrame, thr: float = 0.5) -> DataFrame:
    """Pedestrian rule: a free real box by IoU, else any ignored box by IoF makes the detection neutral.

    ``det`` plus ``tp``, ``fp``; both 0 for neutral ones. Needs both sides on an image.
    """
    cols = ["image_id", "x1", "y1", "x2", "y2"]
    d = det.select("det_id", "score", *cols)
    real = overlap_pairs(d, gt.where(~F.col("ignore").cast("boolean")).select("ann_id", *cols), ["image_id"], "d_", "g_")
    fit = real.where(F.col("iou") > float(thr)).select(
        "image_id", F.col("d_det_id").alias("det_id"), F.col("d_score").alias("score"),
        F.col("g_ann_id").alias("ann_id"), F.col("iou").alias("value"))
    got = match_by_score(fit, ["image_id"]).select("det_id", F.lit(1).alias("tp"))
    ignored = overlap_pairs(d, gt.where(F.col("ignore").cast("boolean")).select("ann_id", *cols), ["image_id"],
                            "d_", "g_", mode="iof")
    neutral = (ignored.where(F.col("iou") > float(thr)).select(F.col("d_det_id").alias("det_id")).distinct()
               .withColumn("_neutral", F.lit(1)))
    out = det.join(got, "det_id", "left").join(neutral, "det_id", "left")
    return (out.withColumn("tp", F.coalesce("tp", F.lit(0)))
            .withColumn("fp", F.when((F.col("tp") == 0) & F.col("_neutral").isNull(), 1).otherwise(0)).drop("_neutral"))


def proposal_recall(det: DataFrame, gt: DataFrame, proposal_nums: Sequence[int], iou_thrs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Recall per (``by``, number of proposals, IoU): boxes and proposals are paired off by descending overlap.

    ``by`` are columns of both tables that an image has one value of; a value with boxes and no hit has recall 0. Pairs below the
    least IoU come after all that count, so they are left out. Ordinary images are paired off in one piece, others from joins.
    """
    by = list(by)
    keys = [*by, "image_id"]
    reads = [*keys, "x1", "y1", "x2", "y2"]
    det_small, gt_small, det_large, gt_large = split_images(det.select("det_id", "score", *reads), gt.select("ann_id", *reads), keys, reads)
    hits = _image_hits(det_small, gt_small, keys, proposal_nums, iou_thrs)
    if det_large is not None:
        hits = hits.unionByName(_joined_hits(det_large, gt_large, keys, proposal_nums, iou_thrs))
    nums = F.explode(F.array(*[F.lit(int(n)) for n in proposal_nums])).alias("proposals")
    hits = hits.groupBy(*by, "proposals").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(len(iou_thrs))])
    total = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).where("total > 0").select("*", nums)
    stacked = total.join(hits, [*by, "proposals"], "left").select(*by, "proposals", "total", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("iou_thr"), F.coalesce(f"h{i}", F.lit(0)).alias("hits")) for i, t in enumerate(iou_thrs)])).alias("r"))
    return stacked.select(*by, "proposals", F.col("r.iou_thr").alias("iou_thr"), (F.col("r.hits") / F.col("total")).alias("recall"))


def _best_proposals(det: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "det_id")
    return (det.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            .select("det_id", *keys, "rank", "x1", "y1", "x2", "y2"))


def _image_hits(det: DataFrame, gt: DataFrame, keys: list[str], nums: Sequence[int], thrs: Sequence[float]) -> DataFrame:
    """Hits ``h<i>`` per threshold, number of proposals and value of ``by``, summed over some whole images at a time."""
    best, by, least = _best_proposals(det, keys, max(nums)), keys[:-1], float(min(thrs))
    kinds = dict(best.dtypes)

    def match(d, g, at, to):
        i, j, iou = overlaps(d, g, at, to, least=least)
        order = np.lexsort((d["det_id"][i], g["ann_id"][j], -iou))
        i, j, iou = i[order], j[order], iou[order]
        # detections that share a value of ``by``, and the first of them
        codes = joint_codes(*[(d[c], d[c]) for c in by])[0] if by else np.zeros(len(at), np.int64)
        _, first, name = np.unique(codes, return_index=True, return_inverse=True)
        made = []
        for n in nums:
            near = np.flatnonzero(d["rank"][i] <= n)
            dets, anns, chosen = bytearray(len(at)), bytearray(len(to)), []
            for k, a, b in zip(near.tolist(), i[near].tolist(), j[near].tolist()):
                if not dets[a] and not anns[b]:
                    dets[a] = anns[b] = 1
                    chosen.append(k)
            hits = [np.bincount(name[i[chosen]], iou[chosen] >= t, minlength=len(first)).astype(np.int64) for t in map(float, thrs)]
            made.append({c: d[c][first] for c in by} | {"proposals": np.full(len(first), n, np.int32)} | {f"h{k}": h for k, h in enumerate(hits)})
        return {c: np.concatenate([m[c] for m in made]) for c in made[0]}

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "proposals int", *[f"h{i} long" for i in range(len(thrs))]])
    return scan_images(best, gt, keys, ["rank"], match, schema)


def _joined_hits(det: DataFrame, gt: DataFrame, keys: list[str], nums: Sequence[int], thrs: Sequence[float]) -> DataFrame:
    """Hits per threshold and number of proposals of images of any size."""
    pairs = overlap_pairs(_best_proposals(det, keys, max(nums)), gt, keys, "d_", "g_", min_overlap=max(0.0, float(min(thrs))))
    each = pairs.select(*keys, F.col("d_det_id").alias("det_id"), F.col("d_rank").alias("rank"), F.col("g_ann_id").alias("ann_id"),
                        F.col("iou").alias("value"), F.explode(F.array(*[F.lit(int(n)) for n in nums])).alias("proposals"))
    got = match_by_value(each.where("rank <= proposals"), [*keys, "proposals"])
    return got.groupBy(*keys[:-1], "proposals").agg(*[F.sum((F.col("value") >= float(t)).cast("long")).alias(f"h{i}") for i, t in enumerate(thrs)])


def referring_scores(det: DataFrame, gt: DataFrame, score_thr: float = 0.7, iou_thr: float = 0.5,
                     f1_thr: float = 1.0) -> DataFrame:
    """Per image ``(tp, preds, boxes, no_target, f1, correct)`` for expressions with any number of targets.

    ``gt.no_target`` marks images whose expression refers to nothing: right exactly when nothing is predicted.
    """
    cols = ["image_id", "x1", "y1", "x2", "y2"]
    kept = det.where(F.col("score") >= float(score_thr))
    pairs = overlap_pairs(kept.select("det_id", *cols), gt.where(~F.col("no_target")).select("ann_id", *cols),
                          ["image_id"], "d_", "g_", min_overlap=iou_thr)
    got = match_by_value(pairs.select("image_id", F.col("d_det_id").alias("det_id"), F.col("g_ann_id").alias("ann_id"),
                                      F.col("iou").alias("value")), ["image_id"])
    images = gt.groupBy("image_id").agg(F.max("no_target").alias("no_target"), F.count(F.lit(1)).alias("boxes"))
    out = (images.join(kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("preds")), "image_id", "left")
           .join(got.groupBy("image_id").agg(F.count(F.lit(1)).alias("tp")), "image_id", "left").na.fill(0, ["preds", "tp"]))
    f1 = (F.when(F.col("no_target"), (F.col("preds") == 0).cast("double"))
          .otherwise(2.0 * F.col("tp") / (F.col("preds") + F.col("boxes"))))
    return out.withColumn("f1", f1).withColumn("correct", F.col("f1") >= float(f1_thr))


def referring_summary(per_image: DataFrame) -> DataFrame:
    target, found = ~F.col("no_target"), F.col("preds") > 0
    return per_image.agg(
        F.avg(F.col("correct").cast("double")).alias("f1_score"),
        F.avg(F.when(target, found.cast("double"))).alias("t_acc"),
        F.avg(F.when(~target, (~found).cast("double"))).alias("n_acc"))


def max_matching_index(det: DataFrame, gt: DataFrame, score_thrs: Sequence[float], iou_thr: float = 0.5, limit: int = PAIR_LIMIT) -> DataFrame:
    """Mean Jaccard index per score threshold: matched / (boxes + detections - matched), by maximum matching.

    Unmatched detections and unmatched boxes that lie in an ignored box (IoF above the threshold) are
    excused. Images where nothing is left to count are left out. Rows ``(score_thr, ji)``; the published
    figure is the largest. Of all maximum matchings one with the fewest excused ends is taken, which fixes the result.

    What counts of an image is its rows less the excusable ones, plus the excusable ends that were matched, so a matching is
    only known by its size and its excusable ends. Images with too few rows for more than ``limit`` pairs meet and are matched in numpy;
    the others come from joins, and of these the ones of up to ``limit`` pairs are matched at all thresholds in one piece.
    """
    cols = ["image_id", "x1", "y1", "x2", "y2"]
    thrs = [float(s) for s in score_thrs]
    # a score that is no number is above every threshold
    det = det.withColumn("score", F.when(F.isnan("score"), F.lit(float("inf"))).otherwise(F.col("score").cast("double")))
    # n rows make at most n * n / 4 pairs
    det_small, gt_small, det_large, gt_large = split_images(
        det.select("det_id", "score", *cols), gt.select("ann_id", F.col("ignore").cast("boolean").alias("ignore"), *cols), ["image_id"], [*cols, "ignore"], 2 * math.isqrt(limit))
    both = _image_matchings(det_small, gt_small, thrs, float(iou_thr))
    if det_large is not None:
        both = both.unionByName(_joined_matchings(det_large, gt_large, thrs, iou_thr, limit).select("score_thr", "k", F.col("mn").cast("double").alias("mn")))
    return both.groupBy("score_thr").agg(F.avg(F.col("k") / (F.col("mn") - F.col("k") + F.lit(1e-6))).alias("ji"))


def _image_matchings(det: DataFrame, gt: DataFrame, thrs: list[float], iou_thr: float) -> DataFrame:
    """``(score_thr, k, mn)`` per image and threshold: matched pairs, and rows that count; images where none counts are left out."""
    def inside(rows, at, ignored, to):
        """Rows that lie in an ignored box."""
        out, size = np.zeros(len(at), np.int64), sizes_of(rows)
        for i, _, inter in touching(rows, ignored, at, to):
            out[i[inter / np.maximum(size[i], 1e-6) > iou_thr]] = 1
        return out

    def match(d, g, at, to):
        free = ~g["ignore"].astype(bool)
        ignored, real = ({c: v[part] for c, v in g.items()} for part in (~free, free))
        here, hidden = to[free], to[~free]
        d_out, g_out = inside(d, at, ignored, hidden), inside(real, here, ignored, hidden)
        images = int(max(at.max(initial=-1), to.max(initial=-1))) + 1
        boxes = np.bincount(here, 1 - g_out, images)
        i, j, _ = overlaps(d, real, at, here, least=iou_thr)
        cost, made = (d_out[i] + g_out[j]).astype(float), []
        for thr in thrs:
            on = np.flatnonzero(d["score"][i] > thr)
            # a pair whose ends have no other pair is taken; images do not touch, so all others are matched together
            single = (np.bincount(i[on], minlength=len(at))[i[on]] == 1) & (np.bincount(j[on], minlength=len(here))[j[on]] == 1)
            rest = on[~single]
            if len(rest):
                gain = cost[rest].max() - cost[rest] + (cost[rest].max() - cost[rest].min()) * (len(np.unique(i[rest])) + 1) + 1
                rest = rest[assign_sparse(i[rest], j[rest], gain)]
            got = np.r_[on[single], rest]
            k = np.bincount(at[i[got]], minlength=images)
            mn = boxes + np.bincount(at, np.where(d["score"] > thr, 1 - d_out, 0), images) + np.bincount(at[i[got]], cost[got], images)
            some = mn != 0
            made.append((np.full(some.sum(), thr), k[some], mn[some]))
        return dict(zip(("score_thr", "k", "mn"), (np.concatenate(x) for x in zip(*made))))

    return scan_images(det, gt, ["image_id"], ["det_id"], match, "score_thr double, k long, mn double", alone=True)


def _joined_matchings(det: DataFrame, gt: DataFrame, thrs: list[float], iou_thr: float, limit: int) -> DataFrame:
    """:func:`_image_matchings` of images of any size."""
    cols = ["image_id", "x1", "y1", "x2", "y2"]
    ignored = gt.where(F.col("ignore").cast("boolean")).select("ann_id", *cols)

    def marked(rows: DataFrame, ident: str) -> DataFrame:
        inside = overlap_pairs(rows.select(F.col(ident).alias("_id"), *cols), ignored, ["image_id"], "d_", "g_", mode="iof")
        covered = inside.where(F.col("iou") > float(iou_thr)).select(F.col("d__id").alias(ident)).distinct().withColumn("ign", F.lit(1))
        return cut_lineage(rows.join(covered, ident, "left").na.fill(0, ["ign"]))

    d = marked(det.select("det_id", "score", *cols), "det_id")
    real = marked(gt.where(~F.col("ignore").cast("boolean")).select("ann_id", *cols), "ann_id")
    pairs = cut_lineage(overlap_pairs(d, real, ["image_id"], "d_", "g_", min_overlap=iou_thr).where(F.col("d_score") > min(thrs)).select(
        "image_id", F.col("d_det_id").cast("long").alias("a_id"), F.col("g_ann_id").cast("long").alias("b_id"), F.col("d_score").cast("double").alias("score"),
        (F.col("d_ign") + F.col("g_ign")).cast("double").alias("cost")))
    small, large = split_by_size(pairs, ["image_id"], limit)

    def solve(rows):
        sizes, costs = np.zeros(len(thrs), np.int64), np.zeros(len(thrs))
        for n, thr in enumerate(thrs):
            on = rows["score"] > thr
            if not on.any():
                continue
            a, cost = rows["a_id"][on], rows["cost"][on]
            # one more pair weighs more than any cost
            gain = cost.max() - cost + (cost.max() - cost.min()) * (len(np.unique(a)) + 1) + 1
            got = assign_sparse(a, rows["b_id"][on], gain)
            sizes[n], costs[n] = len(cost[got]), cost[got].sum()
        return {"score_thr": np.array(thrs), "k": sizes, "c": costs}

    kind = dict(pairs.dtypes)["image_id"]
    found = scan_groups(small, ["image_id"], ["a_id", "b_id"], solve, f"image_id {kind}, score_thr double, k long, c double")
    levels = F.explode(F.array(*[F.lit(t) for t in thrs])).alias("score_thr")
    if large is not None:
        each = least_cost_pairs(large.select("*", levels).where("score > score_thr"), ["image_id", "score_thr"])
        found = found.unionByName(each.groupBy("image_id", "score_thr").agg(F.count(F.lit(1)).alias("k"), F.sum("cost").alias("c")))
    counts = F.explode(F.array(*[F.struct(F.lit(t).alias("score_thr"), (F.col("m") + F.col(f"n{i}")).alias("mn")) for i, t in enumerate(thrs)])).alias("l")
    boxes = real.groupBy("image_id").agg(F.sum(1 - F.col("ign")).alias("m"))
    dets = d.groupBy("image_id").agg(*[F.sum(F.when(F.col("score") > t, 1 - F.col("ign")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(thrs)])
    both = (boxes.join(dets, "image_id", "full").na.fill(0, ["m", *[f"n{i}" for i in range(len(thrs))]]).select("image_id", counts).select("image_id", "l.*")
            .join(found, ["image_id", "score_thr"], "left").na.fill(0, ["k", "c"]).withColumn("mn", F.col("mn") + F.col("c")).where("mn <> 0"))
    return both
