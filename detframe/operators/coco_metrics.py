"""The COCO protocol: matching at several IoU thresholds and area ranges, 101-point AP, recall, summaries.

Every detection carries two 64-bit masks (matched, ignored), one bit per (area range, threshold), so the
cube is never exploded into a shuffle: one ordered pass per class accumulates all bits, and the 101-point
table is a map-side combined maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.operators.overlap import overlap_pairs
from detframe.plans.grouped import scan_blocks, scan_states
from detframe.plans.images import joint_codes, scan_images, sizes_of, split_images, touching
from detframe.plans.ordered import TARGET_ROWS, crowded, with_cells, without_cells
from detframe.session import land

# fixed values of the protocol
IOU_THRS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
RECALL_POINTS = 101
#: What the match reads of detections and boxes.
_READ = ["image_id", "category_id", "area", *B.COORDS]


def coco_match(det: DataFrame, gt: DataFrame, iou_thrs: Sequence[float] = IOU_THRS,
               areas: dict[str, tuple[float, float]] = AREAS, max_det: int = 100,
               use_category: bool = True, forgive: str | None = None, ordinary: bool = True) -> DataFrame:
    """``(det_id, image_id, category_id, score, det_rank, tp_mask, ignore_mask)``.

    In score order a detection takes its best free real box, else its best ignored one (crowd boxes are
    never used up and are compared by IoF). Candidates per detection are cut to the ``max_det`` best per
    kind of box, which loses nothing: at most ``max_det - 1`` detections choose before it. ``forgive``
    makes boxes of other classes act as crowd boxes: those with an equal value in that column, or all
    of them for ``"any"``. ``ordinary`` images meet in one piece; without it, or with ``forgive``, all go through joins.
    """
    keys = ["image_id", "category_id"] if use_category else ["image_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "det_id")
    det, gt = _measured(det), _measured(gt)
    small = None
    if forgive is None and ordinary:
        det_small, gt_small, det, gt = split_images(det, gt, ["image_id"], _READ)
        small = _image_masks(det_small, gt_small, [(iou_thrs, None)], areas, max_det, use_category)
        if det is None:
            return small
    top = (det.withColumn("det_rank", F.row_number().over(order).cast("int")).where(F.col("det_rank") <= max_det)
           .select("det_id", "image_id", "category_id", "score", "area", "det_rank", *B.COORDS))
    cols = [*keys, *B.COORDS]
    crowd = F.col("iscrowd").cast("int").alias("crowd")
    if forgive is None:
        pairs = overlap_pairs(top.select("det_id", "det_rank", *cols), gt.select("ann_id", "area", crowd, *cols),
                              keys, "d_", "g_")
    else:
        label = "image_id" if forgive == "any" else forgive
        if forgive != "any":
            top = top.join(det.select("det_id", forgive), "det_id")
        part = list(dict.fromkeys(["image_id", label]))
        pairs = overlap_pairs(top.select("det_id", "det_rank", "category_id", *part, *B.COORDS),
                              gt.select("ann_id", "area", "category_id", crowd, *part, *B.COORDS), part, "d_", "g_")
        other = F.col("d_category_id") != F.col("g_category_id")
        pairs = (pairs.withColumn("g_crowd", F.when(other, 1).otherwise(F.col("g_crowd")))
                 .withColumnRenamed("d_category_id", "category_id"))
    value = F.when(F.col("g_crowd") == 1, B.iou(B.box("d_"), B.box("g_"), "iof")).otherwise(F.col("iou"))
    listed = pairs.select(*keys, F.col("d_det_id").alias("det_id"), F.col("d_det_rank").alias("det_rank"), F.col("g_ann_id").alias("ann_id"),
                          value.alias("value"), F.col("g_crowd").alias("crowd"), F.col("g_area").alias("area"))
    out = match_masks(top, listed, keys, iou_thrs, areas, max_det)
    return out if small is None else small.unionByName(out)


def _measured(boxes: DataFrame) -> DataFrame:
    return boxes if "area" in boxes.columns else boxes.withColumn("area", B.area(B.box()))


def _kind(spans: Sequence[tuple[float, float]]):
    """Boxes with equal behaviour in every range: crowd (-1), or the set of ranges that hold their area."""
    member = F.lit(0)
    for i, (a, b) in enumerate(spans):
        member = member + F.when((F.col("area") >= float(a)) & (F.col("area") <= float(b)), 1 << i).otherwise(0)
    return F.when(F.col("crowd") == 1, F.lit(-1)).otherwise(member)


def _outside(spans: Sequence[tuple[float, float]], bits: int):
    """The bits of the ranges, ``bits`` for each, that do not hold the area of a detection."""
    outside = F.lit(0).cast("long")
    for i, (a, b) in enumerate(spans):
        block = ((1 << bits) - 1) << (i * bits)
        outside = outside + F.when((F.col("area") < float(a)) | (F.col("area") > float(b)), F.lit(block).cast("long")).otherwise(0)
    return outside


def _image_masks(det: DataFrame, gt: DataFrame, rules: Sequence[tuple[Sequence[float], str | None]], areas: dict[str, tuple[float, float]],
                 max_det: int, use_category: bool = True) -> DataFrame:
    """:func:`coco_match` of ordinary images by several rules (thresholds, ``forgive``) at once; a range has the thresholds of all rules
    as its bits. For ``forgive`` both sides have a number ``part``: below 0 it equals none, and at -2 the row has no part in the rule."""
    spans, bits = list(areas.values()), sum(len(t) for t, _ in rules)
    if len(spans) * bits > 63:
        raise ValueError("at most 63 combinations of area range and threshold fit one mask")
    keys = ["image_id", "category_id"] if use_category else ["image_id"]
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "det_id")
    kinds, parted = dict(det.dtypes), ["part"] if any(f for _, f in rules) else []
    top = (det.withColumn("det_rank", F.row_number().over(order).cast("int")).where(F.col("det_rank") <= max_det)
           .select("det_id", "image_id", "category_id", "score", F.coalesce(F.isnan("score"), F.lit(False)).alias("odd"), "det_rank", _outside(spans, bits).alias("outside"),
                   *parted, *B.COORDS))
    crowd = gt.withColumn("crowd", F.coalesce(F.col("iscrowd").cast("int"), F.lit(0)))
    boxes = crowd.select("ann_id", "image_id", "category_id", _kind(spans).alias("kind"), *parted, *B.COORDS)

    def match(d, g, at, to):
        tp, ig = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        own, same = joint_codes((at, to), (d["category_id"], g["category_id"]))
        a, b = sizes_of(d), sizes_of(g)
        group, offset = own if use_category else at, 0
        for thrs, forgive in rules:
            weight = (1 << (np.arange(len(spans))[:, None] * bits + offset + np.arange(len(thrs)))).astype(np.int64)
            offset += len(thrs)
            left, right = (own, same) if use_category else (at, to)
            if forgive:
                left, right = (at, to) if forgive == "any" else joint_codes((at, to), (d["part"], g["part"]))
                out = -2 if forgive == "any" else -1
                left, right = np.where(d["part"] <= out, -1, left), np.where(g["part"] <= out, -1, right)
                ig[d["part"] == -2] |= weight.sum()
            found = []
            for i, j, inter in touching(d, g, left, right):
                kind = np.where(own[i] != same[j], -1, g["kind"][j]) if forgive else g["kind"][j]
                value = inter / np.maximum(np.where(kind == -1, a[i], a[i] + b[j] - inter), 1e-6)
                keep = value >= min(min(thrs), 1 - 1e-10)
                found.append((i[keep], j[keep], value[keep], kind[keep]))
            if not sum(len(f[0]) for f in found):
                continue
            i, j, value, kind = (np.concatenate(x) for x in zip(*found))
            rows = np.lexsort((-g["ann_id"][j], -value, d["det_rank"][i], group[i]))
            chosen = {"det_id": i[rows], "ann_id": j[rows], "value": value[rows], "kind": kind[rows]}
            cuts = np.append(np.flatnonzero(np.r_[True, np.diff(group[chosen["det_id"]]) != 0]), len(rows))
            first, hits, ignored = choose(chosen, cuts, np.minimum(np.array(thrs), 1 - 1e-10), len(spans), weight)
            tp[chosen["det_id"][first]] |= hits
            ig[chosen["det_id"][first]] |= ignored
        return {c: d[c] for c in ("det_id", "image_id", "category_id", "score", "odd", "det_rank")} | {"tp_mask": tp, "ignore_mask": ig | (d["outside"] & ~tp)}

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("det_id", "image_id", "category_id", "score")) + ", odd boolean, det_rank int, tp_mask long, ignore_mask long"
    out = scan_images(top, boxes, ["image_id"], ["det_rank"], match, schema)
    # a score that is no number comes back as NULL
    return out.withColumn("score", F.when(F.col("odd"), F.lit(float("nan")).cast(kinds["score"])).otherwise(F.col("score"))).drop("odd")


def choose(rows: dict, cuts: np.ndarray, thr: np.ndarray, n_area: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, hits, hits on ignored boxes) of every detection of groups that lie between ``cuts``; ``weight`` names the bit of
    an (area range, threshold). Rows ``det_id, ann_id, value, kind`` stand by detection in score order, best box first."""
    # Groups do not touch each other, so the first detections of all groups choose together, then the second ones, ...
    size = len(rows["det_id"])
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    by_ann = np.lexsort((rows["ann_id"], group))
    fresh = np.r_[True, (rows["ann_id"][by_ann][1:] != rows["ann_id"][by_ann][:-1]) | (group[by_ann][1:] != group[by_ann][:-1])]
    ann = np.empty(size, np.int64)
    ann[by_ann] = np.cumsum(fresh) - 1
    crowd = rows["kind"] == -1
    real = np.stack([~crowd & ((rows["kind"] >> i) & 1 == 1) for i in range(n_area)])
    fits = rows["value"] >= thr[:, None]
    taken = np.zeros((n_area, len(thr), ann.max() + 1), dtype=bool)
    first = np.flatnonzero(np.r_[True, (rows["det_id"][1:] != rows["det_id"][:-1]) | (group[1:] != group[:-1])])
    ends = np.append(first[1:], size)
    owner = group[first]
    turn = np.arange(len(first)) - np.searchsorted(owner, owner)
    tps, igs = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    order = np.argsort(turn, kind="stable")
    for chosen in np.split(order, np.cumsum(np.bincount(turn))[:-1]):
        sizes = ends[chosen] - first[chosen]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(first[chosen] - starts, sizes)
        # candidates of one detection come best first, so the first valid one is the choice; real ones go before ignored ones
        free = fits[None, :, at] & (crowd[at] | ~taken[:, :, ann[at]])
        place = np.where(free, np.where(real[:, None, at], at, at + size), 2 * size)
        pick = np.minimum.reduceat(place, starts, axis=2)
        has_real, has_any = pick < size, pick < 2 * size
        hit_area, hit_thr, hit = np.nonzero(has_any)
        taken[hit_area, hit_thr, ann[pick[hit_area, hit_thr, hit] % size]] = True
        tps[chosen] = (has_real * weight[:, :, None]).sum(axis=(0, 1))
        igs[chosen] = ((has_any & ~has_real) * weight[:, :, None]).sum(axis=(0, 1))
    return first, tps, igs


def match_masks(top: DataFrame, pairs: DataFrame, keys: Sequence[str], iou_thrs: Sequence[float] = IOU_THRS,
                areas: dict[str, tuple[float, float]] = AREAS, max_det: int = 100) -> DataFrame:
    """``coco_match`` on given overlaps: ``top(det_id, image_id, category_id, score, area, det_rank)`` and
    ``pairs(keys.., det_id, det_rank, ann_id, value, crowd, area)`` with the area of the truth."""
    spans = list(areas.values())
    bits = len(spans) * len(iou_thrs)
    if bits > 63:
        raise ValueError("at most 63 combinations of area range and threshold fit one mask")
    low = min(min(iou_thrs), 1 - 1e-10)
    fit = pairs.where(F.col("value") >= low).withColumn("kind", _kind(spans))
    best = Window.partitionBy("det_id", "kind").orderBy(F.col("value").desc(), F.col("ann_id").desc())
    cand = (fit.withColumn("_c", F.row_number().over(best)).where(F.col("_c") <= max_det)
            .select(*keys, "det_id", "det_rank", "ann_id", "value", "kind"))
    thr = np.minimum(np.array(iou_thrs), 1 - 1e-10)
    n_thr, n_area = len(iou_thrs), len(spans)
    weight = 1 << np.arange(bits, dtype=np.int64).reshape(n_area, n_thr)

    def match(rows, cuts):
        first, tps, igs = choose(rows, cuts, thr, n_area, weight)
        return {"det_id": rows["det_id"][first], "tp_mask": tps, "ig_mask": igs}

    got = scan_blocks(cand, keys, ["det_rank", F.col("value").desc(), F.col("ann_id").desc()], match,
                      "det_id long, tp_mask long, ig_mask long")
    outside = _outside(spans, n_thr)
    tp, ig = F.coalesce("tp_mask", F.lit(0).cast("long")), F.coalesce("ig_mask", F.lit(0).cast("long"))
    out = top.join(got, "det_id", "left")
    return out.select("det_id", "image_id", "category_id", "score", "det_rank", tp.alias("tp_mask"),
                      ig.bitwiseOR(outside.bitwiseAND(F.bitwise_not(tp))).alias("ignore_mask"))


def _combos(iou_thrs: Sequence[float], areas: dict) -> list[tuple[int, str, float]]:
    return [(i * len(iou_thrs) + j, name, float(t)) for i, name in enumerate(areas) for j, t in enumerate(iou_thrs)]


def count_real(gt: DataFrame, areas: dict[str, tuple[float, float]] = AREAS, by: Sequence[str] = ("category_id",)) -> DataFrame:
    """Boxes that count per key and area range: ``(by.., area, npos)``."""
    size = F.col("area") if "area" in gt.columns else B.area(B.box())
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"))
                                for n, (a, b) in areas.items()]))
    ranges = gt.where(F.col("iscrowd").cast("int") == 0).select(*by, size.alias("_size"), named.alias("r"))
    return (ranges.where("_size >= r.low AND _size <= r.high").groupBy(*by, F.col("r.area").alias("area"))
            .agg(F.count(F.lit(1)).alias("npos")))


def _heads(slim: DataFrame, npos: DataFrame, by: Sequence[str], combos: Sequence[tuple[int, str, float]], cells: bool) -> DataFrame:
    """Rows to read before a (key, cell): per combination (``det_id``) the hits (``tp_mask``) and counted detections
    (``ignore_mask``) of all cells before it, and the boxes to find (``_npos``)."""
    by = list(by)
    lists = npos.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("area", "npos"))).alias("_boxes"))  # one entry per area range
    zero = F.lit(0).cast("long")
    if cells:
        # few pairs of masks differ inside a cell, so the bits are counted over those
        masks = slim.groupBy(*by, "_cell", "_sub", "tp_mask", "ignore_mask").agg(F.count(F.lit(1)).alias("_k"))
        bit = lambda mask, i: F.shiftrightunsigned(mask, i).bitwiseAND(F.lit(1).cast("long"))
        totals = masks.groupBy(*by, "_cell", "_sub").agg(*[F.sum(bit("tp_mask", i) * F.col("_k")).alias(f"t{i}") for i, _, _ in combos],
                                                         *[F.sum((1 - bit("ignore_mask", i)) * F.col("_k")).alias(f"n{i}") for i, _, _ in combos])
        before = Window.partitionBy(*by).orderBy("_cell", "_sub").rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select(*by, "_cell", "_sub", *[F.coalesce(F.sum(f"{c}{i}").over(before), zero).alias(f"{c}{i}") for c in "tn" for i, _, _ in combos])
    else:
        sums = lists.select(*by, F.lit(0).alias("_cell"), F.lit(0).alias("_sub"), *[zero.alias(f"{c}{i}") for c in "tn" for i, _, _ in combos])
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("det_id"), F.col(f"t{i}").alias("tp_mask"), F.col(f"n{i}").alias("ignore_mask"),
                                        F.coalesce(F.element_at("_boxes", F.lit(a)), zero).alias("_npos")) for i, a, _ in combos])).alias("h")
    return sums.join(lists, by).select(*by, "_cell", "_sub", rows).select(
        *by, "_cell", "_sub", "h.det_id", F.lit(0.0).alias("score"), "h.tp_mask", "h.ignore_mask", "h._npos")


def _best_points(slim: DataFrame, npos: DataFrame, by: Sequence[str], combos: Sequence[tuple[int, str, float]], target: int) -> DataFrame:
    """``by.., combo, point, p``: the best precision of each combination at each recall point (hits * 100 / boxes, rounded down).

    Rows stream through in score order, two counters per combination are kept, and only the best of a batch per point leaves
    it. A key above ``target`` rows is cut into score cells, which start from the counts of the cells before.
    """
    kinds, by = dict(slim.dtypes), list(by)
    shifts = np.arange(len(combos), dtype=np.int64)
    cells = crowded(slim, by, target)
    celled = with_cells(slim, by, "score", "det_id", target=target) if cells else without_cells(slim)
    rows = celled.withColumn("_npos", F.lit(-1).cast("long")).unionByName(_heads(celled, npos, by, combos, cells))

    def start():
        return {c: np.zeros(len(combos), np.int64) for c in ("tp", "n", "npos")}

    def step(state, rows):
        head = rows["_npos"] >= 0
        if head.any():
            at = rows["det_id"][head]
            for name, column in (("tp", "tp_mask"), ("n", "ignore_mask"), ("npos", "_npos")):
                state[name][at] = rows[column][head]
        body = ~head
        if not body.any():
            return None
        hit = (rows["tp_mask"][body][:, None] >> shifts) & 1
        tp = state["tp"] + np.cumsum(hit, axis=0)
        n = state["n"] + np.cumsum(1 - ((rows["ignore_mask"][body][:, None] >> shifts) & 1), axis=0)
        state["tp"], state["n"] = tp[-1], n[-1]
        # precision peaks at true positives, so a row only speaks for the combinations in which it is one
        at, combo = np.nonzero((hit == 1) & (n > 0) & (state["npos"] > 0))
        if not len(at):
            return None
        hits = tp[at, combo]
        point = np.floor(hits * 100 / state["npos"][combo]).astype(np.int64)
        best = np.zeros((len(combos), point.max() + 1))
        np.maximum.at(best, (combo, point), hits / n[at, combo])
        combo, point = np.nonzero(best)
        return {"combo": combo.astype(np.int32), "point": point.astype(np.int32), "p": best[combo, point]}

    found = scan_states(rows, [*by, "_cell", "_sub"], [], [F.col("_npos") < 0, F.col("score").desc(), "det_id"], start, step,
                        ", ".join(f"{c} {kinds[c]}" for c in by) + ", combo int, point int, p double")
    return found.groupBy(*by, "combo", "point").agg(F.max("p").alias("p"))


def precision_table(matches: DataFrame, npos: DataFrame, iou_thrs: Sequence[float] = IOU_THRS,
                    areas: dict = AREAS, by: Sequence[str] = ("category_id",), target: int = TARGET_ROWS,
                    stored: bool = False) -> DataFrame:
    """``(by.., area, iou_thr, ap, reach)``: mean over 101 recall points of the best precision at or beyond
    each, and the share of points with any precision.

    The best precision beyond recall r is the maximum over rows with recall >= r, so rows only need their
    recall point and precision; no per-row envelope is computed. Matches are written once unless they are ``stored``.
    """
    by = list(by)
    combos = _combos(iou_thrs, areas)
    slim = matches.select(*by, "det_id", "score", "tp_mask", "ignore_mask")
    slim = slim if stored else land(slim)
    places = F.create_map(*[v for i, a, t in combos for v in (F.lit(i), F.struct(F.lit(a).alias("area"), F.lit(t).alias("iou_thr")))])
    rated = _best_points(slim, npos, by, combos, target).withColumn("_c", F.element_at(places, F.col("combo"))).select(*by, "_c.*", "point", "p")
    later = (Window.partitionBy(*by, "area", "iou_thr").orderBy(F.col("point").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lower = Window.partitionBy(*by, "area", "iou_thr").orderBy("point")
    steps = (rated.withColumn("best", F.max("p").over(later))
             .withColumn("width", F.col("point") - F.coalesce(F.lag("point").over(lower), F.lit(-1))))
    ap = steps.groupBy(*by, "area", "iou_thr").agg(
        (F.sum(F.col("best") * F.col("width")) / RECALL_POINTS).alias("ap"),
        ((F.max("point") + 1) / RECALL_POINTS).alias("reach"))
    cells = npos.select("*", F.explode(F.array(*[F.lit(float(t)) for t in iou_thrs])).alias("iou_thr"))
    return (cells.join(ap, [*by, "area", "iou_thr"], "left")
            .select(*by, "area", "iou_thr", F.coalesce("ap", F.lit(0.0)).alias("ap"),
                    F.coalesce("reach", F.lit(0.0)).alias("reach")))


def recall_table(matches: DataFrame, npos: DataFrame, max_dets: Sequence[int] = (1, 10, 100),
                 iou_thrs: Sequence[float] = IOU_THRS, areas: dict = AREAS, by: Sequence[str] = ("category_id",)) -> DataFrame:
    """``(by.., area, max_det, ar)``: recall averaged over thresholds, with only the first ``max_det`` per image.

    Matching is prefix-stable in score order, so one match serves every limit.
    """
    by = list(by)
    n_thr = len(iou_thrs)
    aggs = []
    for m in max_dets:
        for i, name in enumerate(areas):
            block = sum(1 << (i * n_thr + j) for j in range(n_thr))
            hits = F.bit_count(F.col("tp_mask").bitwiseAND(F.lit(block).cast("long")))
            aggs.append(F.sum(F.when(F.col("det_rank") <= m, hits).otherwise(0)).alias(f"{name}@{m}"))
    wide = matches.groupBy(*by).agg(*aggs)
    pieces = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(m).alias("max_det"), F.col(f"`{a}@{m}`").alias("hits"))
                                 for a in areas for m in max_dets]))
    tall = wide.select(*by, pieces.alias("c")).select(*by, "c.*")
    cells = npos.select("*", F.explode(F.array(*[F.lit(m) for m in max_dets])).alias("max_det"))
    return (cells.join(tall, [*by, "area", "max_det"], "left")
            .select(*by, "area", "max_det", (F.coalesce("hits", F.lit(0)) / n_thr / F.col("npos")).alias("ar")))


def summarise(precision: DataFrame, recall: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The twelve summary figures as ``(by.., metric, value)``; a figure without any cell is NULL."""
    at = F.col
    ap = precision.groupBy(*by).agg(
        F.avg(F.when(at("area") == "all", at("ap"))).alias("AP"),
        F.avg(F.when((at("area") == "all") & (at("iou_thr") == 0.5), at("ap"))).alias("AP50"),
        F.avg(F.when((at("area") == "all") & (at("iou_thr") == 0.75), at("ap"))).alias("AP75"),
        *[F.avg(F.when(at("area") == a, at("ap"))).alias(f"AP_{a}") for a in ("small", "medium", "large")])
    ar = recall.groupBy(*by).agg(
        *[F.avg(F.when((at("area") == "all") & (at("max_det") == m), at("ar"))).alias(f"AR_{m}") for m in (1, 10, 100)],
        *[F.avg(F.when((at("area") == a) & (at("max_det") == 100), at("ar"))).alias(f"AR_{a}")
          for a in ("small", "medium", "large")])
    out = None
    for wide in (ap, ar):
        names = [c for c in wide.columns if c not in by]
        tall = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                                    for n in names])).alias("m")).select(*by, "m.*")
        out = tall if out is None else out.unionByName(tall)
    return out


def classwise(precision: DataFrame) -> DataFrame:
    """One row per class: mean AP, AP50, AP75 and AP by size."""
    at = F.col
    return precision.groupBy("category_id").agg(
        F.avg(F.when(at("area") == "all", at("ap"))).alias("ap"),
        F.avg(F.when((at("area") == "all") & (at("iou_thr") == 0.5), at("ap"))).alias("ap50"),
        F.avg(F.when((at("area") == "all") & (at("iou_thr") == 0.75), at("ap"))).alias("ap75"),
        *[F.avg(F.when(at("area") == a, at("ap"))).alias(f"ap_{a}") for a in ("small", "medium", "large")])


def split_means(precision: DataFrame, categories: DataFrame, split: str) -> DataFrame:
    """Mean AP and AP50 over the classes of each value of ``categories.<split>`` (base/novel, frequency …)."""
    both = precision.where("area = 'all'").join(categories.select("category_id", split), "category_id")
    return both.groupBy(split).agg(F.avg("ap").alias("ap"), F.avg(F.when(F.col("iou_thr") == 0.5, F.col("ap"))).alias("ap50"))


def federated(det: DataFrame, verified: DataFrame) -> DataFrame:
    """Keep detections of classes judged on the image, present or absent: ``verified(image_id, category_id)``."""
    return det.join(verified, ["image_id", "category_id"], "left_semi")


def top_per_category(det: DataFrame, k: int) -> DataFrame:
    """Best ``k`` detections of each class over the whole dataset, with no limit per image."""
    order = Window.partitionBy("category_id").orderBy(F.col("score").desc(), "det_id")
    return det.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def error_breakdown(det: DataFrame, gt: DataFrame, categories: DataFrame) -> DataFrame:
    """Precision-curve areas as error causes are forgiven one by one: ``(category_id, area, stage, ap)``.

    C75, C50, Loc: thresholds .75, .5, .1. Sim and Oth: boxes of the same group, then of any other class,
    act as ignored ones. BG: false alarms are forgiven wherever some precision is left; FN: all is forgiven.
    """
    rules = {"C75": (0.75, None), "C50": (0.5, None), "Loc": (0.1, None), "Sim": (0.1, "supercategory"), "Oth": (0.1, "any")}
    stages = [float(i) for i in range(len(rules))]  # a stage takes the place of a threshold
    npos = count_real(gt)
    # one row per class
    groups = categories.dropDuplicates(["category_id"]).select("category_id", "supercategory", F.coalesce(
        F.when(F.col("supercategory").isNull(), -1), F.dense_rank().over(Window.orderBy("supercategory"))).alias("part"))
    det, gt = (_measured(x).join(F.broadcast(groups), "category_id", "left").na.fill(-2, ["part"]) for x in (det, gt))
    det_small, gt_small, det, gt = split_images(det, gt, ["image_id"], _READ)
    steps = [([t for t, f in rules.values() if f == forgive], forgive) for forgive in (None, "supercategory", "any")]
    matches = _image_masks(det_small, gt_small, steps, AREAS, 100)
    if det is not None:
        matches = matches.unionByName(_joined_masks(det, gt, steps))
    out = precision_table(matches, npos, stages)
    label = F.create_map(*[v for i, n in zip(stages, rules) for v in (F.lit(i), F.lit(n))])
    named = out.select("category_id", "area", F.element_at(label, F.col("iou_thr")).alias("stage"), "ap", "reach")
    # the last rule leaves some precision wherever a box is found
    kept = F.explode(F.array(F.struct("stage", "ap"), F.when(F.col("stage") == "Oth", F.struct(F.lit("BG").alias("stage"), F.col("reach").alias("ap"))))).alias("r")
    return (named.select("category_id", "area", kept).where("r IS NOT NULL").select("category_id", "area", "r.stage", "r.ap")
            .unionByName(npos.select("category_id", "area", F.lit("FN").alias("stage"), F.lit(1.0).alias("ap"))))


def _joined_masks(det: DataFrame, gt: DataFrame, rules: Sequence[tuple[Sequence[float], str | None]]) -> DataFrame:
    """The rows of :func:`_image_masks` from joins, for images of any size."""
    bits, offset, out = sum(len(t) for t, _ in rules), 0, None
    for thrs, forgive in rules:
        n = len(thrs)
        placed = {c: sum((F.shiftleft(F.shiftrightunsigned(c, i * n).bitwiseAND(F.lit((1 << n) - 1).cast("long")), i * bits + offset) for i in range(len(AREAS))),
                         F.lit(0).cast("long")) for c in ("tp_mask", "ignore_mask")}
        known = [x if forgive is None else x.where("part <> -2") for x in (det, gt)]
        found = coco_match(*known, thrs, forgive=forgive, ordinary=False).withColumns(placed)
        if out is None:
            out = found
        else:
            absent = sum(((1 << n) - 1) << (i * bits + offset) for i in range(len(AREAS)))
            more = found.select("det_id", F.col("tp_mask").alias("_t"), F.col("ignore_mask").alias("_i"))
            out = out.join(more, "det_id", "left").withColumns({
                "tp_mask": F.col("tp_mask").bitwiseOR(F.coalesce("_t", F.lit(0).cast("long"))),
                "ignore_mask": F.col("ignore_mask").bitwiseOR(F.coalesce("_i", F.lit(absent).cast("long")))}).drop("_t", "_i")
        offset += n
    return out
