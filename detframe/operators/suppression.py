"""Removing duplicate detections: greedy, one-pass, decayed, and merging of tiles and augmented views."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions.arrays import pairwise_iou
from detframe.operators.overlap import overlap_pairs
from detframe.plans.grouped import GROUP_LIMIT, scan_groups, scan_states, split_by_size
from detframe.session import cut_lineage

SLIM = ["det_id", "x1", "y1", "x2", "y2", "score"]


def _keys(class_agnostic: bool) -> list[str]:
    return ["image_id"] if class_agnostic else ["image_id", "category_id"]


def ranked_pairs(det: DataFrame, keys: Sequence[str], min_overlap: float = 0.0, mode: str = "iou") -> DataFrame:
    """Overlapping pairs ``(hi, lo, iou, hi_score, lo_score)`` of one group, ``hi`` ahead by (score desc, det_id)."""
    slim = det.select(*keys, *SLIM)
    pairs = overlap_pairs(slim, slim, keys, "a_", "b_", mode=mode, min_overlap=min_overlap)
    ahead = (F.col("a_score") > F.col("b_score")) | (
        (F.col("a_score") == F.col("b_score")) & (F.col("a_det_id") < F.col("b_det_id")))
    return pairs.where(ahead).select(F.col("a_det_id").alias("hi"), F.col("b_det_id").alias("lo"), "iou",
                                     F.col("a_score").alias("hi_score"), F.col("b_score").alias("lo_score"))


def greedy_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kept ``det_id`` of greedy suppression, for groups too large for one task.

    Each round keeps every node with no open neighbour ahead of it and removes what those suppress; that
    is the sequential result, reached in as many rounds as the longest chain of overlaps needs.
    """
    open_edges = cut_lineage(edges.select("hi", "lo"))
    removed: DataFrame | None = None
    while open_edges.limit(1).count():
        blocked = open_edges.select(F.col("lo").alias("hi")).distinct()
        kept = open_edges.join(blocked, "hi", "left_anti")
        gone = cut_lineage(kept.select("lo").distinct())
        removed = gone if removed is None else removed.unionByName(gone)
        open_edges = cut_lineage(open_edges.join(gone, "lo", "left_anti")
                                 .join(gone.withColumnRenamed("lo", "hi"), "hi", "left_anti"))
    if removed is None:
        return nodes.select("det_id")
    return nodes.select("det_id").join(removed.withColumnRenamed("lo", "det_id"), "det_id", "left_anti")


def nms(det: DataFrame, iou_thr: float, class_agnostic: bool = False, limit: int = GROUP_LIMIT) -> DataFrame:
    """Greedy suppression per image (and class): in score order, drop what overlaps a kept box by more than the threshold."""
    keys = _keys(class_agnostic)
    small, large = split_by_size(det, keys, limit)

    def keep(rows):
        box = np.stack([rows[c] for c in ("x1", "y1", "x2", "y2")], axis=1)
        alive = np.ones(len(box), dtype=bool)
        chosen = []
        for i in range(len(box)):
            if not alive[i]:
                continue
            chosen.append(i)
            if i + 1 < len(box):
                rest = np.flatnonzero(alive[i + 1:]) + i + 1
                hit = pairwise_iou(box[i:i + 1], box[rest])[0] > iou_thr
                alive[rest[hit]] = False
        return {"det_id": rows["det_id"][chosen]}

    ids = scan_groups(small.select(*keys, *SLIM), keys, [F.col("score").desc(), "det_id"], keep, "det_id long")
    if large is not None:
        edges = ranked_pairs(large, keys).where(F.col("iou") > float(iou_thr))
        ids = ids.unionByName(greedy_rounds(large, edges))
    return det.join(ids, "det_id", "left_semi")


def top_per_image(det: DataFrame, max_num: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """The ``max_num`` best per key; Spark limits each partition before the shuffle."""
    if max_num < 0:
        return det
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "det_id")
    return det.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_num).drop("_r")


def multiclass_nms(det: DataFrame, score_thr: float, iou_thr: float, max_num: int = -1,
                   score_factor: Column | None = None) -> DataFrame:
    """Score filter, optional rescoring after it, greedy suppression per class, best ``max_num`` per image."""
    kept = det.where(F.col("score") > float(score_thr))
    if score_factor is not None:
        kept = kept.withColumn("score", F.col("score") * score_factor)
    return top_per_image(nms(kept, iou_thr), max_num)


def fast_nms(det: DataFrame, score_thr: float, iou_thr: float, top_k: int, max_num: int = -1) -> DataFrame:
    """One-pass suppression: drop a box that overlaps any better box, dropped or not, by more than the threshold."""
    best = top_per_image(det.where(F.col("score") > float(score_thr)), top_k, ["image_id", "category_id"])
    beaten = (ranked_pairs(best, ["image_id", "category_id"]).where(F.col("iou") > float(iou_thr))
              .select(F.col("lo").alias("det_id")))
    return top_per_image(best.join(beaten, "det_id", "left_anti"), max_num)


def matrix_nms(det: DataFrame, kernel: str = "gaussian", sigma: float = 2.0, filter_thr: float = -1.0,
               max_num: int = -1) -> DataFrame:
    """Decay each score by its best-explained overlap with better boxes; adds ``decayed``.

    The decay is min over better boxes of f(overlap) / f(that box's own largest overlap), at most 1.
    """
    keys = ["image_id", "category_id"]
    pairs = ranked_pairs(det, keys)
    shade = pairs.groupBy(F.col("lo").alias("hi")).agg(F.max("iou").alias("comp"))
    both = pairs.join(shade, "hi", "left").withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    if kernel == "gaussian":
        factor = F.exp(-sigma * (F.col("iou") * F.col("iou"))) / F.exp(-sigma * (F.col("comp") * F.col("comp")))
    elif kernel == "linear":
        factor = (1 - F.col("iou")) / F.greatest(1 - F.col("comp"), F.lit(1e-12))
    else:
        raise ValueError(f"unknown kernel {kernel}")
    decay = both.groupBy(F.col("lo").alias("det_id")).agg(F.least(F.min(factor), F.lit(1.0)).alias("_decay"))
    out = det.join(decay, "det_id", "left").withColumn(
        "decayed", F.col("score") * F.coalesce("_decay", F.lit(1.0))).drop("_decay")
    if filter_thr >= 0:
        out = out.where(F.col("decayed") >= float(filter_thr))
    if max_num < 0:
        return out
    order = Window.partitionBy("image_id").orderBy(F.col("decayed").desc(), "det_id")
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_num).drop("_r")


def drop_backdrops(det: DataFrame, obj_score_thr: float, backdrop_iou_thr: float, class_iou_thr: float) -> DataFrame:
    """Across classes, drop a box that overlaps any better box; weak boxes face the stricter threshold."""
    thr = F.when(F.col("lo_score") < float(obj_score_thr), float(backdrop_iou_thr)).otherwise(float(class_iou_thr))
    beaten = ranked_pairs(det, ["image_id"]).where(F.col("iou") > thr).select(F.col("lo").alias("det_id"))
    return det.join(beaten, "det_id", "left_anti")


def merge_tiles(det: DataFrame, tiles: DataFrame, iou_thr: float) -> DataFrame:
    """Shift detections of ``tiles(tile_id, image_id, off_x, off_y)`` into the image frame and suppress."""
    placed = det.join(tiles, "tile_id")
    moved = B.translate(B.box(), F.col("off_x"), F.col("off_y"))
    rest = [c for c in placed.columns if c not in B.COORDS and c not in ("off_x", "off_y")]
    return nms(placed.select(*rest, *B.named(moved)), iou_thr)


def undo_views(det: DataFrame, views: DataFrame) -> DataFrame:
    """Map boxes of augmented ``views(view_id, scale, direction, width, height)`` back to the image."""
    both = det.join(views, "view_id")
    w, h, s = F.col("width").cast("double"), F.col("height").cast("double"), F.col("scale")
    plain = B.map_back(B.box(), w, h, s, None)
    cols = []
    for i, c in enumerate(B.COORDS):
        value = plain[i]
        for direction in ("horizontal", "vertical", "diagonal"):
            value = F.when(F.col("direction") == direction, B.map_back(B.box(), w, h, s, direction)[i]).otherwise(value)
        cols.append(value.alias(c))
    rest = [c for c in det.columns if c not in B.COORDS]
    return both.select(*rest, *cols)


def merge_views(det: DataFrame, views: DataFrame, iou_thr: float, max_num: int = -1) -> DataFrame:
    """Test-time augmentation: map back, pool, suppress."""
    return top_per_image(nms(undo_views(det, views), iou_thr), max_num)


def average_views(det: DataFrame, views: DataFrame, by: Sequence[str]) -> DataFrame:
    """Aligned merge: mean box and mean score of the copies that share ``by``."""
    return undo_views(det, views).groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in B.COORDS], F.avg("score").alias("score"))


def weighted_fusion(det: DataFrame, weights: Sequence[float], iou_thr: float = 0.55, skip_thr: float = 0.0,
                    conf_type: str = "avg", allows_overflow: bool = False) -> DataFrame:
    """Fuse boxes of several models (``det.model`` = 0, 1, …): ``(image_id, category_id, box, score, members)``.

    In order of weighted score a box joins the cluster whose running weighted box it overlaps most, if
    above the threshold. State per (image, class) is its clusters only; rows stream through in order.
    """
    table = F.create_map(*[v for i, w in enumerate(weights) for v in (F.lit(i), F.lit(float(w)))])
    total, top, count = float(sum(weights)), float(max(weights)), len(weights)
    ready = (det.where(F.col("score") >= float(skip_thr))
             .withColumn("w", F.element_at(table, F.col("model").cast("int")))
             .withColumn("ws", F.col("score") * F.col("w"))
             .select("image_id", "category_id", "ws", "w", "model", "det_id",
                     F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"),
                     F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
             .where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))))

    def fresh():
        return {"size": 0, "box": np.empty((16, 4)), "sum": np.empty((16, 4)), "conf": [], "n": [], "best": [], "w": [], "models": []}

    def step(state, rows):
        for i in range(len(rows["ws"])):
            box = np.array([rows[c][i] for c in B.COORDS])
            ws, w, model = rows["ws"][i], rows["w"][i], int(rows["model"][i])
            at = -1
            size = state["size"]
            if size:
                ious = pairwise_iou(state["box"][:size], box[None])[:, 0]
                at = int(np.argmax(ious))
                if ious[at] <= iou_thr:
                    at = -1
            if at < 0:
                if size == len(state["box"]):  # room doubles, so a cluster is copied a bounded number of times
                    state["box"], state["sum"] = (np.concatenate([x, np.empty_like(x)]) for x in (state["box"], state["sum"]))
                state["box"][size], state["sum"][size] = box, box * ws
                state["size"] = size + 1
                for k, v in (("conf", ws), ("n", 1), ("best", ws), ("w", w), ("models", {model: w})):
                    state[k].append(v)
            else:
                state["sum"][at] += box * ws
                state["conf"][at] += ws
                state["n"][at] += 1
                state["best"][at] = max(state["best"][at], ws)
                state["w"][at] += w
                state["models"][at][model] = w
                state["box"][at] = state["sum"][at] / state["conf"][at]

    def finish(state):
        n = np.array(state["n"], dtype=float)
        conf = np.array(state["conf"]) / n if conf_type != "max" else np.array(state["best"])
        w_sum = np.array(state["w"])
        distinct = np.array([sum(m.values()) for m in state["models"]])
        absent = total - distinct
        if conf_type == "box_and_model_avg":
            score = conf * n / w_sum * distinct / total
        elif conf_type == "absent_model_aware_avg":
            score = conf * n / (w_sum + absent)
        elif conf_type == "max":
            score = conf / top
        elif allows_overflow:
            score = conf * n / total
        else:
            score = conf * np.minimum(count, n) / total
        return {**{c: state["box"][:state["size"], j] for j, c in enumerate(B.COORDS)}, "score": score, "members": n.astype(np.int64)}

    return scan_states(
        ready, ["image_id", "category_id"], [], [F.col("ws").desc(), "det_id"], fresh, step,
        "image_id long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, members long",
        finish)


def expand_hierarchy(rows: DataFrame, closure: DataFrame, allowed: DataFrame | None, ident: str) -> DataFrame:
    """Add ancestor copies of each row, where the ancestor is allowed on the image; drop classes not allowed.

    ``closure(child, ancestor)`` includes each class with itself; ``allowed(image_id, category_id)`` may be None. An ``ident``
    belongs to one image, so copies are told apart, and allowed classes looked up, by image: rows that lie by image stay put.
    """
    grown = (rows.join(closure, rows.category_id == closure.child).drop("child", "category_id")
             .withColumnRenamed("ancestor", "category_id"))
    out = grown.dropDuplicates(["image_id", ident, "category_id"])
    if allowed is None:
        return out
    classes = allowed.groupBy("image_id").agg(F.collect_set("category_id").alias("_allowed"))
    return out.join(classes, "image_id").where(F.array_contains("_allowed", F.col("category_id"))).drop("_allowed")


def merge_phrase_boxes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Enclosing box of all boxes of a phrase."""
    return rows.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"),
                                 F.max("x2").alias("x2"), F.max("y2").alias("y2"))
