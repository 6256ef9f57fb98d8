"""One entry for offline evaluation: stored predictions and truth in, ``(dataset, metric, value)`` out.

The dataset is a key like the class: all datasets go through one overlap join, one match and one aggregation per metric,
however many there are. Ids may repeat between datasets; inside they become ``id * datasets + number of the dataset``, so an
image, a box or a detection says by arithmetic to which dataset it belongs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.operators import coco_metrics as C
from detframe.operators.average_precision import count_boxes, masked_precision, mean_ap
from detframe.operators.greedy import proposal_recall
from detframe.operators.matching import threshold_masks
from detframe.session import land

IDS = ("det_id", "ann_id", "image_id")
BOXES = ("category_id", "x1", "y1", "x2", "y2")
BY = ["dataset", "category_id"]


def _voc(det: DataFrame, gt: DataFrame) -> DataFrame:
    marked = gt.withColumn("ignore", F.col("iscrowd") == 1)
    masks = threshold_masks(det, marked, (0.5,), ("dataset", "image_id", "category_id"), legacy=True)
    means = mean_ap(masked_precision(masks, count_boxes(marked, BY), (0.5,), BY), ["dataset"])
    return means.select("dataset", F.lit("voc_map_50").alias("metric"), F.col("map").alias("value"))


def _coco(datasets: int):
    def run(det: DataFrame, gt: DataFrame) -> DataFrame:
        matches = land(C.coco_match(det, gt).withColumn("dataset", F.pmod("image_id", F.lit(datasets)).cast("int")))
        npos = C.count_real(gt, by=BY)
        out = C.summarise(C.precision_table(matches, npos, by=BY, stored=True), C.recall_table(matches, npos, by=BY), ["dataset"])
        return out.select("dataset", F.concat(F.lit("coco_"), "metric").alias("metric"), "value")
    return run


def _recall(det: DataFrame, gt: DataFrame) -> DataFrame:
    out = proposal_recall(det, gt, (100, 300), (0.5, 0.75), by=["dataset"])
    return out.select("dataset", F.format_string("recall_%d@%.2f", "proposals", "iou_thr").alias("metric"), F.col("recall").alias("value"))


def _stacked(parts: Sequence[DataFrame], wanted: Sequence[str]) -> DataFrame:
    """The datasets' rows below each other with their number, ids kept apart."""
    out = None
    for number, part in enumerate(parts):
        cols = [(F.col(c).cast("long") * len(parts) + number).alias(c) if c in IDS else F.col(c) for c in wanted]
        rows = part.select(F.lit(number).alias("dataset"), *cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate(datasets: Mapping[str, tuple[DataFrame, DataFrame]], metrics: Sequence[str] = ("voc", "coco")) -> DataFrame:
    """Evaluate the (detections, truth) of every dataset: ``(dataset, metric, value)``.

    ``voc``: mean AP at 0.5; ``coco``: the twelve figures; ``recall``: of 100 and 300 proposals at 0.5 and 0.75. A dataset
    without boxes has no rows for ``voc`` and ``coco`` and none for ``recall``; one without detections has zeros.
    """
    if not datasets:
        raise ValueError("no dataset to evaluate")
    known = {"voc": _voc, "coco": _coco(len(datasets)), "recall": _recall}
    if unknown := sorted(set(metrics) - set(known)):
        raise ValueError(f"unknown metrics {unknown}")
    # the narrow rows are written once: every metric reads them
    det = land(_stacked([d for d, _ in datasets.values()], ["det_id", "image_id", *BOXES, "score"]))
    gt = land(_stacked([g for _, g in datasets.values()], ["ann_id", "image_id", *BOXES, "iscrowd"]))
    names = F.array(*[F.lit(n) for n in datasets])
    out = None
    for metric in metrics:
        part = known[metric](det, gt).select(F.get(names, F.col("dataset")).alias("dataset"), "metric", F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
