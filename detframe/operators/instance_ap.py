"""Average precision of instance masks by pixel overlap, with regions that count neither for nor against.

Masks are runs. A truth counts if it is no crowd and not too small; a prediction without a match is forgiven in the share of
its pixels that lies on void, crowd or too small regions. Everything is joins and aggregations: a match at one threshold
is a match at all below it, so a pair is spread over the thresholds it passes and nothing is ranked per image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.operators.segments import run_areas, run_overlaps
from detframe.plans.ordered import TARGET_ROWS, running_sums
from detframe.session import cut_lineage

LEVELS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
MIN_REGION = 100


def _levels(levels: Sequence[float], passes) -> Column:
    """Numbers of the thresholds for which ``passes(threshold)`` holds, one row each."""
    return F.explode(F.array_compact(F.array(*[F.when(passes(F.lit(float(t))), F.lit(k)) for k, t in enumerate(levels)]))).alias("level")


def instance_pairs(gt_runs: DataFrame, pred_runs: DataFrame, gt: DataFrame, pred: DataFrame, min_region: int = MIN_REGION) -> DataFrame:
    """Truths and predictions of one class with common pixels: ``image_id, g, p, category_id, score, n, iou, counts, forgiven``.

    ``gt(image_id, g, category_id, iscrowd)``, ``pred(image_id, p, category_id, score)``; runs carry ``g`` or ``p``. ``forgiven`` are the
    pixels on this truth that are not held against the prediction; a truth that is both crowd and small counts for both.
    """
    ga = run_areas(gt_runs, ["image_id", "g"]).withColumnRenamed("area", "_ga")
    pa = run_areas(pred_runs, ["image_id", "p"]).withColumnRenamed("area", "_pa")
    truth = gt.join(ga, ["image_id", "g"]).withColumnRenamed("category_id", "_gc")
    both = (run_overlaps(gt_runs, pred_runs, ["g"], ["p"]).join(truth, ["image_id", "g"])
            .join(pred.join(pa, ["image_id", "p"]), ["image_id", "p"]).where("_gc = category_id"))
    small = (F.col("_ga") < min_region).cast("long")
    return both.select("image_id", "g", "p", "category_id", "score", "n", (F.col("n") / (F.col("_ga") + F.col("_pa") - F.col("n"))).alias("iou"),
                       ((F.col("iscrowd") == 0) & (small == 0)).alias("counts"), (F.col("n") * ((F.col("iscrowd") == 1).cast("long") + small)).alias("forgiven"))


def instance_events(pairs: DataFrame, pred_runs: DataFrame, pred: DataFrame, void_runs: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """``category_id, level, score, tp, n``: hits and predictions at each score, summed where scores are equal.

    Of several predictions that match one truth the best scored one is the hit. An unmatched prediction counts at the thresholds
    that its forgiven share does not pass.
    """
    matched = pairs.where("counts").select("image_id", "g", "category_id", "score", _levels(levels, lambda t: F.col("iou") > t))
    tried = matched.select("category_id", "level", "score", F.lit(0).alias("tp"), F.lit(1).alias("n"))
    hits = matched.groupBy("image_id", "g", "category_id", "level").agg(F.max("score").alias("score")).select(
        "category_id", "level", "score", F.lit(1).alias("tp"), F.lit(0).alias("n"))
    on_truth = pairs.groupBy("image_id", "p").agg(F.max("iou").alias("_best"), F.sum("forgiven").alias("_on"))
    on_void = run_overlaps(void_runs, pred_runs, [], ["p"]).select("image_id", "p", F.col("n").alias("_void"))
    seen = (pred.join(run_areas(pred_runs, ["image_id", "p"]), ["image_id", "p"]).join(on_truth, ["image_id", "p"], "left")
            .join(on_void, ["image_id", "p"], "left").na.fill(0, ["_best", "_on", "_void"]))
    share = (F.col("_on") + F.col("_void")) / F.col("area")
    missed = seen.withColumn("_from", F.greatest("_best", share)).select("category_id", "score", _levels(levels, lambda t: F.col("_from") <= t)).select(
        "category_id", "level", "score", F.lit(0).alias("tp"), F.lit(1).alias("n"))
    return tried.unionByName(hits).unionByName(missed).groupBy("category_id", "level", "score").agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("n").cast("long").alias("n"))


def instance_ap(gt_runs: DataFrame, pred_runs: DataFrame, gt: DataFrame, pred: DataFrame, void_runs: DataFrame, min_region: int = MIN_REGION,
                levels: Sequence[float] = LEVELS, target: int = TARGET_ROWS) -> DataFrame:
    """``category_id, num_gts, ap, ap50`` of every class with a truth that counts; a class without predictions has 0.

    The area under precision over recall is taken by trapezoids between neighbouring scores, from precision 1 at recall 0:
    half the recall gained at a score times the precision there and at the score above. Thresholds must be at least one half.
    """
    pairs = cut_lineage(instance_pairs(gt_runs, pred_runs, gt, pred, min_region))
    areas = run_areas(gt_runs, ["image_id", "g"])
    truths = gt.where("iscrowd = 0").join(areas, ["image_id", "g"]).where(F.col("area") >= min_region).groupBy("category_id").agg(F.count(F.lit(1)).alias("num_gts"))
    events = cut_lineage(instance_events(pairs, pred_runs, pred, void_runs, levels))
    curve = running_sums(events, ["category_id", "level"], "score", "score", {"ctp": "tp", "cn": "n"}, target=target)
    above = F.when(F.col("cn") > F.col("n"), (F.col("ctp") - F.col("tp")) / (F.col("cn") - F.col("n"))).otherwise(F.lit(1.0))
    gained = F.col("tp") / F.col("num_gts") * (F.col("ctp") / F.col("cn") + above) / 2
    per = curve.where("tp > 0").join(truths, "category_id").groupBy("category_id", "level").agg(F.sum(gained).alias("_ap"))
    first = min(range(len(levels)), key=lambda k: abs(levels[k] - 0.5))
    scores = per.groupBy("category_id").agg((F.sum("_ap") / len(levels)).alias("ap"), F.sum(F.when(F.col("level") == first, F.col("_ap"))).alias("ap50"))
    return truths.join(scores, "category_id", "left").na.fill(0.0, ["ap", "ap50"])


def instance_summary(per_class: DataFrame) -> DataFrame:
    """Means over the classes: ``ap, ap50, classes``."""
    return per_class.agg(F.avg("ap").alias("ap"), F.avg("ap50").alias("ap50"), F.count(F.lit(1)).alias("classes"))
