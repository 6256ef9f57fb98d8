"""Pedestrian metrics: AP without an envelope, log-average miss rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.plans.ordered import TARGET_ROWS, crowded, running_sums
from detframe.session import cut_lineage

# fixed values: false positives per image at which the miss rate is read
FPPI_POINTS = (0.0100, 0.0178, 0.03160, 0.0562, 0.1000, 0.1778, 0.3162, 0.5623, 1.000)


def crowd_metrics(flags: DataFrame, gt: DataFrame, target: int = TARGET_ROWS) -> DataFrame:
    """``(num_gts, num_images, ap, mr)`` from Caltech-matched detections (``tp``/``fp``; neutral rows drop out).

    The area under the curve is a trapezoid sum from the first point on; between two points precision only
    weighs in where recall grows, that is at true positives. The miss rate is read at the first row at or
    beyond each reference rate, else at the last row, and averaged geometrically.
    """
    slim = cut_lineage(flags.where("tp + fp > 0").select("det_id", "score", "tp", "fp"))
    sums = {"ctp": F.col("tp").cast("long"), "cfp": F.col("fp").cast("long")}
    if crowded(slim, [], target):
        cum = running_sums(slim, [], "score", "det_id", sums, target=target)
    else:  # bounded by the target
        down = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "det_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        cum = slim.select("*", *[F.sum(e).over(down).alias(n) for n, e in sums.items()])
    totals = gt.agg(F.sum((~F.col("ignore").cast("boolean")).cast("long")).alias("num_gts"),
                    F.countDistinct("image_id").alias("num_images"))  # one row
    curve = cum.join(F.broadcast(totals))
    before_tp, before_n = F.col("ctp") - 1, F.col("ctp") + F.col("cfp") - 1
    strip = (F.col("ctp") / (F.col("ctp") + F.col("cfp")) + before_tp / before_n) / 2 / F.col("num_gts")
    fppi, miss = F.col("cfp") / F.col("num_images"), 1 - F.col("ctp") / F.col("num_gts")
    reads = [F.min(F.when(fppi >= p, F.struct((F.col("ctp") + F.col("cfp")).alias("n"), miss.alias("m"))))["m"].alias(f"m{i}")
             for i, p in enumerate(FPPI_POINTS)]
    out = curve.groupBy("num_gts", "num_images").agg(
        F.sum(F.when((F.col("tp") == 1) & (before_n > 0), strip)).alias("ap"), F.min(miss).alias("last"), *reads)
    logs = [F.log(F.coalesce(f"m{i}", "last")) for i in range(len(FPPI_POINTS))]
    # a miss rate of 0 has logarithm -inf in the published formula, hence a geometric mean of 0
    zero = F.least(*[F.coalesce(f"m{i}", "last") for i in range(len(FPPI_POINTS))]) <= 0
    mean = F.when(zero, F.lit(0.0)).otherwise(F.exp(sum(logs[1:], logs[0]) / len(FPPI_POINTS)))
    return out.select("num_gts", "num_images", F.coalesce("ap", F.lit(0.0)).alias("ap"), mean.alias("mr"))
