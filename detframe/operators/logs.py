"""Training-log statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def carry_epoch(lines: DataFrame, run: str = "run", line: str = "line_no") -> DataFrame:
    """Fill ``epoch`` forward; a line belongs to the epoch stated on an earlier line, 1 before the first."""
    before = Window.partitionBy(run).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("epoch", F.coalesce(F.last("epoch", ignorenulls=True).over(before), F.lit(1).cast("long")))


def train_time(lines: DataFrame, run: str = "run", line: str = "line_no", include_outliers: bool = False) -> DataFrame:
    """Per run: slowest and fastest epoch with their mean time, spread over epochs, mean over epochs.

    The first iteration of an epoch is left out unless ``include_outliers``.
    """
    rows = lines
    if not include_outliers:
        first = Window.partitionBy(run, "epoch").orderBy(line)
        rows = lines.withColumn("_r", F.row_number().over(first)).where("_r > 1")
    per = rows.groupBy(run, "epoch").agg(F.avg("time").alias("mean"))
    return per.groupBy(run).agg(
        F.max_by("epoch", F.struct("mean", -F.col("epoch"))).alias("slowest_epoch"), F.max("mean").alias("slowest"),
        F.min_by("epoch", F.struct("mean", "epoch")).alias("fastest_epoch"), F.min("mean").alias("fastest"),
        F.stddev_pop("mean").alias("std"), F.avg("mean").alias("mean"))


def loss_means(lines: DataFrame, keys: Sequence[str], index: str = "epoch", run: str = "run") -> DataFrame:
    """Mean of each loss per epoch (or iteration)."""
    return lines.groupBy(run, index).agg(*[F.avg(k).alias(k) for k in keys])


def curve(lines: DataFrame, metric: str, run: str = "run", index: str = "epoch") -> DataFrame:
    """Long form ``(run, index, value)`` of one metric, missing values left out."""
    return lines.where(F.col(metric).isNotNull()).select(run, index, F.col(metric).alias("value"))


def newest_runs(lines: DataFrame, group: str, run: str, changed: str) -> DataFrame:
    """Lines of the most recently changed run of each group."""
    latest = lines.groupBy(group).agg(F.max_by(run, F.struct(changed, run)).alias(run))
    return lines.join(latest, [group, run], "left_semi")


def parameter_grid(spark, grid: dict[str, Sequence]) -> DataFrame:
    """Every combination of the listed parameter values, one column each, built by explodes of literal lists."""
    out = spark.range(1).select()
    for name, values in grid.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out
