"""Running curves and issue rates over arriving data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detframe.session import shared_dir


def metric_curves(logs: DataFrame, metric: str, value: str, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Mean, count and extremes of each metric per time window; windows close when the watermark has passed."""
    return (logs.withWatermark(ts, delay).groupBy(F.window(ts, width), F.col(metric))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
            .select(F.col("window.start").alias("start"), F.col(metric).alias("metric"), "n", "mean", "low", "high"))


def issue_rates(boxes: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Boxes and share of faulty ones per window; ``boxes(x, y, w, h, width, height, ts)``."""
    bad = ((F.col("w") <= 0) | (F.col("h") <= 0) | (F.col("x") < 0) | (F.col("y") < 0)
           | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height")))
    return (boxes.withWatermark(ts, delay).groupBy(F.window(ts, width))
            .agg(F.count(F.lit(1)).alias("boxes"), F.sum(bad.cast("long")).alias("faulty"))
            .select(F.col("window.start").alias("start"), "boxes", "faulty", (F.col("faulty") / F.col("boxes")).alias("rate")))


def drain_windows(stream: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Run windowed aggregates over what has arrived so far; windows still open are in the result, each as last updated."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    query = (stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/log").outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(schema).parquet(f"{base}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what has arrived so far and read its result back from files in the shared folder."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
