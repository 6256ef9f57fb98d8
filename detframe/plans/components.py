"""Connected components of sparse pair lists, by aggregations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.session import cut_lineage


def pair_components(pairs: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "component") -> DataFrame:
    """``pairs`` with ``name``: the least ``left`` id that the pair's nodes reach through other pairs of the same keys.

    Left nodes that meet in a right node are linked to the least of them; then large and small stars alternate until
    every node hangs on its root. A round is two aggregations per node; their number grows with the logarithm of a component.
    """
    keys = list(keys)
    hubs = pairs.groupBy(*keys, right).agg(F.min(left).alias("v"))
    edges = cut_lineage(pairs.join(hubs, [*keys, right]).select(*keys, F.col(left).alias("u"), "v").where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        hung = large.join(least, [*keys, "u"])
        small = hung.where("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select(*keys, "u", F.col("m").alias("v"))).distinct()
        stars = cut_lineage(small)
        roots = stars.select(*keys, F.col("v").alias("u")).distinct()
        split = stars.groupBy(*keys, "u").count().where("count > 1").select(*keys, "u").unionByName(stars.join(roots, [*keys, "u"], "left_semi").select(*keys, "u"))
        edges = stars
        if not split.limit(1).count():
            break
    named = edges.select(*keys, F.col("u").alias(left), F.col("v").alias(name))
    return pairs.join(named, [*keys, left], "left").withColumn(name, F.coalesce(name, left))
