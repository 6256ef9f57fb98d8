"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import land


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    joined = down.join(_smallest(down), "u")
    return (joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v"))).distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node that occurs in ``links`` (``a``, ``b`` long): root is the smallest id reachable.

    Each round is two aggregations by node with a join back; nothing is gathered by component, and the
    rounds (their number is logarithmic) are landed in the shared folder. Null ends and loops are no links.
    An empty table gives an empty table.
    """
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        stars = land(_small_star(_large_star(edges)))
        # A star forest is reached when every node has one parent and no parent has a parent.
        split = stars.groupBy("u").count().where("count > 1").limit(1).count()
        deep = 0 if split else stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = stars
        if not split and not deep:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
