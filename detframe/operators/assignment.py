"""One-to-one assignment of least total cost over sparse candidate pairs.

Three sizes, one result. Groups up to a number of pairs are solved as they are, by augmenting paths over their pair list. Larger
ones fall into their connected components, which share no node. A component that is still too large for one task is auctioned:
its free nodes bid for partners in rounds of aggregations, and prices are all that rounds share.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions.arrays import assign_sparse
from detframe.plans.components import pair_components
from detframe.plans.grouped import scan_groups, split_by_size
from detframe.session import cut_lineage

PAIR_LIMIT = 20_000
#: Costs are told apart down to this share of the largest gain where they are auctioned.
RESOLUTION = 1e-6
#: The bidding step falls by this factor from one phase to the next.
FACTOR = 5


def _solve(rows):
    got = assign_sparse(rows["a_id"], rows["b_id"], rows["gain"])
    return {c: rows[c][got] for c in ("a_id", "b_id", "cost")}


def _auction(pairs: DataFrame, keys: Sequence[str], resolution: float) -> DataFrame:
    """Pairs of an assignment of greatest total gain, exact for gains rounded to ``resolution`` of the largest.

    Nodes may stay free, which an auction with falling steps does not allow; so the pairs are doubled: every node gets a stand-in on the
    other side that takes it for nothing, and the stand-ins of a pair can meet for nothing. Everyone is then assigned, and
    what the doubled assignment gains is what the plain one does. All numbers are whole, so rounds do not depend on the split.
    """
    keys = list(keys)
    most = pairs.agg(F.max("gain")).first()[0]
    gains = pairs.where("gain > 0").select(*keys, "a_id", "b_id", "cost", F.round(F.col("gain") / F.lit(most * resolution)).cast("long").alias("g")).where("g > 0")
    gains = cut_lineage(gains)
    sizes = gains.groupBy(*keys).agg((F.count_distinct("a_id") + F.count_distinct("b_id")).alias("n"))
    nodes = (sizes.agg(F.max("n")).first()[0] or 0) + 1
    # Steps below one unit over the number of nodes cannot hide a better assignment: gains are scaled so that this is step 1.
    p, o, zero = "p", "o", F.lit(0).cast("long")
    ways = gains.select(*keys, F.explode(F.array(*[F.struct(*[x.alias(c) for x, c in zip(way, ("ps", p, "os", o, "v"))]) for way in (
        (F.lit(0), F.col("a_id"), F.lit(0), F.col("b_id"), F.col("g") * nodes), (F.lit(0), F.col("a_id"), F.lit(1), F.col("a_id"), zero),
        (F.lit(1), F.col("b_id"), F.lit(0), F.col("b_id"), zero), (F.lit(1), F.col("b_id"), F.lit(1), F.col("a_id"), zero))])).alias("w"))
    ways = cut_lineage(ways.select(*keys, "w.*").distinct())
    person, thing = [*keys, "ps", p], [*keys, "os", o]
    people = cut_lineage(ways.select(*person).distinct())
    things = cut_lineage(ways.select(*thing, zero.alias("price")).distinct())
    step = max(1, round(1 / resolution) * nodes // FACTOR)
    nobody = [F.lit(None).cast("int").alias("ps"), F.lit(None).cast("long").alias(p)]
    while True:
        things = things.select(*thing, "price", *nobody)
        while True:
            free = people.join(things.where("ps IS NOT NULL").select(*person), person, "left_anti")
            offers = ways.join(free, person).join(things.select(*thing, "price"), thing).withColumn("net", F.col("v") - F.col("price"))
            order = Window.partitionBy(*person).orderBy(F.col("net").desc(), "os", o)
            top = offers.withColumn("r", F.row_number().over(order)).where("r <= 2")
            # Everyone has two ways at least: a partner and the stand-in.
            bids = top.groupBy(*person).agg(F.max(F.when(F.col("r") == 1, F.struct("os", o, "price", "net"))).alias("x"), F.min("net").alias("second"))
            bids = bids.select(*person, "x.os", f"x.{o}", (F.col("x.price") + F.col("x.net") - F.col("second") + step).alias("bid"))
            won = bids.groupBy(*thing).agg(F.max(F.struct("bid", "ps", p)).alias("w"))
            things = cut_lineage(things.join(won, thing, "left").select(
                *thing, F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.ps", "ps").alias("ps"), F.coalesce(f"w.{p}", p).alias(p)))
            if things.where("ps IS NULL").limit(1).count() == 0:
                break
        if step == 1:
            break
        step = max(1, step // FACTOR)
    taken = things.where("os = 0 AND ps = 0").select(*keys, F.col(p).alias("a_id"), F.col(o).alias("b_id"))
    return gains.join(taken, [*keys, "a_id", "b_id"], "left_semi").select(*keys, "a_id", "b_id", "cost")


def least_cost_pairs(cost: DataFrame, keys: Sequence[str], limit: float | None = None, pair_limit: int = PAIR_LIMIT,
                     component_limit: int | None = None, resolution: float = RESOLUTION) -> DataFrame:
    """``keys.., a_id, b_id, cost`` of the one-to-one pairs of least total cost among the rows of ``cost``.

    With ``limit`` a node may stay free at that price, so only pairs below it are worth taking. Without, as many pairs as
    possible are taken first, and cost decides among them. Groups of more than ``pair_limit`` pairs are solved by connected
    component, components of more than ``component_limit`` pairs by auction.
    """
    keys = list(keys)
    kinds = dict(cost.dtypes)
    rows = cost.select(*keys, F.col("a_id").cast("long").alias("a_id"), F.col("b_id").cast("long").alias("b_id"), F.col("cost").cast("double").alias("cost"))
    if limit is not None:
        rows = rows.where(F.col("cost") < float(limit)).withColumn("gain", F.lit(float(limit)) - F.col("cost"))
    else:
        span = rows.groupBy(*keys).agg(F.max("cost").alias("_hi"), ((F.max("cost") - F.min("cost")) * (F.count_distinct("a_id") + 1) + 1).alias("_m"))
        rows = rows.join(span, keys).withColumn("gain", F.col("_hi") - F.col("cost") + F.col("_m")).drop("_hi", "_m")
    rows = cut_lineage(rows.groupBy(*keys, "a_id", "b_id").agg(F.min("cost").alias("cost"), F.max("gain").alias("gain")))
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    out_schema = f"{named}, a_id long, b_id long, cost double"
    small, large = split_by_size(rows, keys, pair_limit)
    found = scan_groups(small, keys, ["a_id", "b_id"], _solve, out_schema)
    if large is None:
        return found
    parts = cut_lineage(pair_components(large, keys, "a_id", "b_id"))
    small, large = split_by_size(parts, [*keys, "component"], component_limit or pair_limit)
    by_part = scan_groups(small, [*keys, "component"], ["a_id", "b_id"], _solve, f"{named}, component long, a_id long, b_id long, cost double")
    found = found.unionByName(by_part.drop("component"))
    if large is not None:
        found = found.unionByName(_auction(large, [*keys, "component"], resolution).drop("component"))
    return found
