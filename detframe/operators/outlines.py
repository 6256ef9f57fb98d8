"""Outlines of masks: runs to polygon rings.

A mask's boundary is the difference of neighbouring pixel columns and the ends of its runs. Every boundary edge points
so that the mask lies to its right; at each corner the edge that ends meets the one that starts. Rings are found by pointer doubling:
every edge looks twice as far along its ring each round. Masks of up to a limit of pixel columns are traced by many in one pass over sorted
partitions; for larger ones the same steps are joins on pixel corners, so a ring of n corners takes log n joins and no mask is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions.arrays import islands, repeated
from detframe.operators.segments import columns_of, subtract_runs, union_runs
from detframe.plans.grouped import GROUP_LIMIT, scan_blocks, split_by_size
from detframe.session import cut_lineage

#: Pixel columns of the masks that are traced at once.
TRACED_COLUMNS = 200_000


def boundary_edges(runs: DataFrame, by: Sequence[str], height: str = "height") -> DataFrame:
    """``by.., x0, y0, x1, y1``: directed boundary edges with the mask to their right (y points down).

    Horizontal edges at one height that continue each other are one edge where no vertical edge meets them.
    """
    by = list(by)
    merged = union_runs(runs, [*by, height]) if height not in by else union_runs(runs, by)
    cut = columns_of(merged, height).select(*by, F.floor(F.col("start") / F.col(height)).alias("_x"), (F.col("start") % F.col(height)).alias("start"), "length")
    cut = cut_lineage(cut)
    here, before = cut, cut.withColumn("_x", F.col("_x") + 1)  # a column and its left neighbour, at the border between them
    side = [*by, "_x"]
    end = F.col("start") + F.col("length")
    up = subtract_runs(here, before, side).select(*by, F.col("_x").alias("x0"), end.alias("y0"), F.col("_x").alias("x1"), F.col("start").alias("y1"))
    down = subtract_runs(before, here, side).select(*by, F.col("_x").alias("x0"), F.col("start").alias("y0"), F.col("_x").alias("x1"), end.alias("y1"))
    vertical = cut_lineage(up.unionByName(down))
    level = cut.select(*by, "_x", F.explode(F.array(F.struct(F.col("start").alias("y"), F.lit(1).alias("d")), F.struct(end.alias("y"), F.lit(-1).alias("d")))).alias("e")).select(*by, "_x", "e.*")
    met = vertical.select(*by, F.explode(F.array(F.struct(F.col("x0").alias("_x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("_x"), F.col("y1").alias("y")))).alias("p")).select(*by, "p.*").distinct()
    row = Window.partitionBy(*by, "y", "d").orderBy("_x")
    broken = level.join(met.withColumn("_met", F.lit(1)), [*by, "_x", "y"], "left")
    starts = broken.withColumn("_new", F.when(F.col("_met").isNotNull() | (F.coalesce(F.lag("_x").over(row) + 1, F.lit(-1)) != F.col("_x")), 1).otherwise(0))
    pieces = (starts.withColumn("_i", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .groupBy(*by, "y", "d", "_i").agg(F.min("_x").alias("a"), (F.max("_x") + 1).alias("b")))
    right = F.col("d") > 0
    horizontal = pieces.select(*by, F.when(right, F.col("a")).otherwise(F.col("b")).alias("x0"), F.col("y").alias("y0"),
                               F.when(right, F.col("b")).otherwise(F.col("a")).alias("x1"), F.col("y").alias("y1"))
    return vertical.unionByName(horizontal)


def _doubled(table: DataFrame, keys: Sequence[str], step) -> DataFrame:
    """Rounds of ``step(self joined with what ``_to`` points at)`` until no row reports ``_more``."""
    while True:
        ahead = table.select(*keys, F.col("_e").alias("_to"), *[F.col(c).alias(f"_ahead{c}") for c in table.columns if c not in (*keys, "_e")])
        table = cut_lineage(step(table.join(ahead, [*keys, "_to"], "left")))
        if not table.where("_more").limit(1).count():
            return table.drop("_more")
        table = table.drop("_more")


def outline_rings(runs: DataFrame, by: Sequence[str], height: str = "height", limit: int = GROUP_LIMIT) -> DataFrame:
    """``by.., ring, nth, x, y``: corners of the mask's rings, clockwise around the mask and counter-clockwise around holes.

    A ring is named by its least corner number within the mask and starts there. Pixels that touch at a corner only are in different
    rings. Filling all rings by the even-odd rule at pixel centres gives the mask back. Masks of more than ``limit`` pixel columns go
    through joins.
    """
    by = list(by)
    kinds = dict(runs.dtypes)
    rows = runs.where("length > 0").dropna(subset=[*by, "start", height]).select(*by, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
                                                                             F.col(height).cast("long").alias(height))
    h, end = F.col(height), F.col("start") + F.col("length") - 1
    small, large = split_by_size(rows, by, limit, F.floor(end / h) - F.floor(F.col("start") / h) + 1)

    def trace(arrays, cuts):
        mask = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        start, end, high = arrays["start"], arrays["start"] + arrays["length"], arrays[height]
        columns = np.add.reduceat((end - 1) // high - start // high + 1, cuts[:-1])
        part = np.cumsum(columns) // TRACED_COLUMNS
        found = []
        for lot in np.split(np.arange(len(columns)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            at = slice(cuts[lot[0]], cuts[lot[-1] + 1])
            owner, *cells = _traced(mask[at] - lot[0], start[at], end[at], high[at])
            found.append((owner + lot[0], *cells))
        owner, *cells = (np.concatenate(x) for x in zip(*found))
        return {c: arrays[c][cuts[:-1]][owner] for c in by} | dict(zip(("ring", "nth", "x", "y"), cells))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", ring long, nth long, x long, y long"
    traced = scan_blocks(small, by, ["start"], trace, schema)
    return traced if large is None else traced.unionByName(_joined_rings(large, by, height))


def _traced(mask: np.ndarray, start: np.ndarray, end: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mask, ring, nth, x, y) of the corners of masks that are numbered from 0; edges as in :func:`boundary_edges`."""
    tall, kind = np.unique(height, return_inverse=True)
    group, start, end = islands(mask * len(tall) + kind, start, end)
    mask, height = group // len(tall), tall[group % len(tall)]
    row, place = repeated((end - 1) // height - start // height + 1)
    mask, height = mask[row], height[row]
    x = start[row] // height + place
    top, bottom = np.maximum(start[row] - x * height, 0), np.minimum(end[row] - x * height, height)
    # borders between columns: what begins and ends to the right (here) and to the left of them
    two, one = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
    g, bx = np.tile(mask, 4), np.r_[x, x, x + 1, x + 1]
    by_, here, before = np.r_[top, bottom, top, bottom], np.r_[two, -two, one, one], np.r_[one, one, two, -two]
    order = np.lexsort((by_, bx, g))
    g, bx, by_ = g[order], bx[order], by_[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (bx[1:] != bx[:-1]) | (by_[1:] != by_[:-1])])
    here, before = np.add.reduceat(here[order], first), np.add.reduceat(before[order], first)
    moved = (here != 0) | (before != 0)
    first, here, before = first[moved], np.cumsum(here[moved]), np.cumsum(before[moved])
    g, bx, by_ = g[first], bx[first], by_[first]
    after = np.r_[by_[1:], 0]  # the last point of a border closes all
    up, down = (here > 0) & (before == 0), (before > 0) & (here == 0)
    vertical = [(g[up], bx[up], after[up], bx[up], by_[up]), (g[down], bx[down], by_[down], bx[down], after[down])]
    vg, vx, v0, _, v1 = (np.concatenate(c) for c in zip(*vertical))
    # tops run right, bottoms run left; those in a row are one edge where no vertical edge meets them
    lg, lx, ly, right = np.r_[mask, mask], np.r_[x, x], np.r_[top, bottom], np.r_[two, one]
    order = np.lexsort((lx, right, ly, lg))
    lg, lx, ly, right = lg[order], lx[order], ly[order], right[order]
    corner = _Corners(np.r_[vx, lx, lx + 1], np.r_[v0, v1, ly])
    met = np.isin(corner.key(lg, lx, ly), np.r_[corner.key(vg, vx, v0), corner.key(vg, vx, v1)])
    new = np.flatnonzero(np.r_[True, (lg[1:] != lg[:-1]) | (ly[1:] != ly[:-1]) | (right[1:] != right[:-1]) | (lx[1:] != lx[:-1] + 1)] | met)
    a, b = lx[new], lx[np.r_[new[1:], len(lx)] - 1] + 1
    lg, ly, right = lg[new], ly[new], right[new] == 1
    g, x0, y0 = np.r_[vg, lg], np.r_[vx, np.where(right, a, b)], np.r_[v0, ly]
    x1, y1 = np.r_[vx, np.where(right, b, a)], np.r_[v1, ly]
    order = np.lexsort((y1, x1, y0, x0, g))
    g, x0, y0, x1, y1 = (c[order] for c in (g, x0, y0, x1, y1))
    # edges stand by their starts now: one or two leave a corner, where two rings touch the right turn keeps them apart
    leave, arrive = corner.key(g, x0, y0), corner.key(g, x1, y1)
    to = np.searchsorted(leave, arrive)
    other = np.minimum(to + 1, len(g) - 1)
    dx, dy = np.sign(x1 - x0), np.sign(y1 - y0)
    to = np.where((leave[other] == arrive) & (dx[other] == -dy) & (dy[other] == dx), other, to)
    ring, ahead = np.minimum(np.arange(len(g)), to), to
    while (ring[ahead] != ring).any():
        ring, ahead = np.minimum(ring, ring[ahead]), ahead[ahead]
    # steps to the ring's last edge, behind which a row of zeros stands for the end
    ahead, steps = np.r_[np.where(to == ring, len(g), to), len(g)], np.r_[to != ring, False].astype(np.int64)
    while (ahead < len(g)).any():
        steps, ahead = steps + steps[ahead], ahead[ahead]
    number = np.arange(len(g)) - np.searchsorted(g, g) + 1
    return g, number[ring], steps[ring] - steps[:-1], x0, y0


class _Corners:
    """Whole numbers for corners of masks, in order of mask, x and y; places are counted, so that any image fits."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray):
        self.xs, self.ys = np.unique(xs), np.unique(ys)

    def key(self, mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (mask * len(self.xs) + np.searchsorted(self.xs, x)) * len(self.ys) + np.searchsorted(self.ys, y)


def _joined_rings(runs: DataFrame, by: Sequence[str], height: str) -> DataFrame:
    """:func:`outline_rings` by joins, for masks too large for one task."""
    by = list(by)
    edges = boundary_edges(runs, by, height)
    number = Window.partitionBy(*by).orderBy("x0", "y0", "x1", "y1")
    edges = cut_lineage(edges.withColumn("_e", F.row_number().over(number).cast("long")))
    dx, dy = F.signum(F.col("x1") - F.col("x0")), F.signum(F.col("y1") - F.col("y0"))
    ends = edges.select(*by, "_e", F.col("x1").alias("_px"), F.col("y1").alias("_py"), dx.alias("_dx"), dy.alias("_dy"))
    starts = edges.select(*by, F.col("_e").alias("_to"), F.col("x0").alias("_px"), F.col("y0").alias("_py"), dx.alias("_ox"), dy.alias("_oy"))
    # Where two rings touch, the right turn keeps them apart.
    turn = ((F.col("_ox") == -F.col("_dy")) & (F.col("_oy") == F.col("_dx"))).cast("int")
    choice = Window.partitionBy(*by, "_e").orderBy(turn.desc())
    follow = cut_lineage(ends.join(starts, [*by, "_px", "_py"]).withColumn("_r", F.row_number().over(choice)).where("_r = 1").select(*by, "_e", "_to"))

    # The least number on the way; done when nothing smaller lies twice as far ahead.
    def least(t: DataFrame) -> DataFrame:
        return t.select(*by, "_e", F.col("_ahead_to").alias("_to"), F.least("_m", "_ahead_m").alias("_m"), (F.col("_ahead_m") != F.col("_m")).alias("_more"))
    rings = _doubled(follow.withColumn("_m", F.least("_e", "_to")), by, least).select(*by, "_e", F.col("_m").alias("ring"))

    # Steps to the ring's last edge, whose successor is cut off.
    def steps(t: DataFrame) -> DataFrame:
        return t.select(*by, "_e", F.col("_ahead_to").alias("_to"), (F.col("_d") + F.coalesce("_ahead_d", F.lit(0))).alias("_d"), F.col("_ahead_to").isNotNull().alias("_more"))
    opened = follow.join(rings, [*by, "_e"]).select(*by, "_e", F.when(F.col("_to") != F.col("ring"), F.col("_to")).alias("_to"))
    ranked = _doubled(opened.withColumn("_d", F.when(F.col("_to").isNotNull(), 1).otherwise(0).cast("long")), by, steps).select(*by, "_e", "_d")
    ringed = Window.partitionBy(*by, "ring")
    return (edges.join(rings, [*by, "_e"]).join(ranked, [*by, "_e"]).withColumn("nth", F.max("_d").over(ringed) - F.col("_d"))
            .select(*by, "ring", "nth", F.col("x0").alias("x"), F.col("y0").alias("y")))


def ring_measures(rings: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by.., rings, corners, area, perimeter`` of each mask; holes have negative area."""
    by = list(by)
    rings = rings.repartition(*by)  # serves the windows over rings and the sums over masks
    order = Window.partitionBy(*by, "ring").orderBy("nth")
    whole = Window.partitionBy(*by, "ring").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(order), F.first("x").over(whole)), F.coalesce(F.lead("y").over(order), F.first("y").over(whole))
    sides = rings.select(*by, "nth", (F.col("x") * ny - nx * F.col("y")).alias("_a"), (F.abs(nx - F.col("x")) + F.abs(ny - F.col("y"))).alias("_p"))
    return sides.groupBy(*by).agg(F.count_if(F.col("nth") == 0).alias("rings"), F.count(F.lit(1)).alias("corners"),
                                  (F.sum("_a") / 2).cast("long").alias("area"), F.sum("_p").cast("long").alias("perimeter"))
