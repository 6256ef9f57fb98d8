"""Overlap joins: pairs of boxes of one image (and class) that intersect.

A plain equi-join on the image compares every pair of an image. Here each box is also keyed by the grid
tiles it touches, so only neighbours meet, and a pair is kept in one tile only (the one that holds the
top-left corner of the intersection), which needs no ``distinct``. An image with very many boxes is thus
spread over its tiles, and adaptive execution splits what is still skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.functions import boxes as B

TILE = 512.0


#: All that lies more tiles than this from the origin counts to the last tile, so a box of any extent touches a bounded number.
FAR_TILES = 100


def _tile_of(value: Column, tile: float) -> Column:
    """Number of the tile that holds ``value``; it never falls as values rise."""
    return F.floor(F.greatest(F.least(value / F.lit(tile), F.lit(float(FAR_TILES))), F.lit(-float(FAR_TILES))))


def _tiles(low: Column, high: Column, tile: float) -> Column:
    return F.sequence(_tile_of(low, tile), _tile_of(high, tile))


def _tiled(df: DataFrame, tile: float, grow: float) -> DataFrame:
    g = F.lit(grow)
    return (df.withColumn("_tx", F.explode(_tiles(F.col("x1"), F.col("x2") + g, tile)))
            .withColumn("_ty", F.explode(_tiles(F.col("y1"), F.col("y2") + g, tile))))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def overlap_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], left: str = "a_", right: str = "b_",
                  mode: str = "iou", legacy: bool = False, min_overlap: float = 0.0, tile: float = TILE,
                  name: str = "iou") -> DataFrame:
    """All pairs with overlap > 0 and ``>= min_overlap``; columns keep their names under a prefix.

    ``min_overlap`` must not be negative: pairs that do not touch are never produced.
    """
    grow = 1.0 if legacy else 0.0
    keys = [*on, "_tx", "_ty"]
    pairs = (prefixed(_tiled(a, tile, grow), left, keys)
             .join(prefixed(_tiled(b, tile, grow), right, keys), keys, "inner"))
    pa, pb = B.box(left), B.box(right)
    touching = (B.intersection(pa, pb, grow) > 0) & (
        (_tile_of(F.greatest(pa[0], pb[0]), tile) == F.col("_tx"))
        & (_tile_of(F.greatest(pa[1], pb[1]), tile) == F.col("_ty")))
    out = pairs.where(touching).drop("_tx", "_ty").withColumn(name, B.iou(pa, pb, mode, legacy=legacy))
    return out.where(F.col(name) >= F.lit(float(min_overlap))) if min_overlap > 0 else out
