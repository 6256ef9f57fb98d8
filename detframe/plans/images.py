"""Rules over the boxes of an image, worked out where the image lies.

Boxes and detections of an image meet in numpy instead of in a join, so no list of pairs is shuffled or sorted. Images with more rows
than a limit, and images with a NULL or no number in a column that the rule reads, are handed back for the joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.functions.arrays import repeated
from detframe.plans.grouped import Arrays, scan_blocks

#: Rows of an image up to which its boxes meet in one piece.
IMAGE_ROWS = 2000
#: Pairs that are measured at once.
PAIRS = 1 << 18


def split_images(det: DataFrame, gt: DataFrame, keys: Sequence[str], reads: Sequence[str],
                 limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of ordinary images, of up to ``limit`` rows (detections, boxes), and those of the other images, or None when there are none.

    ``reads`` names the columns of both sides that must be there and be numbers where they are floating.
    """
    keys = list(keys)

    def counted(df: DataFrame) -> DataFrame:
        holes = F.lit(False)
        for c in reads:
            if c in df.columns and c not in keys:
                holes = holes | F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(holes).alias("_holes"))

    nowhere = F.lit(False)
    for c in keys:
        nowhere = nowhere | F.col(c).isNull()
    sizes = counted(det).unionByName(counted(gt)).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_holes").alias("_holes"))
    other = sizes.where((F.col("_n") > (IMAGE_ROWS if limit is None else limit)) | F.col("_holes") | nowhere).select(*keys)
    if other.limit(1).count() == 0:
        return det, gt, None, None
    # at most total rows / limit keys, and those with holes
    out = [df.where(~nowhere).join(other, keys, "left_anti") for df in (det, gt)]
    rest = [df.join(other, keys, "left_semi").unionByName(df.where(nowhere)) for df in (det, gt)]
    return *out, *rest


def scan_images(det: DataFrame, gt: DataFrame, keys: Sequence[str], order: Sequence[str],
                fn: Callable[[Arrays, Arrays, np.ndarray, np.ndarray], Arrays | None], schema: str, alone: bool = False) -> DataFrame:
    """Apply ``fn(detections, boxes, image of each detection, image of each box)`` to many whole images at once.

    Images are numbered from 0 and in order, detections of an image stand in ``order``. ``fn`` returns every column of ``schema``;
    blocks without any detection are left out unless boxes may stand ``alone``.
    """
    kinds = dict(gt.dtypes) | dict(det.dtypes)
    sides = [df.select(F.lit(side).alias("_side"), *[F.col(c) if c in df.columns else F.lit(0).cast(t).alias(c) for c, t in kinds.items()])
             for side, df in enumerate((det, gt))]

    names = [det.columns, gt.columns]

    def run(rows: Arrays, cuts: np.ndarray) -> Arrays | None:
        image, first = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), rows["_side"] == 0
        if not alone and not first.any():
            return None
        d, g = ({c: rows[c][at] for c in columns} for columns, at in zip(names, (first, ~first)))
        return fn(d, g, image[first], image[~first])

    return scan_blocks(sides[0].unionByName(sides[1]), keys, ["_side", *order], run, schema, lying=True)


def touching(d: Arrays, g: Arrays, at: np.ndarray, to: np.ndarray, plus: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(detection, box, area in common) of the pairs of one group that intersect, some groups' pairs at a time, by detection.

    ``at`` and ``to`` are the groups of detections and boxes; a negative one meets nobody.
    """
    order = np.argsort(to, kind="stable")
    sorted_to = to[order]
    low = np.searchsorted(sorted_to, at, side="left")
    counts = np.where(at < 0, 0, np.searchsorted(sorted_to, at, side="right") - low)
    part = np.cumsum(counts) // PAIRS
    for rows in np.split(np.arange(len(at)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(at) else ():
        row, place = repeated(counts[rows])
        i = rows[row]
        j = order[low[i] + place]
        w = np.minimum(d["x2"][i], g["x2"][j]) - np.maximum(d["x1"][i], g["x1"][j]) + plus
        near = np.flatnonzero(w > 0)
        i, j, w = i[near], j[near], w[near]
        h = np.minimum(d["y2"][i], g["y2"][j]) - np.maximum(d["y1"][i], g["y1"][j]) + plus
        inter = w * np.maximum(h, 0.0)
        near = np.flatnonzero(inter > 0)
        yield i[near], j[near], inter[near]


def sizes_of(boxes: Arrays, plus: float = 0.0) -> np.ndarray:
    return (boxes["x2"] - boxes["x1"] + plus) * (boxes["y2"] - boxes["y1"] + plus)


def overlaps(d: Arrays, g: Arrays, at: np.ndarray, to: np.ndarray, plus: float = 0.0, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detection, box, IoU) of the pairs of one group that intersect, with an IoU of at least ``least``."""
    a, b, found = sizes_of(d, plus), sizes_of(g, plus), []
    for i, j, inter in touching(d, g, at, to, plus):
        iou = inter / np.maximum(a[i] + b[j] - inter, 1e-6)
        keep = iou >= least
        found.append((i[keep], j[keep], iou[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def joint_codes(*pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One number per combination of values, for the left and the right side of each pair of columns."""
    left, right = (np.zeros(len(pairs[0][s]), np.int64) for s in (0, 1))
    for a, b in pairs:
        _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        width = int(codes.max(initial=0)) + 1
        left, right = left * width + codes[:len(a)], right * width + codes[len(a):]
    return left, right
