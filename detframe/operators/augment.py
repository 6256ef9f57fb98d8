"""Geometry-only augmentation of annotation tables.

Each operator maps boxes with Column expressions; random parameters are Columns hashed from (seed, image,
copy), so a table of any size is augmented in one narrow pass and comes out the same on every run.
Tables carry ``image_id, ann_id, x1..y2, width, height`` (size of the image the box lives in).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions import polygons as P
from detframe.functions.arrays import islands, repeated
from detframe.functions.hashing import hash_key, uniform
from detframe.operators.sampling import draw_partners
from detframe.plans.grouped import scan_blocks, split_by_size
from detframe.plans.once import once
from detframe.session import cut_lineage


def _with_box(df: DataFrame, box: B.Box) -> DataFrame:
    """Replace the box; all four values are computed before any is assigned."""
    return df.withColumns({c: v for c, v in zip(B.COORDS, box)})


def _span(seed: int, low: float, high: float, *keys: Column) -> Column:
    return F.lit(float(low)) + uniform(seed, *keys) * F.lit(float(high - low))


def clip_and_keep(df: DataFrame, min_ratio: float = 0.2, min_area: float = 10.0) -> DataFrame:
    """Clip to the image; keep boxes that retain enough of ``old_area`` and enough pixels."""
    clipped = _with_box(df, B.clip(B.box(), F.col("width"), F.col("height")))
    area = B.area(B.box())
    return clipped.where((area >= F.col("old_area") * F.lit(min_ratio)) & (area >= F.lit(min_area)))


def drop_outside(df: DataFrame, clip: bool = True) -> DataFrame:
    """Clip to the image and drop boxes that lie outside it."""
    inside = df.where(B.is_inside(B.box(), F.col("width"), F.col("height")))
    return _with_box(inside, B.clip(B.box(), F.col("width"), F.col("height"))) if clip else inside


def copies(images: DataFrame, k: int) -> DataFrame:
    """The original (``copy`` 0) and ``k`` copies, with new names: ``_orig`` and ``_aug1`` …"""
    out = images.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k))))
    tag = F.when(F.col("copy") == 0, F.lit("_orig")).otherwise(F.concat(F.lit("_aug"), F.col("copy")))
    return out.withColumn("file_name", F.regexp_replace("file_name", r"(\.[^.]*)?$", "")).withColumn("file_name", F.concat("file_name", tag))


def random_flip(df: DataFrame, probs: dict[str, float], seed: int, keys: Sequence[str] = ("image_id",), polygon: str | None = None) -> DataFrame:
    """Flip per image in one of the given directions, or not at all; adds ``flip``. ``polygon`` names a column of flat polygons
    that is flipped with the boxes."""
    u = uniform(seed, *[F.col(k) for k in keys])
    bound, choice = 0.0, None
    for direction, p in probs.items():
        bound += p
        choice = F.when(u < bound, direction) if choice is None else choice.when(u < bound, direction)
    marked = df.withColumn("flip", choice)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    values = []
    for i, c in enumerate(B.COORDS):
        value = F.col(c)
        for direction in probs:
            value = F.when(F.col("flip") == direction, B.flip(B.box(), direction, w, h)[i]).otherwise(value)
        values.append(value)
    if polygon:
        shape = F.col(polygon)
        for direction in probs:
            shape = F.when(F.col("flip") == direction, P.flip(F.col(polygon), direction, w, h)).otherwise(shape)
        marked = marked.withColumn(polygon, shape)
    return _with_box(marked, tuple(values))


def random_rotate(df: DataFrame, max_degrees: float, seed: int, keys: Sequence[str] = ("image_id",), polygon: str | None = None) -> DataFrame:
    """Rotate about the image centre by an angle in ±max; boxes become hulls, clipped and filtered by what is left.
    Polygons turn by their vertices and are cut to the image."""
    angle = _span(seed, -max_degrees, max_degrees, *[F.col(k) for k in keys])
    ready = once(df, {"angle": angle}).withColumn("old_area", B.area(B.box()))
    if polygon:
        w, h = F.col("width").cast("double"), F.col("height").cast("double")
        c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
        turned = P.affine(F.col(polygon), [[c, -s, w / 2 - c * w / 2 + s * h / 2], [s, c, h / 2 - s * w / 2 - c * h / 2]])
        ready = ready.withColumn(polygon, turned).withColumn(polygon, P.crop(F.col(polygon), F.lit(0.0), F.lit(0.0), w, h))
    turned = _projected(ready, B.rotation_matrix(F.col("width") / 2.0, F.col("height") / 2.0, F.col("angle")))
    return clip_and_keep(turned).drop("old_area")


def random_crop(df: DataFrame, low: float, high: float, seed: int, keys: Sequence[str] = ("image_id",), polygon: str | None = None) -> DataFrame:
    """Crop a window of a random share of each side; boxes and polygons move to its origin, cut to it, and boxes are
    filtered by what is left."""
    k = [F.col(c) for c in keys]
    cw = F.floor(F.col("width") * _span(seed, low, high, *k))
    ch = F.floor(F.col("height") * _span(seed + 1, low, high, *k))
    placed = (df.withColumn("old_area", B.area(B.box())).withColumn("_cw", cw).withColumn("_ch", ch)
              .withColumn("_ox", F.floor(uniform(seed + 2, *k) * (F.col("width") - F.col("_cw") + 1)))
              .withColumn("_oy", F.floor(uniform(seed + 3, *k) * (F.col("height") - F.col("_ch") + 1))))
    if polygon:
        left, top = F.col("_ox").cast("double"), F.col("_oy").cast("double")
        placed = placed.withColumn(polygon, P.crop(F.col(polygon), left, top, left + F.col("_cw"), top + F.col("_ch")))
    moved = _with_box(placed, B.translate(B.box(), -F.col("_ox"), -F.col("_oy")))
    sized = moved.withColumn("width", F.col("_cw").cast("long")).withColumn("height", F.col("_ch").cast("long"))
    return clip_and_keep(sized).drop("old_area", "_cw", "_ch", "_ox", "_oy")


def first_fit(images: DataFrame, trials: int, propose: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame],
              first: int = 2, growth: int = 4) -> DataFrame:
    """The window of the first fitting trial of each image that has one: ``image_id, trial`` and the window's columns.

    ``propose`` adds a window to rows ``(image, trial)`` and may drop some; ``judge`` keeps the fitting ones. Trials are taken in rounds
    that grow, and only images without a window go on, so few trials are judged where most images fit early.
    """
    left, found, low, size = images, None, 1, first
    while True:
        high = min(trials, low + size - 1)
        tried = judge(propose(left.withColumn("trial", F.explode(F.sequence(F.lit(low), F.lit(high))))))
        columns = [c for c in tried.columns if c not in ("image_id", "trial")]
        got = cut_lineage(tried.groupBy("image_id").agg(F.min(F.struct("trial", *columns)).alias("_w")).select("image_id", "_w.*"))
        found = got if found is None else found.unionByName(got)
        low, size = high + 1, size * growth
        if low > trials:
            return found
        left = cut_lineage(left.join(got, "image_id", "left_anti"))
        if left.isEmpty():
            return found


def min_iou_crop(df: DataFrame, images: DataFrame, min_ious: Sequence[float], seed: int, trials: int = 50,
                 min_size: float = 0.3) -> DataFrame:
    """First of ``trials`` random windows whose every box overlaps it enough; boxes with their centre inside stay.

    One of ``1, min_ious.., 0`` is drawn per image: 1 keeps the image whole. Trials are rows keyed by (image,
    trial), judged by one aggregation per round (``first_fit``); images where none fits stay whole.
    """
    i, t = F.col("image_id"), F.col("trial")
    modes = F.array(*[F.lit(float(v)) for v in (1.0, *min_ious, 0.0)])
    mode = F.element_at(modes, (hash_key(seed, i) % (len(min_ious) + 2) + 1).cast("int"))

    def windows(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("nw", F.col("width") * _span(seed + 1, min_size, 1.0, i, t))
                .withColumn("nh", F.col("height") * _span(seed + 2, min_size, 1.0, i, t))
                .where((F.col("nh") / F.col("nw")).between(0.5, 2.0))
                .withColumn("px", F.floor(uniform(seed + 3, i, t) * (F.col("width") - F.col("nw"))))
                .withColumn("py", F.floor(uniform(seed + 4, i, t) * (F.col("height") - F.col("nh"))))
                .select("image_id", "mode", "trial", "px", "py", F.floor(F.col("px") + F.col("nw")).alias("qx"),
                        F.floor(F.col("py") + F.col("nh")).alias("qy")))
    win = tuple(F.col(c).cast("double") for c in ("px", "py", "qx", "qy"))
    cx, cy = B.center(B.box())
    middle = (cx > win[0]) & (cy > win[1]) & (cx < win[2]) & (cy < win[3])

    def fitting(tried: DataFrame) -> DataFrame:
        judged = (df.select("image_id", *B.COORDS).join(tried, "image_id").groupBy("image_id", "trial", "mode", "px", "py", "qx", "qy")
                  .agg(F.min(B.iou(win, B.box())).alias("_low"), F.max(middle.cast("int")).alias("_any")))
        return judged.where("_low >= mode AND _any = 1").drop("_low", "_any", "mode")
    chosen = first_fit(images.withColumn("mode", mode).where("mode < 1"), trials, windows, fitting).drop("trial")
    placed = df.join(chosen, "image_id", "left")
    out = placed.where(F.col("px").isNull() | middle)
    x1, y1, x2, y2 = B.box()
    new = (F.greatest(x1, win[0]) - win[0], F.greatest(y1, win[1]) - win[1], F.least(x2, win[2]) - win[0], F.least(y2, win[3]) - win[1])
    whole = F.col("px").isNull()
    moved = out.withColumns({c: F.when(whole, F.col(c)).otherwise(v) for c, v in zip(B.COORDS, new)})
    return (moved.withColumn("width", F.when(whole, F.col("width")).otherwise(F.col("qx") - F.col("px")))
            .withColumn("height", F.when(whole, F.col("height")).otherwise(F.col("qy") - F.col("py"))).drop("px", "py", "qx", "qy"))


def expand(df: DataFrame, low: float, high: float, prob: float, seed: int) -> DataFrame:
    """Place the image at random inside a larger canvas."""
    i = F.col("image_id")
    ratio = F.when(uniform(seed, i) < prob, _span(seed + 1, low, high, i)).otherwise(F.lit(1.0))
    ready = df.withColumn("_r", ratio)
    ready = (ready.withColumn("_ox", F.floor(uniform(seed + 2, i) * (F.col("width") * F.col("_r") - F.col("width"))))
             .withColumn("_oy", F.floor(uniform(seed + 3, i) * (F.col("height") * F.col("_r") - F.col("height")))))
    moved = _with_box(ready, B.translate(B.box(), F.col("_ox"), F.col("_oy")))
    return (moved.withColumn("width", F.floor(F.col("width") * F.col("_r"))).withColumn("height", F.floor(F.col("height") * F.col("_r")))
            .drop("_r", "_ox", "_oy"))


def random_shift(df: DataFrame, prob: float, max_px: int, min_side: float, seed: int) -> DataFrame:
    """Move the content; boxes are clipped and those with a side not above ``min_side`` are dropped."""
    i = F.col("image_id")
    on = uniform(seed, i) < prob
    dx = F.when(on, hash_key(seed + 1, i) % (2 * max_px) - max_px).otherwise(0)
    dy = F.when(on, hash_key(seed + 2, i) % (2 * max_px) - max_px).otherwise(0)
    moved = _with_box(df, B.translate(B.box(), dx.cast("double"), dy.cast("double")))
    clipped = _with_box(moved, B.clip(B.box(), F.col("width"), F.col("height")))
    return clipped.where((B.width(B.box()) > min_side) & (B.height(B.box()) > min_side))


def pad(df: DataFrame, divisor: int | None = None, square: bool = False) -> DataFrame:
    """Boxes stay; the image grows to a square or to a multiple of ``divisor``."""
    out = df
    if square:
        side = F.greatest("width", "height")
        out = out.withColumns({"width": side, "height": side})
    if divisor:
        out = out.withColumns({c: (F.ceil(F.col(c) / divisor) * divisor).cast("long") for c in ("width", "height")})
    return out


def resize(df: DataFrame, target_w: int, target_h: int, keep_ratio: bool = True) -> DataFrame:
    """Scale to fit (long edge to the larger, short edge to the smaller target) or to the exact size; ``area`` follows."""
    w, h = F.col("width"), F.col("height")
    if keep_ratio:
        s = F.least(F.lit(float(max(target_w, target_h))) / F.greatest(w, h), F.lit(float(min(target_w, target_h))) / F.least(w, h))
        nw, nh = F.floor(w * s + 0.5), F.floor(h * s + 0.5)
    else:
        nw, nh = F.lit(target_w).cast("long"), F.lit(target_h).cast("long")
    ready = df.withColumn("_nw", nw.cast("long")).withColumn("_nh", nh.cast("long")).withColumn("sx", F.col("_nw") / w).withColumn("sy", F.col("_nh") / h)
    scaled = _with_box(ready, B.rescale(B.box(), F.col("sx"), F.col("sy")))
    if "area" in df.columns:
        scaled = scaled.withColumn("area", F.col("area") * F.col("sx") * F.col("sy"))
    return scaled.withColumn("width", F.col("_nw")).withColumn("height", F.col("_nh")).drop("_nw", "_nh", "sx", "sy")


def resize_shortest(df: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Scale the short edge to ``shortest`` unless the long edge would exceed ``longest``."""
    w, h = F.col("width"), F.col("height")
    s = F.least(F.lit(float(shortest)) / F.least(w, h), F.lit(float(longest)) / F.greatest(w, h))
    ready = df.withColumn("_s", s)
    scaled = _with_box(ready, B.rescale(B.box(), F.col("_s"), F.col("_s")))
    return (scaled.withColumn("width", F.floor(F.col("width") * F.col("_s") + 0.5)).withColumn("height", F.floor(F.col("height") * F.col("_s") + 0.5)).drop("_s"))


def _projected(df: DataFrame, matrix: B.Matrix) -> DataFrame:
    """Boxes under a 3x3 map. Entries that vary are computed once per row, so that corners, filters and clips do not repeat them."""
    varying = {f"_m{r}{c}": v for r, row in enumerate(matrix) for c, v in enumerate(row) if isinstance(v, Column)}
    held = [[F.col(f"_m{r}{c}") if isinstance(v, Column) else v for c, v in enumerate(row)] for r, row in enumerate(matrix)]
    return _with_box(once(df, varying) if varying else df, B.project(B.box(), held)).drop(*varying)


def warp(df: DataFrame, matrix: B.Matrix) -> DataFrame:
    """Any 3x3 map, then clip and drop what leaves the image."""
    return drop_outside(_projected(df, matrix))


def shear(df: DataFrame, max_degrees: float, axis: str, seed: int) -> DataFrame:
    angle = _span(seed, -max_degrees, max_degrees, F.col("image_id"))
    return warp(df, B.shear_matrix(angle, 0.0) if axis == "x" else B.shear_matrix(0.0, angle))


def translate(df: DataFrame, max_share: float, axis: str, seed: int) -> DataFrame:
    share = _span(seed, -max_share, max_share, F.col("image_id"))
    return warp(df, B.shift_matrix(share * F.col("width"), 0.0) if axis == "x" else B.shift_matrix(0.0, share * F.col("height")))


def random_affine(df: DataFrame, degrees: float, shift: float, scale: tuple[float, float], shear_degrees: float, seed: int) -> DataFrame:
    """Translate · shear · rotate · scale with parameters drawn per image."""
    i = F.col("image_id")
    params = once(df, {
        "_a": _span(seed, -degrees, degrees, i), "_s": _span(seed + 1, scale[0], scale[1], i),
        "_kx": _span(seed + 2, -shear_degrees, shear_degrees, i), "_ky": _span(seed + 3, -shear_degrees, shear_degrees, i),
        "_tx": _span(seed + 4, -shift, shift, i) * F.col("width"), "_ty": _span(seed + 5, -shift, shift, i) * F.col("height")})
    m = B.matmul(B.matmul(B.shift_matrix(F.col("_tx"), F.col("_ty")), B.shear_matrix(F.col("_kx"), F.col("_ky"))),
                 B.matmul(B.rotation_matrix(0.0, 0.0, F.col("_a")), B.scale_matrix(F.col("_s"), F.col("_s"))))
    out = warp(params, [*m[:2], [0.0, 0.0, 1.0]])
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def mosaic(df: DataFrame, images: DataFrame, canvas: tuple[int, int], center: tuple[float, float], seed: int) -> DataFrame:
    """Four images on a canvas twice the size around a random centre: ``(mosaic_id, slot, ann_id, box)``.

    Slot 0 is the image itself, 1 to 3 its drawn partners (top left, top right, bottom left, bottom right).
    Each is scaled to fit one quarter and set against the centre; boxes are clipped to the canvas.
    """
    w, h = canvas
    i = F.col("mosaic_id")
    slots = images.select(F.col("image_id").alias("mosaic_id"), F.lit(0).alias("slot"), "image_id").unionByName(
        draw_partners(images, 3, seed).select(F.col("image_id").alias("mosaic_id"), "slot", F.col("partner_id").alias("image_id")))
    placed = (slots.withColumn("_cx", F.floor(_span(seed + 2, center[0], center[1], i) * w))
              .withColumn("_cy", F.floor(_span(seed + 3, center[0], center[1], i) * h)))
    both = placed.join(df, "image_id").withColumn("_s", F.least(F.lit(float(w)) / F.col("width"), F.lit(float(h)) / F.col("height")))
    sw, sh = F.floor(F.col("width") * F.col("_s") + 0.5), F.floor(F.col("height") * F.col("_s") + 0.5)
    left, top = F.col("slot").isin(0, 2), F.col("slot").isin(0, 1)
    ready = both.withColumn("_ox", F.when(left, F.col("_cx") - sw).otherwise(F.col("_cx"))).withColumn(
        "_oy", F.when(top, F.col("_cy") - sh).otherwise(F.col("_cy")))
    moved = _with_box(ready, B.translate(B.rescale(B.box(), F.col("_s"), F.col("_s")), F.col("_ox"), F.col("_oy")))
    sized = moved.withColumn("width", F.lit(2 * w)).withColumn("height", F.lit(2 * h))
    return drop_outside(sized).select("mosaic_id", F.col("slot").cast("long").alias("slot"), "ann_id", *B.COORDS)


def mixup(df: DataFrame, images: DataFrame, canvas: tuple[int, int], ratio: tuple[float, float], flip_prob: float, seed: int) -> DataFrame:
    """Boxes of the image plus those of one partner, scaled to the canvas, jittered, mirrored and cropped back."""
    w, h = canvas
    i = F.col("mix_id")
    pairs = draw_partners(images, 1, seed).select(F.col("image_id").alias("mix_id"), F.col("partner_id").alias("image_id"))
    size = images.select(F.col("image_id").alias("mix_id"), F.col("width").alias("ow"), F.col("height").alias("oh"))
    guest = pairs.join(size, "mix_id").join(df, "image_id")
    guest = (guest.withColumn("_s", F.least(F.lit(float(w)) / F.col("width"), F.lit(float(h)) / F.col("height")) * _span(seed + 2, ratio[0], ratio[1], i))
             .withColumn("_f", uniform(seed + 3, i) < flip_prob))
    full_w = F.col("width") * F.col("_s")
    scaled = B.rescale(B.box(), F.col("_s"), F.col("_s"))
    mirrored = (F.when(F.col("_f"), full_w - scaled[2]).otherwise(scaled[0]), scaled[1],
                F.when(F.col("_f"), full_w - scaled[0]).otherwise(scaled[2]), scaled[3])
    room_x = F.greatest(full_w - F.col("ow"), F.lit(0.0))
    room_y = F.greatest(F.col("height") * F.col("_s") - F.col("oh"), F.lit(0.0))
    offset = guest.withColumn("_ox", F.floor(uniform(seed + 4, i) * room_x)).withColumn("_oy", F.floor(uniform(seed + 5, i) * room_y))
    moved = _with_box(offset, B.translate(mirrored, -F.col("_ox"), -F.col("_oy")))
    kept = drop_outside(moved.withColumn("width", F.col("ow")).withColumn("height", F.col("oh")))
    own = df.select(F.col("image_id").alias("mix_id"), F.lit(0).alias("guest"), "ann_id", *B.COORDS)
    return own.unionByName(kept.select("mix_id", F.lit(1).alias("guest"), "ann_id", *B.COORDS))


def erase(df: DataFrame, patches: DataFrame, max_ratio: float) -> DataFrame:
    """Drop boxes of which at least ``max_ratio`` is erased; overlapping patches count twice, as published.

    ``patches(image_id, px1, py1, px2, py2)``.
    """
    patch = tuple(F.col(c) for c in ("px1", "py1", "px2", "py2"))
    lost = df.join(patches, "image_id").groupBy("ann_id").agg(F.sum(B.intersection(B.box(), patch)).alias("_lost"))
    return df.join(lost, "ann_id", "left").where(F.coalesce("_lost", F.lit(0.0)) / B.area(B.box()) < max_ratio).drop("_lost")


def random_patches(images: DataFrame, most: int, share: float, seed: int) -> DataFrame:
    """1 to ``most`` random patches per image of up to ``share`` of each side."""
    i, p = F.col("image_id"), F.col("patch")
    n = (hash_key(seed, i) % most + 1).cast("int")
    each = images.withColumn("patch", F.explode(F.sequence(F.lit(1), n)))
    sized = (each.withColumn("_w", F.floor(uniform(seed + 1, i, p) * share * F.col("width"))).withColumn("_h", F.floor(uniform(seed + 2, i, p) * share * F.col("height")))
             .withColumn("px1", F.floor(uniform(seed + 3, i, p) * (F.col("width") - F.col("_w"))).cast("double"))
             .withColumn("py1", F.floor(uniform(seed + 4, i, p) * (F.col("height") - F.col("_h"))).cast("double")))
    return sized.select("image_id", "patch", "px1", "py1", (F.col("px1") + F.col("_w")).alias("px2"), (F.col("py1") + F.col("_h")).alias("py2"))


def center_crop_pad(df: DataFrame, crop_w: int, crop_h: int, seed: int) -> DataFrame:
    """A window of fixed size around a random centre, padded where it leaves the image; boxes whose centre is inside stay."""
    i = F.col("image_id")
    ready = (df.withColumn("_x", F.floor(uniform(seed, i) * F.col("width")) - crop_w / 2.0)
             .withColumn("_y", F.floor(uniform(seed + 1, i) * F.col("height")) - crop_h / 2.0))
    moved = _with_box(ready, B.translate(B.box(), -F.col("_x"), -F.col("_y")))
    cx, cy = B.center(B.box())
    kept = moved.where((cx > 0) & (cy > 0) & (cx < crop_w) & (cy < crop_h)).withColumn("width", F.lit(crop_w)).withColumn("height", F.lit(crop_h))
    return _with_box(kept, B.clip(B.box(), F.lit(float(crop_w)), F.lit(float(crop_h)))).drop("_x", "_y")


def center_crop_search(df: DataFrame, images: DataFrame, crop_w: int, crop_h: int, seed: int, trials: int = 50) -> DataFrame:
    """``center_crop_pad`` around the first of ``trials`` random centres whose window holds the centre of a box; images
    without such a window stay as they are."""
    i, t = F.col("image_id"), F.col("trial")
    cx, cy = B.center(B.box())
    inside = (cx > F.col("_x")) & (cy > F.col("_y")) & (cx < F.col("_x") + crop_w) & (cy < F.col("_y") + crop_h)

    def windows(rows: DataFrame) -> DataFrame:
        return rows.select("image_id", "trial", (F.floor(uniform(seed, i, t) * F.col("width")) - crop_w / 2.0).alias("_x"),
                           (F.floor(uniform(seed + 1, i, t) * F.col("height")) - crop_h / 2.0).alias("_y"))

    def fitting(tried: DataFrame) -> DataFrame:
        return df.select("image_id", *B.COORDS).join(tried, "image_id").where(inside).select("image_id", "trial", "_x", "_y").distinct()
    placed = df.join(first_fit(images, trials, windows, fitting).drop("trial"), "image_id", "left")
    whole = F.col("_x").isNull()
    moved = B.clip(B.translate(B.box(), -F.col("_x"), -F.col("_y")), F.lit(float(crop_w)), F.lit(float(crop_h)))
    kept = placed.where(whole | inside)
    return (kept.withColumns({c: F.when(whole, F.col(c)).otherwise(v) for c, v in zip(B.COORDS, moved)})
            .withColumn("width", F.when(whole, F.col("width")).otherwise(crop_w)).withColumn("height", F.when(whole, F.col("height")).otherwise(crop_h)).drop("_x", "_y"))


#: Pixels of the blocks in which covered and pasted masks meet: a few columns, as their runs are one column or less.
MASK_BLOCK = 1024
#: Runs of the images whose masks are covered in one piece.
IMAGE_RUNS = 200_000


def copy_paste(df: DataFrame, runs: DataFrame, pasted: DataFrame, area_thr: float, by: Sequence[str] = ("image_id", "ann_id")) -> DataFrame:
    """What pasted masks leave of each object: ``(by.., area)`` for objects with more than ``area_thr`` pixels left.

    ``pasted(image_id, start, length)`` holds the pasted pixels of each image.
    """
    from detframe.operators.segments import run_overlaps, union_runs

    hidden = run_overlaps(runs, union_runs(pasted, ["image_id"]), [c for c in by if c != "image_id"], [], block=MASK_BLOCK).withColumnRenamed("n", "_h")
    whole = runs.groupBy(*by).agg(F.sum("length").alias("_a"))
    left = whole.join(hidden, list(by), "left").withColumn("area", F.col("_a") - F.coalesce("_h", F.lit(0)))
    return left.where(F.col("area") > area_thr).select(*by, "area")


def copy_paste_masks(masks: DataFrame, pasted: Column, area_thr: float, runs: Column | None = None, size: Column | None = None,
                     limit: int = IMAGE_RUNS) -> DataFrame:
    """:func:`copy_paste` of masks that are lists of runs: ``(image_id, ann_id, area)``.

    ``masks(image_id, ann_id, ..)`` has a mask per row and what ``runs`` reads, a Column of its ``array<struct<start, length>>``
    (default: the column ``runs``). Where ``pasted`` holds, the mask is pasted over the others of its image. Lists are worked out where
    the image lies, and no run becomes a row. ``size`` is the number of runs where that is known without the list. An image of more than ``limit`` runs goes through :func:`copy_paste`.
    """
    listed = F.col("runs") if runs is None else runs
    both = masks.withColumn("_kind", pasted.cast("int")).dropna(subset=["image_id", "ann_id", "_kind"])
    small, large = split_by_size(both, ["image_id"], limit, F.size(listed) if size is None else size)
    held = F.coalesce(listed, F.array().cast("array<struct<start: bigint, length: bigint>>"))

    def cover(arrays, cuts):
        image, n = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), len(arrays["kind"])
        own, _ = repeated(np.array([len(x) for x in arrays["start"]], np.int64))
        start, length = (np.concatenate(arrays[c]).astype(np.int64) for c in ("start", "length"))
        own, start, length = own[length > 0], start[length > 0], length[length > 0]
        order = np.lexsort((arrays["ann_id"], arrays["kind"], image))
        named = np.stack([image, arrays["kind"], np.unique(arrays["ann_id"], return_inverse=True)[1]])[:, order]
        first = np.r_[True, (named[:, 1:] != named[:, :-1]).any(axis=0)]
        mask = np.empty(n, np.int64)
        mask[order] = np.cumsum(first) - 1
        top = arrays["kind"][own] == 1
        # images behind each other: pixels that are covered before a place, over all images
        room = int(max((start + length).max(initial=0), 0)) - min(int(start.min(initial=0)), 0) + 1
        shift = image[own] * room
        _, above, below = islands(np.zeros(top.sum(), np.int64), (start + shift)[top], (start + length + shift)[top])
        total, low = np.r_[0, np.cumsum(below - above)], np.r_[0, above]

        def before(place):
            at = np.searchsorted(above, place, side="right")
            return np.where(at > 0, total[np.maximum(at - 1, 0)] + np.minimum(place - low[at], np.r_[0, below - above][at]), 0)
        place = (start + shift)[~top]
        left = length[~top] - (before(place + length[~top]) - before(place))
        area, some = (np.zeros(int(first.sum()), np.int64) for _ in range(2))
        np.add.at(area, mask[own[~top]], left)
        some[mask[own[~top]]] = 1
        rows = order[first]
        kept = (some > 0) & (arrays["kind"][rows] == 0) & (area > area_thr)
        return {"image_id": arrays["image_id"][rows][kept], "ann_id": arrays["ann_id"][rows][kept], "area": area[kept]}

    kinds = dict(masks.dtypes)
    late = [F.col("image_id"), F.col("ann_id"), F.col("_kind").alias("kind"), held["start"].alias("start"), held["length"].alias("length")]
    out = scan_blocks(small, ["image_id"], ["_kind", "ann_id"], cover, f"image_id {kinds['image_id']}, ann_id {kinds['ann_id']}, area long", late, lying=True)
    if large is None:
        return out
    rows = large.select("image_id", "ann_id", "_kind", F.explode(held).alias("_r")).select("image_id", "ann_id", "_kind", "_r.start", "_r.length")
    spread = copy_paste(None, rows.where("_kind = 0").drop("_kind"), rows.where("_kind = 1").select("image_id", "start", "length"), area_thr)
    return out.unionByName(spread)


def pasted_objects(masks: DataFrame, pasted: DataFrame, box_shift: float = 10.0, area_thr: float = 300.0, height: str = "height", runs: Column | None = None,
                   limit: int = IMAGE_RUNS) -> DataFrame:
    """Objects of images after others were pasted over them: ``image_id, ann_id, pasted, x1, y1, x2, y2, area``.

    ``masks`` and ``pasted`` have a mask per row: ``image_id, ann_id, height`` and what ``runs`` reads, a Column of its
    ``array<struct<start, length>>`` (default: the column ``runs``); the second already under the image they are pasted on. A covered object keeps what is
    left of its mask and the box of that; it stays if no side of its box moved by more than ``box_shift`` or if more than
    ``area_thr`` pixels are left, and goes if nothing is left. Pasted objects are whole.

    The lists are worked out behind the shuffle. An image of more than ``limit`` runs goes through joins, spread over its pixels.
    """
    listed = F.col("runs") if runs is None else runs
    both = masks.withColumn("_kind", F.lit(0)).unionByName(pasted.withColumn("_kind", F.lit(1)))
    both = both.dropna(subset=["image_id", "ann_id", height]).withColumns({"image_id": F.col("image_id").cast("long"), "ann_id": F.col("ann_id").cast("long")})
    small, large = split_by_size(both, ["image_id"], limit, F.size(listed))
    held = F.coalesce(listed, F.array().cast("array<struct<start: bigint, length: bigint>>"))

    def cover(arrays, cuts):
        image = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        parts = np.cumsum(np.add.reduceat(np.array([len(x) for x in arrays["start"]], np.int64), cuts[:-1])) // limit
        found = []
        for lot in np.split(np.arange(len(parts)), np.flatnonzero(parts[1:] != parts[:-1]) + 1):
            at = slice(cuts[lot[0]], cuts[lot[-1] + 1])
            found.append(_covered({c: v[at] for c, v in arrays.items()}, image[at] - lot[0], box_shift, area_thr))
        return {c: np.concatenate([f[c] for f in found]) for c in found[0]}

    schema = "image_id long, ann_id long, x1 long, y1 long, x2 long, y2 long, area long, pasted boolean"
    late = [F.col("image_id"), F.col("ann_id"), F.col("_kind").alias("kind"), F.col(height).cast("long").alias("height"), held["start"].alias("start"), held["length"].alias("length")]
    out = scan_blocks(small, ["image_id"], ["_kind", "ann_id"], cover, schema, late)
    if large is None:
        return out
    rows = large.select("image_id", "ann_id", "_kind", height, F.explode(held).alias("_r")).select("image_id", "ann_id", "_kind", height, "_r.start", "_r.length")
    spread = _joined_pasting(*[rows.where(F.col("_kind") == k).drop("_kind") for k in (0, 1)], box_shift, area_thr, height)
    return out.unionByName(spread.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "ann_id", *B.COORDS, "area")], "pasted"))


def _covered(rows: dict, image: np.ndarray, box_shift: float, area_thr: float) -> dict:
    """:func:`pasted_objects` of images that are numbered from 0."""
    own, _ = repeated(np.array([len(x) for x in rows["start"]], np.int64))
    start, length = (np.concatenate(rows[c]).astype(np.int64) for c in ("start", "length"))
    own, start, length = own[length > 0], start[length > 0], length[length > 0]
    # a mask is named by its first row; what a mask has on further rows belongs to it
    order = np.lexsort((rows["ann_id"], rows["kind"], image))
    name = np.stack([image, rows["kind"], rows["ann_id"]])[:, order]
    first = np.r_[True, (name[:, 1:] != name[:, :-1]).any(axis=0)]
    mask = np.empty(len(image), np.int64)
    mask[order] = np.cumsum(first) - 1
    image, kind, ann, image_id = (x[order][first] for x in (image, rows["kind"], rows["ann_id"], rows["image_id"]))
    own, high = mask[own], rows["height"].astype(np.int64)[own]
    n = len(image)

    def boxes(own, start, end, high) -> tuple[np.ndarray, ...]:
        box = [np.full(n, 2**62), np.full(n, 2**62), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)]
        x1, x2 = start // high, (end - 1) // high
        crosses = x1 != x2  # a run that crosses a column border touches the first and last row
        np.minimum.at(box[0], own, x1)
        np.minimum.at(box[1], own, np.where(crosses, 0, start % high))
        np.maximum.at(box[2], own, x2 + 1)
        np.maximum.at(box[3], own, np.where(crosses, high, (end - 1) % high + 1))
        np.add.at(box[4], own, end - start)
        return tuple(box)
    whole = boxes(own, start, start + length, high)
    tall = np.zeros(n, np.int64)
    if len(own):
        largest = np.zeros(image[-1] + 1, np.int64)
        real = kind[own] == 0
        np.maximum.at(largest, image[own[real]], high[real])
        tall = largest[image]
    top = kind[own] == 1
    over, above, below = islands(image[own[top]], start[top], start[top] + length[top])
    mine, a, b = islands(own[~top], start[~top], start[~top] + length[~top])
    # images behind each other: their covers stand in one row of runs
    room = max(int(max(np.max(b, initial=0), np.max(below, initial=0))), 0) + 1
    shift = image[mine] * room
    left = np.searchsorted(over * room + below, a + shift, side="right")
    right = np.searchsorted(over * room + above, b + shift, side="left")
    hit = right - left
    touched = np.zeros(n, bool)
    touched[mine[hit > 0]] = True
    run, place = repeated(hit + 1)
    at = left[run] + place
    low = np.where(place == 0, a[run], np.r_[0, below][at])
    end = np.where(place == hit[run], b[run], np.r_[above, 0][at])
    some = (end > low) & touched[mine[run]]
    rest = boxes(mine[run][some], low[some], end[some], tall[mine[run][some]])
    near = np.all([np.abs(x - y) <= box_shift for x, y in zip(rest[:4], whole[:4])], axis=0)
    kept = (whole[4] > 0) & ((kind == 1) | ~touched | (rest[4] > 0) & (near | (rest[4] > area_thr)))
    out = {c: np.where(touched, r, w)[kept] for c, r, w in zip((*B.COORDS, "area"), rest, whole)}
    return {"image_id": image_id[kept], "ann_id": ann[kept], **out, "pasted": kind[kept] == 1}


def _joined_pasting(runs: DataFrame, pasted: DataFrame, box_shift: float, area_thr: float, height: str) -> DataFrame:
    """:func:`pasted_objects` by joins of runs ``(image_id, ann_id, start, length, height)``, for images too large for one task."""
    from detframe.operators.segments import run_boxes, run_intersections, subtract_runs, union_runs

    by = ["image_id", "ann_id"]
    cover = union_runs(pasted, ["image_id"])
    hidden = run_intersections(runs, cover, ["ann_id"], block=MASK_BLOCK)
    touched = hidden.select(*by).distinct()
    whole = run_boxes(runs, by, height)
    rest = subtract_runs(runs.join(touched, by, "left_semi"), hidden, by)
    size = runs.groupBy("image_id").agg(F.max(height).alias(height))
    after = run_boxes(rest.join(size, "image_id"), by, height)
    before = whole.join(touched, by, "left_semi").select(*by, *[F.col(c).alias(f"_{c}") for c in B.COORDS])
    near = F.lit(True)
    for c in B.COORDS:
        near = near & (F.abs(F.col(c) - F.col(f"_{c}")) <= box_shift)
    columns = [*by, *B.COORDS, "area"]
    left = after.join(before, by).where(near | (F.col("area") > area_thr)).select(*columns)
    kept = whole.join(touched, by, "left_anti").select(*columns).unionByName(left).withColumn("pasted", F.lit(False))
    return kept.unionByName(run_boxes(pasted, by, height).select(*columns).withColumn("pasted", F.lit(True)))


def random_choice(df: DataFrame, policies: Sequence[Callable[[DataFrame], DataFrame]], seed: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Each image goes through one policy; adds ``policy``. Branches are narrow, so the union is one pass per policy."""
    weights = list(weights or [1.0] * len(policies))
    u, bound, choice = uniform(seed, F.col("image_id")), 1.0, F.lit(len(policies) - 1)
    for n in range(len(policies) - 2, -1, -1):
        bound = sum(weights[:n + 1]) / sum(weights)
        choice = F.when(u < bound, n).otherwise(choice)
    marked, out = df.withColumn("policy", choice), None
    for n, policy in enumerate(policies):
        part = policy(marked.where(F.col("policy") == n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def branches(df: DataFrame, named: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every image through every branch, tagged by ``branch``."""
    out = None
    for name, policy in named.items():
        part = policy(df).withColumn("branch", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def renumber(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-image running number of rows, for new annotation ids without a global sort."""
    return df.withColumn("new_index", F.row_number().over(Window.partitionBy("image_id", "copy").orderBy(*keys)) - 1)
