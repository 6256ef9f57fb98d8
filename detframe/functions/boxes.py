"""Box geometry as Column expressions on flat ``x1, y1, x2, y2`` columns.

Every function takes and returns Columns, so Catalyst can push, fold and compile them. A *box* argument
is a 4-tuple of Columns or a column-name prefix (``box("g_")`` gives ``g_x1..g_y2``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
COORDS = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in COORDS)  # type: ignore[return-value]


def named(values: Sequence[Column], prefix: str = "") -> list[Column]:
    return [v.alias(f"{prefix}{c}") for v, c in zip(values, COORDS)]


def _d(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# ---- representations -------------------------------------------------------------------------------

def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def xyxy_to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def cxcywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5


def xyxy_to_cxcywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def xyxy_to_cxcyah(b: Box) -> Box:
    """Centre, aspect ratio w/h and height: the state used by the motion filter."""
    w, h = b[2] - b[0], b[3] - b[1]
    return b[0] + w / 2, b[1] + h / 2, w / h, h


def cxcyah_to_xyxy(cx: Column, cy: Column, ratio: Column, h: Column) -> Box:
    w = ratio * h
    return cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0


CONVERTERS = {
    ("xywh", "xyxy"): lambda b: xywh_to_xyxy(*b),
    ("xyxy", "xywh"): xyxy_to_xywh,
    ("cxcywh", "xyxy"): lambda b: cxcywh_to_xyxy(*b),
    ("xyxy", "cxcywh"): xyxy_to_cxcywh,
    ("cxcyah", "xyxy"): lambda b: cxcyah_to_xyxy(*b),
    ("xyxy", "cxcyah"): xyxy_to_cxcyah,
}


def convert(b: Box, source: str, target: str) -> Box:
    """Convert between registered representations, through xyxy when there is no direct converter."""
    if source == target:
        return b
    if (source, target) in CONVERTERS:
        return CONVERTERS[(source, target)](b)
    return CONVERTERS[("xyxy", target)](CONVERTERS[(source, "xyxy")](b))


# ---- measures --------------------------------------------------------------------------------------

def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def intersection(a: Box, b: Box, plus: float = 0.0) -> Column:
    zero = F.lit(0.0)
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + F.lit(float(plus))
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + F.lit(float(plus))
    return F.greatest(w, zero) * F.greatest(h, zero)


def _plus_area(b: Box, plus: float) -> Column:
    return (width(b) + F.lit(float(plus))) * (height(b) + F.lit(float(plus)))


def iou(a: Box, b: Box, mode: str = "iou", eps: float = 1e-6, legacy: bool = False) -> Column:
    """IoU, IoF (over the area of ``a``) or GIoU; the denominator is floored at ``eps``.

    ``legacy`` counts both edges of a box as inside it (widths are x2 - x1 + 1).
    """
    plus = 1.0 if legacy else 0.0
    inter = intersection(a, b, plus)
    if mode == "iof":
        return inter / F.greatest(_plus_area(a, plus), F.lit(eps))
    union = F.greatest(_plus_area(a, plus) + _plus_area(b, plus) - inter, F.lit(eps))
    if mode == "iou":
        return inter / union
    if mode != "giou":
        raise ValueError(f"unknown overlap mode {mode}")
    hull_w = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    hull_h = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    hull = F.greatest(F.greatest(hull_w, F.lit(0.0)) * F.greatest(hull_h, F.lit(0.0)), F.lit(eps))
    return inter / union - (hull - union) / hull


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


# ---- moves -----------------------------------------------------------------------------------------

def flip(b: Box, direction: str, w: Column, h: Column) -> Box:
    x1, y1, x2, y2 = b
    if direction in ("horizontal", "diagonal"):
        x1, x2 = w - b[2], w - b[0]
    if direction in ("vertical", "diagonal"):
        y1, y2 = h - b[3], h - b[1]
    if direction not in ("horizontal", "vertical", "diagonal"):
        raise ValueError(f"unknown flip direction {direction}")
    return x1, y1, x2, y2


def translate(b: Box, dx: float | Column, dy: float | Column) -> Box:
    return b[0] + _d(dx), b[1] + _d(dy), b[2] + _d(dx), b[3] + _d(dy)


def clip(b: Box, w: float | Column, h: float | Column) -> Box:
    def bounded(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    return bounded(b[0], _d(w)), bounded(b[1], _d(h)), bounded(b[2], _d(w)), bounded(b[3], _d(h))


def rescale(b: Box, sx: float | Column, sy: float | Column) -> Box:
    return b[0] * _d(sx), b[1] * _d(sy), b[2] * _d(sx), b[3] * _d(sy)


def resize_about_center(b: Box, sx: float | Column, sy: float | Column) -> Box:
    cx, cy = center(b)
    w, h = width(b) * _d(sx), height(b) * _d(sy)
    return cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5


Matrix = Sequence[Sequence[float | Column]]


def project(b: Box, matrix: Matrix) -> Box:
    """Axis-aligned hull of the four corners after a 3x3 projective map (entries: numbers or Columns)."""
    m = [[_d(v) for v in row] for row in matrix]
    xs, ys = [], []
    for x, y in ((b[0], b[1]), (b[2], b[1]), (b[0], b[3]), (b[2], b[3])):
        scale = m[2][0] * x + m[2][1] * y + m[2][2]
        xs.append((m[0][0] * x + m[0][1] * y + m[0][2]) / scale)
        ys.append((m[1][0] * x + m[1][1] * y + m[1][2]) / scale)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def rotation_matrix(cx: float | Column, cy: float | Column, degrees: float | Column) -> list[list[Column]]:
    """Rotation by ``degrees`` about (cx, cy) in image axes (y down)."""
    angle = F.radians(_d(degrees))
    cos, sin = F.cos(angle), F.sin(angle)
    cx, cy = _d(cx), _d(cy)
    return [[cos, -sin, cx - cos * cx + sin * cy], [sin, cos, cy - sin * cx - cos * cy],
            [0.0, 0.0, 1.0]]


def matmul(a: Matrix, b: Matrix) -> list[list[Column]]:
    return [[sum((_d(a[i][k]) * _d(b[k][j]) for k in range(1, 3)), _d(a[i][0]) * _d(b[0][j]))
             for j in range(3)] for i in range(3)]


def shear_matrix(degrees_x: float | Column, degrees_y: float | Column) -> list[list[Column]]:
    return [[1.0, F.tan(F.radians(_d(degrees_x))), 0.0], [F.tan(F.radians(_d(degrees_y))), 1.0, 0.0],
            [0.0, 0.0, 1.0]]


def shift_matrix(dx: float | Column, dy: float | Column) -> list[list[Column]]:
    return [[1.0, 0.0, _d(dx)], [0.0, 1.0, _d(dy)], [0.0, 0.0, 1.0]]


def scale_matrix(sx: float | Column, sy: float | Column) -> list[list[Column]]:
    return [[_d(sx), 0.0, 0.0], [0.0, _d(sy), 0.0], [0.0, 0.0, 1.0]]


def rotate(b: Box, cx: float | Column, cy: float | Column, degrees: float | Column) -> Box:
    return project(b, rotation_matrix(cx, cy, degrees))


def map_forward(b: Box, w: Column, h: Column, scale: float | Column, direction: str | None) -> Box:
    """Where a box lands under test-time augmentation: scale, then flip in the scaled image."""
    scaled = rescale(b, scale, scale)
    return flip(scaled, direction, w * _d(scale), h * _d(scale)) if direction else scaled


def map_back(b: Box, w: Column, h: Column, scale: float | Column, direction: str | None) -> Box:
    """Inverse of :func:`map_forward`."""
    unflipped = flip(b, direction, w * _d(scale), h * _d(scale)) if direction else b
    s = _d(scale)
    return tuple(v / s for v in unflipped)  # type: ignore[return-value]


# ---- predicates ------------------------------------------------------------------------------------

def is_inside(b: Box, w: float | Column, h: float | Column, all_inside: bool = False,
              border: float = 0.0) -> Column:
    """Inside the image grown by ``border``: wholly (inclusive edges) or with any overlap (strict)."""
    low, wide, high = F.lit(-float(border)), _d(w) + F.lit(float(border)), _d(h) + F.lit(float(border))
    if all_inside:
        return (b[0] >= low) & (b[1] >= low) & (b[2] < wide) & (b[3] < high)
    return (b[0] < wide) & (b[1] < high) & (b[2] > low) & (b[3] > low)


def contains_point(b: Box, px: Column, py: Column) -> Column:
    return (px >= b[0]) & (px <= b[2]) & (py >= b[1]) & (py <= b[3])


def valid_annotation(b: Box, area_value: Column, w: Column, h: Column) -> Column:
    """Overlaps the image, has positive area and is at least one pixel wide and high."""
    iw = F.least(b[2], w.cast("double")) - F.greatest(b[0], F.lit(0.0))
    ih = F.least(b[3], h.cast("double")) - F.greatest(b[1], F.lit(0.0))
    overlap = F.greatest(iw, F.lit(0.0)) * F.greatest(ih, F.lit(0.0))
    return (overlap != 0) & (area_value > 0) & (width(b) >= 1) & (height(b) >= 1)


# ---- point distances and regression deltas ---------------------------------------------------------

def distance_to_box(px: Column, py: Column, left: Column, top: Column, right: Column, bottom: Column,
                    size: tuple[Column, Column] | None = None) -> Box:
    b = (px - left, py - top, px + right, py + bottom)
    return clip(b, size[0], size[1]) if size else b


def box_to_distance(px: Column, py: Column, b: Box, max_dis: float | None = None,
                    eps: float = 0.1) -> Box:
    sides = (px - b[0], py - b[1], b[2] - px, b[3] - py)
    if max_dis is None:
        return sides
    top = F.lit(max_dis - eps)
    return tuple(F.least(F.greatest(s, F.lit(0.0)), top) for s in sides)  # type: ignore[return-value]


UNIT_MEANS, UNIT_STDS = (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0)
# fixed value: largest |log ratio| let through when decoding sizes
WH_RATIO_CLIP = 16 / 1000


def encode_xywh_delta(prior: Box, gt: Box, means=UNIT_MEANS, stds=UNIT_STDS, legacy: bool = False) -> Box:
    """Centre offsets over prior size and log size ratios, normalised; ``legacy`` uses "+1" widths."""
    plus = F.lit(1.0 if legacy else 0.0)
    pw, ph = width(prior) + plus, height(prior) + plus
    gw, gh = width(gt) + plus, height(gt) + plus
    (pcx, pcy), (gcx, gcy) = center(prior), center(gt)
    raw = ((gcx - pcx) / pw, (gcy - pcy) / ph, F.log(gw / pw), F.log(gh / ph))
    return tuple((r - F.lit(m)) / F.lit(s) for r, m, s in zip(raw, means, stds))  # type: ignore[return-value]


def decode_xywh_delta(prior: Box, delta: Box, means=UNIT_MEANS, stds=UNIT_STDS,
                      size: tuple[Column, Column] | None = None, ratio_clip: float = WH_RATIO_CLIP,
                      legacy: bool = False) -> Box:
    dx, dy, dw, dh = (d * F.lit(s) + F.lit(m) for d, m, s in zip(delta, means, stds))
    limit = abs(math.log(ratio_clip))
    dw = F.least(F.greatest(dw, F.lit(-limit)), F.lit(limit))
    dh = F.least(F.greatest(dh, F.lit(-limit)), F.lit(limit))
    plus = 1.0 if legacy else 0.0
    pw, ph = width(prior) + F.lit(plus), height(prior) + F.lit(plus)
    pcx, pcy = center(prior)
    gw, gh = pw * F.exp(dw), ph * F.exp(dh)
    gx, gy = pcx + pw * dx, pcy + ph * dy
    half = F.lit(0.5)
    out = (gx - gw * half + half * plus, gy - gh * half + half * plus,
           gx + gw * half - half * plus, gy + gh * half - half * plus)
    if size is None:
        return out
    return clip(out, size[0] - F.lit(plus), size[1] - F.lit(plus))


def encode_tblr(prior: Box, gt: Box, normalizer: float = 4.0, by_wh: bool = True) -> Box:
    """Distances from the prior centre to the top, bottom, left and right edge."""
    cx, cy = center(prior)
    top, bottom, left, right = cy - gt[1], gt[3] - cy, cx - gt[0], gt[2] - cx
    if by_wh:
        w, h = width(prior), height(prior)
        top, bottom, left, right = top / h, bottom / h, left / w, right / w
    n = F.lit(normalizer)
    return top / n, bottom / n, left / n, right / n


def decode_tblr(prior: Box, tblr: Box, normalizer: float = 4.0, by_wh: bool = True,
                size: tuple[Column, Column] | None = None) -> Box:
    top, bottom, left, right = (v * F.lit(normalizer) for v in tblr)
    if by_wh:
        w, h = width(prior), height(prior)
        top, bottom, left, right = top * h, bottom * h, left * w, right * w
    cx, cy = center(prior)
    out = (cx - left, cy - top, cx + right, cy + bottom)
    return clip(out, size[0], size[1]) if size else out


def encode_grid_delta(prior: Box, gt: Box, stride: float | Column, eps: float = 1e-6) -> Box:
    """Cell-relative centre in (0, 1) and log size ratio."""
    s = _d(stride)
    (pcx, pcy), (gcx, gcy) = center(prior), center(gt)
    def unit(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps))
    return (unit((gcx - pcx) / s + 0.5), unit((gcy - pcy) / s + 0.5),
            F.log(F.greatest(width(gt) / width(prior), F.lit(eps))),
            F.log(F.greatest(height(gt) / height(prior), F.lit(eps))))


def decode_grid_delta(prior: Box, delta: Box, stride: float | Column) -> Box:
    s = _d(stride)
    pcx, pcy = center(prior)
    cx, cy = pcx + (delta[0] - 0.5) * s, pcy + (delta[1] - 0.5) * s
    hw, hh = width(prior) * F.exp(delta[2]) * 0.5, height(prior) * F.exp(delta[3]) * 0.5
    return cx - hw, cy - hh, cx + hw, cy + hh


def angle_mod60(degrees: Column) -> Column:
    """Angle folded into [0, 60), also for negative input."""
    return F.pmod(degrees.cast("double"), F.lit(60.0))
