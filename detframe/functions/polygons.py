"""Polygons as flat ``[x, y, x, y, …]`` arrays: Column functions, filling, and run-length codes.

Measures and moves work on Arrow batches. Spark does not take the result of a higher-order function (``points``, ``split_parts``,
``transform``) as their argument in the same ``select``: cut it off before, with ``plans.once``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from detframe.functions.arrays import repeated


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def points(flat: Column) -> Column:
    """``array<struct<x, y>>`` of a flat polygon; an odd tail value is left out."""
    def pair(f: Column) -> Column:
        n = F.floor(F.size(f) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(f, 2 * i).alias("x"), F.get(f, 2 * i + 1).alias("y")))).otherwise(
            F.array().cast("array<struct<x: double, y: double>>"))
    return _let(flat, pair)


def flatten(pts: Column) -> Column:
    return F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))


def _next(arr: Column) -> Column:
    return F.concat(F.slice(arr, 2, 1_000_000_000), F.slice(arr, 1, 1))


def area(flat: Column) -> Column:
    """Shoelace area."""
    return _areas(flat.cast("array<double>"))


def parts_area(parts: Column) -> Column:
    """Area of a mask of several polygons."""
    return _parts_areas(parts.cast("array<array<double>>"))


def bbox(flat: Column) -> tuple[Column, Column, Column, Column]:
    sides = _hulls(flat.cast("array<double>"))
    return tuple(F.get(sides, F.lit(i)) for i in range(4))  # type: ignore[return-value]


def affine(flat: Column, m: Sequence[Sequence[float | Column]]) -> Column:
    """Every vertex through a 2x3 (or 3x3 affine) matrix."""
    return _affine(flat.cast("array<double>"), *[_number(v) for row in m[:2] for v in row])


def _number(v: float | Column) -> Column:
    return (v if isinstance(v, Column) else F.lit(float(v))).cast("double")


def flip(flat: Column, direction: str, w: Column, h: Column) -> Column:
    fx, fy = direction in ("horizontal", "diagonal"), direction in ("vertical", "diagonal")
    return _stretched(flat.cast("array<double>"), *[_number(v) for v in (-1 if fx else 1, w if fx else 0, -1 if fy else 1, h if fy else 0)])


def translate(flat: Column, dx: float | Column, dy: float | Column) -> Column:
    return _stretched(flat.cast("array<double>"), *[_number(v) for v in (1, dx, 1, dy)])


def rescale(flat: Column, sx: float | Column, sy: float | Column) -> Column:
    return _stretched(flat.cast("array<double>"), *[_number(v) for v in (sx, 0, sy, 0)])


def crop(flat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Intersection with a rectangle, moved to its origin; six zeros when nothing is left.

    The polygon is cut by one side after another, so a concave part stays one polygon.
    """
    return _crops(flat.cast("array<double>"), *[v.cast("double") for v in (x1, y1, x2, y2)])


def split_parts(flat: Column, lengths: Column) -> Column:
    """Cut one long list into polygons of the given lengths."""
    return F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda i: F.slice(
        flat, F.aggregate(F.slice(lengths, F.lit(1), i - 1), F.lit(1), lambda s, v: s + v.cast("int")), F.element_at(lengths, i).cast("int")))


def fill(polygons: DataFrame, by: Sequence[str], parts: str = "parts", height: str = "height") -> DataFrame:
    """Runs ``(by.., start, length)`` of masks of several polygons: even-odd rule at pixel centres, column by column.

    Each edge yields its crossings with the pixel columns it spans; the sorted crossings of a column pair up. Only polygons are
    shuffled: a mask's runs are made in its row.
    """
    by = list(by)
    masks = polygons.groupBy(*by, F.col(height).alias("_h")).agg(F.flatten(F.collect_list(F.col(parts).cast("array<array<double>>"))).alias("_p"))
    runs = masks.select(*by, F.explode(fill_runs("_p", "_h")).alias("_r"))
    return runs.select(*by, "_r.start", "_r.length")


# ---- run-length codes ---------------------------------------------------------------------------------

RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _listed(sizes: np.ndarray, values: pa.Array, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values, mask=nulls)


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of the list of each value, lengths, values) of an array of lists; null lists are empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), sizes, lists.flatten()


def _run_array(start: np.ndarray, length: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["start", "length"])


def _starts_and_ends(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, start, end) of all runs that are not empty."""
    row, _, flat = _lists(runs)
    start, length = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten())
    some = length > 0
    return row[some], start[some], (start + length)[some]


def _vertices(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the polygon, x, y) of every vertex of flat polygons; an odd tail value is left out."""
    _, sizes, flat = _lists(lists)
    value, (poly, nth) = flat.to_numpy(zero_copy_only=False).astype(np.float64), repeated(sizes // 2)
    at = (np.cumsum(sizes) - sizes)[poly] + 2 * nth
    return poly, value[at], value[at + 1]


def _after(poly: np.ndarray) -> np.ndarray:
    """Place of the vertex that follows each vertex in its polygon."""
    first = np.flatnonzero(np.r_[True, poly[1:] != poly[:-1]][:len(poly)])
    out = np.arange(1, len(poly) + 1)
    out[np.r_[first[1:], len(poly)][:len(first)] - 1] = first
    return out


def _shoelaces(lists: pa.Array) -> np.ndarray:
    poly, x, y = _vertices(lists)
    then = _after(poly)
    return np.abs(np.bincount(poly, x * y[then] - x[then] * y, len(lists))) / 2


def _known(values: np.ndarray) -> pa.Array:
    """A missing coordinate gives a missing value."""
    return pa.array(values, mask=np.isnan(values))


@F.arrow_udf(T.DoubleType())
def _areas(flat: pa.Array) -> pa.Array:
    return _known(_shoelaces(flat))


@F.arrow_udf(T.DoubleType())
def _parts_areas(parts: pa.Array) -> pa.Array:
    row, _, polygons = _lists(parts)
    sums = np.bincount(row, _shoelaces(polygons), len(parts))
    return pa.array(sums, mask=np.isnan(sums) | parts.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hulls(flat: pa.Array) -> pa.Array:
    """Least x and y, greatest x and y of flat polygons."""
    row, sizes, values = _lists(flat)
    v = values.to_numpy(zero_copy_only=False).astype(np.float64)
    odd = (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]) % 2
    out = np.full((len(flat), 4), np.nan)
    for side, (best, which) in enumerate(((np.fmin, 0), (np.fmin, 1), (np.fmax, 0), (np.fmax, 1))):
        r, x = row[odd == which], v[odd == which]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][:len(r)])
        if len(first):
            out[r[first], side] = best.reduceat(x, first)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 4, pa.int32()), _known(out.ravel()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _stretched(flat: pa.Array, sx: pa.Array, dx: pa.Array, sy: pa.Array, dy: pa.Array) -> pa.Array:
    """x * sx + dx and y * sy + dy of flat polygons; an odd tail value counts as x."""
    row, sizes, values = _lists(flat)
    odd = (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]) % 2 == 1
    sx, dx, sy, dy = (v.to_numpy(zero_copy_only=False).astype(np.float64)[row] for v in (sx, dx, sy, dy))
    v = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return _listed(sizes, _known(v * np.where(odd, sy, sx) + np.where(odd, dy, dx)), flat.is_null())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _affine(flat: pa.Array, *entries: pa.Array) -> pa.Array:
    """Every vertex of flat polygons through the six entries of a 2x3 matrix, row by row."""
    poly, x, y = _vertices(flat)
    e = [v.to_numpy(zero_copy_only=False).astype(np.float64)[poly] for v in entries]
    out = np.stack([e[0] * x + e[1] * y + e[2], e[3] * x + e[4] * y + e[5]], axis=1)
    return _listed(2 * np.bincount(poly, minlength=len(flat)), _known(out.ravel()), pa.array(np.zeros(len(flat), bool)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _crops(flat: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """See :func:`crop`: all polygons of a batch are cut by one side after another."""
    poly, *at = _vertices(flat)
    left, top, right, bottom = (v.to_numpy(zero_copy_only=False).astype(np.float64) for v in (x1, y1, x2, y2))
    for axis, bound, above in ((0, left, True), (0, right, False), (1, top, True), (1, bottom, False)):
        then, limit = _after(poly), bound[poly]
        inside = at[axis] >= limit if above else at[axis] <= limit
        to, follows = [v[then] for v in at], inside[then]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (limit - at[axis]) / (to[axis] - at[axis])
            across = at[1 - axis] + t * (to[1 - axis] - at[1 - axis])
        crossing = [limit, across] if axis == 0 else [across, limit]
        made = np.where(inside, 1, np.where(follows, 2, 0))
        end = np.cumsum(made)
        crosses = inside != follows
        for i in (0, 1):
            out = np.empty(end[-1] if len(end) else 0)
            out[(end - made)[crosses]] = crossing[i][crosses]
            out[(end - 1)[follows]] = to[i][follows]
            at[i] = out
        poly = np.repeat(poly, made)
    count = np.bincount(poly, minlength=len(flat))
    kept = count[poly] >= 3
    sizes = np.where(count >= 3, 2 * count, 6)
    values, owner = np.zeros(sizes.sum()), poly[kept]
    place = (np.cumsum(sizes) - sizes)[owner] + 2 * (np.arange(len(poly)) - (np.cumsum(count) - count)[poly])[kept]
    values[place], values[place + 1] = at[0][kept] - left[owner], at[1][kept] - top[owner]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


@F.arrow_udf(RUNS)
def counts_to_runs(counts: pa.Array) -> pa.Array:
    """``array<struct<start, length>>`` of the ones in alternating counts (zeros first)."""
    row, sizes, flat = _lists(counts)
    n = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.cumsum(n) - n
    ones = ((np.arange(len(n)) - first) % 2 == 1) & (n > 0)
    return _listed(np.bincount(row[ones], minlength=len(sizes)), _run_array((before - before[first])[ones], n[ones]), counts.is_null())


@F.arrow_udf(RUNS)
def merge_runs(runs: pa.Array) -> pa.Array:
    """Touching neighbours of one mask's runs joined; ``runs`` are disjoint and in order."""
    row, start, end = _starts_and_ends(runs)
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > end[:-1])][:len(row)])
    last = np.r_[new[1:], len(row)][:len(new)] - 1
    return _listed(np.bincount(row[new], minlength=len(runs)), _run_array(start[new], end[last] - start[new]), runs.is_null())


@F.arrow_udf(T.ArrayType(T.LongType()))
def list_to_counts(runs: pa.Array, size: pa.Array) -> pa.Array:
    """Alternating counts of one mask of ``size`` pixels from its runs, disjoint and in order; without runs one count of zeros."""
    row, start, end = _starts_and_ends(runs)
    n, size = len(runs), size.to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.bincount(row, minlength=n)
    fresh = np.r_[True, row[1:] != row[:-1]][:len(row)]
    gap = start - np.where(fresh, 0, np.r_[0, end][:len(row)])
    reach = np.zeros(n, np.int64)
    reach[row] = end  # the last run of a list is written last
    rest = size > reach
    total = 2 * held + rest
    out = np.empty(total.sum(), np.int64)
    base = np.cumsum(total) - total
    at = base[row] + 2 * (np.arange(len(row)) - (np.cumsum(held) - held)[row])
    out[at], out[at + 1] = gap, end - start
    out[(base + total - 1)[rest]] = (size - reach)[rest]
    return _listed(total, pa.array(out, pa.int64()), runs.is_null())


#: Crossings of edges with pixel columns that are worked out at once.
FILLED = 1_000_000


def _filled(row: np.ndarray, height: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray,
            first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the runs between the edges (a, b) of each row, by start."""
    edge, place = repeated(last - first + 1)
    c = first[edge] + place
    y = ay[edge] + (c + 0.5 - ax[edge]) * (by - ay)[edge] / (bx - ax)[edge]
    owner = row[edge]
    order = np.lexsort((y, c, owner))
    owner, c, y = owner[order], c[order], y[order]
    fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])][:len(c)])
    at = np.arange(len(c)) - np.repeat(fresh, np.diff(np.r_[fresh, len(c)]))
    inner = np.r_[at[1:], 0][:len(c)] > 0  # another crossing of the column follows
    opens = np.flatnonzero((at % 2 == 0) & inner)
    high = height[owner[opens]]
    top, end = (np.clip(np.ceil(v - 0.5), 0, high).astype(np.int64) for v in (y[opens], y[opens + 1]))
    some = end > top
    opens, top, end, high = opens[some], top[some], end[some], high[some]
    return owner[opens], c[opens] * high + top, end - top


@F.arrow_udf(RUNS)
def fill_runs(parts: pa.Array, height: pa.Array) -> pa.Array:
    """Runs of each mask of several flat polygons, in order; see :func:`fill`."""
    part_row, _, polygons = _lists(parts)
    point, sizes, flat = _lists(polygons)
    value, pairs = flat.to_numpy(zero_copy_only=False).astype(np.float64), sizes // 2
    begin = np.cumsum(sizes) - sizes
    poly, nth = repeated(pairs)
    at, after = begin[poly] + 2 * nth, begin[poly] + 2 * ((nth + 1) % pairs[poly])
    x, y, u, v = value[at], value[at + 1], value[after], value[after + 1]
    ahead = x < u
    ax, ay, bx, by = np.where(ahead, x, u), np.where(ahead, y, v), np.where(ahead, u, x), np.where(ahead, v, y)
    first, last = np.maximum(np.ceil(ax - 0.5), 0), np.ceil(bx - 0.5) - 1
    spans = last >= first
    row, first, last = part_row[poly][spans], first[spans].astype(np.int64), last[spans].astype(np.int64)
    edges, high = (ax[spans], ay[spans], bx[spans], by[spans]), height.to_numpy(zero_copy_only=False).astype(np.int64)
    crossings = np.zeros(len(parts), np.int64)
    np.add.at(crossings, row, last - first + 1)
    lot = (np.cumsum(crossings) // FILLED)[row]
    cuts = np.r_[0, np.flatnonzero(np.diff(lot)) + 1, len(row)]
    found = [_filled(row[a:b], high, *(e[a:b] for e in edges), first[a:b], last[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    owner, start, length = (np.concatenate(x) for x in zip(*found))
    return _listed(np.bincount(owner, minlength=len(parts)), _run_array(start, length), parts.is_null())


def runs_to_counts(runs: DataFrame, by: Sequence[str], size: str = "size") -> DataFrame:
    """Alternating counts of each mask from disjoint runs; ``size`` is the number of pixels of the image."""
    order = Window.partitionBy(*by).orderBy("start")
    gap = F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(0))
    rows = runs.withColumn("_gap", gap)
    out = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "_gap", "length"))).alias("r"), F.max(F.col("start") + F.col("length")).alias("_e"), F.max(size).alias("_s"))
    body = F.flatten(F.transform("r", lambda r: F.array(r["_gap"], r["length"])))
    return out.select(*by, F.when(F.col("_s") > F.col("_e"), F.concat(body, F.array(F.col("_s") - F.col("_e")))).otherwise(body).alias("counts"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def decode_rle(text: pa.Array) -> pa.Array:
    """Counts of a compressed run-length string.

    Six-bit groups, low part first: five bits of value and one that says more follow; counts from the fourth on are differences
    to the count two before.
    """
    raw = text.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    held = raw.buffers()[2] if len(raw) else None
    c = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]].astype(np.int64) - 48 if held is not None else np.empty(0, np.int64)
    last = np.flatnonzero((c & 32) == 0)
    first = np.r_[0, last[:-1] + 1][:len(last)]
    size = last - first + 1
    value, at, k = c[first] & 31, np.flatnonzero(size > 1), 1
    while len(at):
        value[at] += (c[first[at] + k] & 31) << (5 * k)
        k += 1
        at = at[size[at] > k]
    value = np.where(c[last] & 16, value - (np.int64(1) << (5 * size)), value)
    stops = np.searchsorted(last, ends - ends[0])
    sizes = np.diff(stops)
    start = np.repeat(stops[:-1], sizes)
    place = np.arange(len(value)) - start
    for odd in (True, False):
        # sums over every other count of a row
        mine = (place % 2 == 1) if odd else (place % 2 == 0) & (place > 0)
        total = np.cumsum(np.where(mine, value, 0))
        value = np.where(mine, total - np.r_[0, total][start], value)
    return _listed(sizes, pa.array(value, pa.int64()), text.is_null())


@F.arrow_udf(T.StringType())
def encode_rle(counts: pa.Array) -> pa.Array:
    """Compressed string of alternating counts, the inverse of :func:`decode_rle`."""
    _, sizes, flat = _lists(counts)
    v = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    later = np.flatnonzero(place > 2)
    x = v.copy()
    x[later] -= v[later - 2]
    at, size, parts = np.arange(len(x)), np.zeros(len(x), np.int64), []
    while len(at):
        c = x & 31
        x = x >> 5
        more = np.where(c & 16, x != -1, x != 0)
        parts.append((at, (c + 48 + 32 * more).astype(np.uint8)))
        size[at] += 1
        at, x = at[more], x[more]
    first = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.uint8)
    for k, (at, c) in enumerate(parts):
        text[first[at] + k] = c
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(sizes)]].astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(text.tobytes())).cast(pa.string())
    return pc.if_else(counts.is_null(), pa.scalar(None, pa.string()), made)


@F.arrow_udf(RUNS)
def box_columns(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, height: pa.Array) -> pa.Array:
    """One run per pixel column of a whole-numbered box, in order; empty for a box without area or with a NULL."""
    empty = np.any([v.is_null().to_numpy(zero_copy_only=False) for v in (x1, y1, x2, y2, height)], axis=0)
    left, top, right, bottom = (v.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for v in (x1, y1, x2, y2))
    high = height.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, tall = left.astype(np.int64), (bottom - top).astype(np.int64)
    row, place = repeated(np.where(empty | (bottom <= top), 0, np.maximum(right.astype(np.int64) - first, 0)))
    start = (first[row] + place) * high[row] + top.astype(np.int64)[row]
    return _listed(np.bincount(row, minlength=len(left)), _run_array(start, tall[row]), pa.array(np.zeros(len(left), bool)))


@F.arrow_udf(T.StructType([T.StructField("pixels", T.LongType()), T.StructField("before", T.LongType())]))
def run_facts(runs: pa.Array) -> pa.Array:
    """Pixels of a mask's runs, and where the first one starts; both NULL for no list, the second without any run."""
    _, sizes, flat = _lists(runs)
    start, length = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length"))
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    total, first = np.r_[0, np.cumsum(length)], np.r_[start, 0][ends[:-1]]
    return pa.StructArray.from_arrays([pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64(), mask=runs.is_null().to_numpy(zero_copy_only=False)),
                                       pa.array(first, pa.int64(), mask=sizes == 0)], ["pixels", "before"])
