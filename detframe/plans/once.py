"""Columns that are worked out once per row, and many columns rounded at once."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Add (or replace) ``values``, each computed once per row.

    The optimizer writes the expression of an ordinary new column into every later filter and column that mentions it. What a
    generator made is read instead.
    """
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` makes of doubles: half up on their decimal text.

    Away from the middle between two results a whole number over a power of ten is the same double, so only values near the
    middle and very large ones go through their text.
    """
    unit = 10.0 ** digits
    up = x * unit + 0.5
    whole = np.floor(up)
    out = whole / unit + 0.0  # no negative zero
    far = ~((np.abs(up - whole - 0.5) < 0.499) & (np.abs(up) < 2.0 ** 40)) & np.isfinite(x)
    step = Decimal(1).scaleb(-digits)
    with localcontext() as exact:
        exact.prec = 400
        out[far] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) + 0.0 for v in x[far].tolist()]
    return np.where(np.isfinite(x), out, x)


def rounded(df: DataFrame, values: Mapping[str, Column], digits: int) -> DataFrame:
    """``df`` with the columns ``values`` (doubles) as ``round`` gives them; the other columns stay.

    Many rounded columns make the generated code of a row too large to be compiled, and ``round`` takes a text each. Here a row's
    values travel as one list, and a batch is rounded in one pass.
    """
    kept, n = [c for c in df.columns if c not in values], len(values)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def in_one_pass(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        with np.errstate(invalid="ignore"):
            made = round_half_up(flat.fill_null(0.0).to_numpy(zero_copy_only=False), digits)
        gone = flat.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * n, pa.int32()), pa.array(made, mask=gone))

    listed = df.select(*kept, in_one_pass(F.array(*values.values())).alias("_r"))
    return listed.select(*kept, *[F.get("_r", F.lit(i)).alias(n) for i, n in enumerate(values)])
