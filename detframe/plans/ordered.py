"""Exact running totals, ranks and suffix maxima inside keys that may be arbitrarily large.

``sum(x) OVER (PARTITION BY class ORDER BY score)`` sorts a whole class in one task. Here a key with
more than ``target`` rows is first cut into score cells; the window runs inside (key, cell) and a small
table of per-cell totals supplies what lies before (or after) each cell. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.plans.sized import broadcast_if_small
from detframe.session import cut_lineage

CELLS = 1024
SUBCELLS = 64
TARGET_ROWS = 2_000_000
_CELL = ["_cell", "_sub"]


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the key columns are the left ones."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    meet = F.lit(True)
    for c in on:
        meet = meet & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, meet, how).drop(*[f"_on_{c}" for c in on])


def _coarse(score: Column, descending: bool) -> Column:
    clipped = F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0))
    cell = F.floor(clipped * F.lit(CELLS)).cast("int")
    return -cell if descending else cell


def _linear(value: Column, low: Column, high: Column, parts: int) -> Column:
    """Monotone map of ``value`` in [low, high] to 0..parts-1."""
    span = high - low
    share = F.when(span > 0, (value - low) / span).otherwise(F.lit(0.0))
    return F.least(F.floor(share * F.lit(parts)), F.lit(parts - 1)).cast("int")


def with_cells(df: DataFrame, by: Sequence[str], score: str, ident: str, descending: bool = True,
               target: int = TARGET_ROWS) -> DataFrame:
    """Add ``_cell, _sub``: buckets that respect the order (score, ident) inside each key.

    Only keys above ``target`` rows are cut. A crowded cell is cut again by score, or by ident when all
    its scores are equal, so heavy ties do not form one large bucket.
    """
    by = list(by)
    sized = df.withColumn("_cell", _coarse(F.col(score), descending))
    stats = sized.groupBy(*by, "_cell").agg(
        F.count(F.lit(1)).alias("_cell_n"),
        F.min(F.col(score).cast("double")).alias("_cell_lo"), F.max(F.col(score).cast("double")).alias("_cell_hi"),
        F.min(F.col(ident).cast("double")).alias("_cell_ilo"), F.max(F.col(ident).cast("double")).alias("_cell_ihi"),
    )
    # at most CELLS rows per key reach this window
    total = F.sum("_cell_n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    # at most CELLS rows for every ``target`` rows of the table, stored so that the join need not move the table
    hot = broadcast_if_small(cut_lineage(stats.withColumn("_cell_total", total).where(F.col("_cell_total") > target).drop("_cell_total")))
    joined = null_safe_join(sized, hot, [*by, "_cell"], "left")
    fine = _linear(F.col(score).cast("double"), F.col("_cell_lo"), F.col("_cell_hi"), SUBCELLS)
    fine = -fine if descending else fine
    tied = _linear(F.col(ident).cast("double"), F.col("_cell_ilo"), F.col("_cell_ihi"), SUBCELLS)
    sub = (F.when(F.col("_cell_n").isNull() | (F.col("_cell_n") <= target), F.lit(0))
           .when(F.col("_cell_lo") == F.col("_cell_hi"), tied).otherwise(fine))
    cell = F.when(F.col("_cell_n").isNull(), F.lit(0)).otherwise(F.col("_cell"))
    return (joined.withColumn("_sub", sub).withColumn("_cell", cell)
            .drop("_cell_n", "_cell_lo", "_cell_hi", "_cell_ilo", "_cell_ihi"))


def crowded(df: DataFrame, by: Sequence[str], target: int = TARGET_ROWS) -> bool:
    """Whether some key exceeds ``target`` rows. One partial count; call it on a stored frame."""
    return df.groupBy(*by).count().where(F.col("count") > target).limit(1).count() > 0


def without_cells(df: DataFrame) -> DataFrame:
    """One cell per key: the plain window, right when no key is crowded."""
    return df.withColumn("_cell", F.lit(0)).withColumn("_sub", F.lit(0))


def _order(score: str, ident: str, descending: bool, reverse: bool = False):
    down = descending != reverse
    return [F.col(score).desc() if down else F.col(score).asc(),
            F.col(ident).desc() if reverse else F.col(ident).asc()]


def _beside(offsets: DataFrame) -> DataFrame:
    """One row per cell, stored and sent to the rows where few, so that the rows need not move to meet them."""
    return broadcast_if_small(cut_lineage(offsets))


def running_sums(df: DataFrame, by: Sequence[str], score: str, ident: str, sums: Mapping[str, Column | str],
                 descending: bool = True, target: int = TARGET_ROWS, keep_cells: bool = False) -> DataFrame:
    """Inclusive running sums of ``sums`` (name -> expression) per key in the order (score, ident)."""
    by = list(by)
    celled = df if "_cell" in df.columns else with_cells(df, by, score, ident, descending, target)
    window = (Window.partitionBy(*by, *_CELL).orderBy(*_order(score, ident, descending))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = celled
    for name, expr in sums.items():
        local = local.withColumn(f"_x_{name}", F.col(expr) if isinstance(expr, str) else expr)
    totals = local.groupBy(*by, *_CELL).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    before = before.orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, *_CELL, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    ranked = local.select(
        *celled.columns, *[F.sum(f"_x_{n}").over(window).alias(f"_l_{n}") for n in sums])
    out = null_safe_join(ranked, _beside(offsets), [*by, *_CELL])
    kept = [c for c in celled.columns if keep_cells or c not in _CELL]
    return out.select(*kept, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def suffix_max(df: DataFrame, by: Sequence[str], score: str, ident: str, value: str, name: str,
               descending: bool = True, target: int = TARGET_ROWS) -> DataFrame:
    """``max(value)`` over the current and all later rows of the key: the precision envelope."""
    by = list(by)
    celled = df if "_cell" in df.columns else with_cells(df, by, score, ident, descending, target)
    # reversed order: Spark re-scans the rest of the partition for each row of an unbounded-following frame
    window = (Window.partitionBy(*by, *_CELL).orderBy(*_order(score, ident, descending, reverse=True))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = celled.groupBy(*by, *_CELL).agg(F.max(value).alias("_m"))
    after = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    after = (after.orderBy(*[F.col(c).desc() for c in _CELL]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*by, *_CELL, F.max("_m").over(after).alias("_o"))
    ranked = celled.withColumn("_l", F.max(value).over(window))
    out = null_safe_join(ranked, _beside(offsets), [*by, *_CELL])
    kept = [c for c in celled.columns if c not in _CELL]
    return out.select(*kept, F.greatest("_l", "_o").alias(name))


def ordered_rank(df: DataFrame, by: Sequence[str], score: str, ident: str, name: str = "rank",
                 descending: bool = True, target: int = TARGET_ROWS) -> DataFrame:
    """``row_number`` per key (or over the whole table when ``by`` is empty) without one sorting task."""
    return (running_sums(df, by, score, ident, {name: F.lit(1).cast("long")}, descending, target)
            .withColumn(name, F.col(name).cast("long")))


def _over_range(df: DataFrame, ident: str) -> DataFrame:
    """Add ``_pos``: the unique numeric column ``ident`` spread over its own value range, so cells are even for any id range."""
    span = df.agg(F.min(ident).cast("double").alias("_a"), F.max(ident).cast("double").alias("_b"))
    unit = F.when(F.col("_b") > F.col("_a"),
                  (F.col(ident).cast("double") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))
    return df.join(F.broadcast(span)).withColumn("_pos", unit).drop("_a", "_b")  # span is one row


def dense_ids(df: DataFrame, ident: str, name: str, start: int = 1, target: int = TARGET_ROWS) -> DataFrame:
    """Contiguous ids ``start..`` in the order of the unique numeric column ``ident``."""
    ranked = ordered_rank(_over_range(df, ident), [], "_pos", ident, name, descending=False, target=target).drop("_pos")
    return ranked.withColumn(name, F.col(name) + F.lit(start - 1))


def sums_before(df: DataFrame, ident: str, size: str, name: str, target: int = TARGET_ROWS) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows before, in the order of the unique numeric column ``ident``."""
    summed = running_sums(_over_range(df, ident), [], "_pos", ident, {name: size}, descending=False, target=target).drop("_pos")
    return summed.withColumn(name, F.col(name) - F.col(size))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """First row per key by aggregation: partial minima combine before the shuffle, so a hot key is cheap.

    ``order`` must sort ascending; negate numbers for descending order.
    """
    best = F.min(F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)],
                          *[F.col(c).alias(c) for c in carry])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in carry])
