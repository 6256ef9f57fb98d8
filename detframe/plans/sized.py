"""Broadcast only what is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when at most ``max_rows`` rows exist, counted with an early stop.

    Beyond that the frame is returned as is: the join becomes a shuffle join that adaptive execution
    may split on skewed keys.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
