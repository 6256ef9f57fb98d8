"""Sequential rules inside groups, run over partitions that Spark has hashed and sorted.

``scan_groups`` hands each group to a numpy function as array slices of an Arrow batch: no Python call
per row, and a few microseconds per group instead of one pandas frame each. It is for groups with a size
bound (``split_by_size`` sends larger ones elsewhere). ``scan_states`` is for rules that read a key's rows in
order and need only a state: it never holds more than one Arrow batch plus that state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

GROUP_LIMIT = 50_000

Arrays = dict[str, np.ndarray]


def _bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Start offsets of runs of equal keys, plus the length."""
    n = len(keys[0])
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def _arrange(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def scan_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                fn: Callable[[Arrays, np.ndarray], Arrays | None], schema: str, late: Sequence[Column] | None = None, lying: bool = False) -> DataFrame:
    """Apply ``fn`` to the columns of many whole groups at once, in ``order``, with their offsets (and the length at the end).

    ``schema`` (DDL) names every output column; ``fn`` returns them all. Keys must not be NULL. ``late`` columns are worked out
    from the rows once these are in place, and are what ``fn`` sees: wide ones need not be shuffled or sorted. Rows that may be
    ``lying`` by the keys are not moved if they do; ``fn`` then sees their place ``_at`` as well.
    """
    keys = list(keys)
    names = [f.name for f in _schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(block: pd.DataFrame, last: bool):
            arrays = {c: block[c].to_numpy() for c in block.columns}
            cuts = _bounds([arrays[k] for k in keys])
            cuts = cuts if last else cuts[:-1]
            made = None
            if len(cuts) > 1:
                out = fn({c: v[:cuts[-1]] for c, v in arrays.items()}, cuts)
                if out and len(out[names[0]]):
                    made = pd.DataFrame({n: out[n] for n in names}, columns=names)
            return made, (None if last else block.iloc[cuts[-1]:])

        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            block = batch if held is None else pd.concat([held, batch], ignore_index=True)
            made, held = emit(block, last=False)
            if made is not None:
                yield made
        if held is not None and len(held):
            made, _ = emit(held, last=True)
            if made is not None:
                yield made

    # a window asks for rows by key and in order, and takes them as they lie where they do
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) if lying else _arrange(df, keys, order)
    return (rows.select(*late, *(["_at"] if lying else [])) if late else rows).mapInPandas(run, schema)


def scan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                fn: Callable[[Arrays], Arrays | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each group's columns, in ``order``; outputs get the key columns in front.

    ``schema`` (DDL) names every output column, keys included. Keys must not be NULL.
    """
    names = [f.name for f in _schema(schema)]

    def each(arrays: Arrays, cuts: np.ndarray) -> Arrays | None:
        parts: dict[str, list] = {n: [] for n in names}
        for a, b in zip(cuts[:-1], cuts[1:]):
            out = fn({c: v[a:b] for c, v in arrays.items()})
            size = len(next(iter(out.values()))) if out else 0
            if size == 0:
                continue
            for n in names:
                parts[n].append(out[n] if n in out else np.repeat(arrays[n][a:a + 1], size))
        return {n: np.concatenate(p) for n, p in parts.items()} if parts[names[0]] else None

    return scan_blocks(df, keys, order, each, schema)


def scan_states(df: DataFrame, keys: Sequence[str], steps: Sequence[str], order: Sequence[Column | str],
                start: Callable[[], object], step: Callable[[object, Arrays], Arrays | None],
                schema: str, finish: Callable[[object], Arrays | None] | None = None) -> DataFrame:
    """Run ``step(state, rows)`` over the consecutive (keys, steps) slices of each key, then ``finish(state)``.

    A step (a frame, say) is small; a key (a video) may be long. ``start()`` makes the state of a new key.
    Without ``steps`` a slice is whatever part of the key an Arrow batch holds, and nothing is carried over
    but the state.
    """
    keys, steps = list(keys), list(steps)
    names = [f.name for f in _schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: object = None
        held: pd.DataFrame | None = None
        parts: dict[str, list] = {n: [] for n in names}

        def collect(out: Arrays | None) -> None:
            size = len(next(iter(out.values()))) if out else 0
            if not size:
                return
            for n in names:
                parts[n].append(out[n] if n in out else np.repeat(current[keys.index(n)], size))

        def flush() -> Iterator[pd.DataFrame]:
            if parts[names[0]]:
                yield pd.DataFrame({n: np.concatenate(p) for n, p in parts.items()}, columns=names)
                for p in parts.values():
                    p.clear()

        def consume(block: pd.DataFrame, last: bool) -> pd.DataFrame | None:
            nonlocal current, state
            arrays = {c: block[c].to_numpy() for c in block.columns}
            cuts = _bounds([arrays[k] for k in keys + steps])
            whole = last or not steps
            for i in range(len(cuts) - 1 if whole else len(cuts) - 2):
                a, b = cuts[i], cuts[i + 1]
                key = tuple(arrays[k][a] for k in keys)
                if key != current:
                    if current is not None and finish:
                        collect(finish(state))
                    current, state = key, start()
                collect(step(state, {c: v[a:b] for c, v in arrays.items()}))
            return None if whole else block.iloc[cuts[-2]:]

        for batch in batches:
            if not len(batch):
                continue
            held = consume(batch if held is None else pd.concat([held, batch], ignore_index=True), last=False)
            yield from flush()
        if held is not None and len(held):
            consume(held, last=True)
        if current is not None and finish:
            collect(finish(state))
        yield from flush()

    return _arrange(df, [*keys], [*steps, *order]).mapInPandas(run, schema)


def split_by_size(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, weight: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``limit``, rows of larger groups or None when there are none); a row counts 1 or its ``weight``."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    large = df.groupBy(*keys).agg(size.alias("count")).where(F.col("count") > limit).select(*keys)
    if large.limit(1).count() == 0:
        return df, None
    # at most total rows / limit keys
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")
