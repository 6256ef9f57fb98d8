"""Where user code plugs in: named DataFrame operators, per-record functions, own metrics, table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def register(name: str):
    """Register a factory ``options -> (DataFrame -> DataFrame)`` under a name."""
    def add(factory):
        if name in OPERATORS:
            raise KeyError(f"{name} is already registered")
        OPERATORS[name] = factory
        return factory
    return add


def compose(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply ``[{"type": name, **options}, ..]`` in order; Catalyst sees one plan."""
    made = [OPERATORS[s["type"]](**{k: v for k, v in s.items() if k != "type"}) for s in steps]
    return reduce(lambda d, f: d.transform(f), made, df)


@register("min_size")
def _min_size(width: float = 0, height: float = 0):
    from detframe.operators.filters import filter_small
    return lambda df: filter_small(df, width, height)


@register("flip")
def _flip(probs: dict, seed: int = 0):
    from detframe.operators.augment import random_flip
    return lambda df: random_flip(df, probs, seed)


@register("resize")
def _resize(width: int, height: int, keep_ratio: bool = True):
    from detframe.operators.augment import resize
    return lambda df: resize(df, width, height, keep_ratio)


@register("nms")
def _nms(iou_thr: float, class_agnostic: bool = False):
    from detframe.operators.suppression import nms
    return lambda df: nms(df, iou_thr, class_agnostic)


def map_records(df: DataFrame, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """A user's per-record function over Arrow batches; records mapped to None are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [r for r in map(fn, batch.to_dict("records")) if r is not None]
            if kept:
                yield pd.DataFrame(kept)
    return df.mapInPandas(run, schema)


def partial_metric(df: DataFrame, by: Sequence[str], process: Callable[[pd.DataFrame], dict], partial_schema: str,
                   final: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's metric in two steps: ``process`` sums up each Arrow batch, ``final`` aggregates the partial rows.

    No group is collected: a key's batches may be anywhere, and only partial results are shuffled.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, part in batch.groupby(list(by), sort=False):
                key = key if isinstance(key, tuple) else (key,)
                rows.append({**dict(zip(by, key)), **process(part)})
            if rows:
                yield pd.DataFrame(rows)
    return final(df.mapInPandas(run, partial_schema))


def run_table_function(spark) -> str:
    """Register the table function ``counts_to_runs(counts)`` for SQL and return its name."""
    class Runs:
        def eval(self, counts):
            at = 0
            for i, n in enumerate(counts or []):
                if i % 2 and n:
                    yield at, n
                at += n

    spark.udtf.register("counts_to_runs", F.udtf(Runs, returnType="start long, length long"))
    return "counts_to_runs"
