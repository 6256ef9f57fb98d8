"""Similarity of embeddings: best partners by dot product, cosine or two-way softmax, over blocks of vectors.

Vectors are dealt into blocks by id and every pair of blocks meets in one task as matrix products of bounded size. What leaves a
task is bounded by its rows: the best few of each query, and for softmax one partial log-sum-exp per row and per column. Copies of
a vector number the blocks of the other side: a side has up to ``SIDE_BLOCKS`` of them, and more once these would pass ``FULL_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.session import cut_lineage

BLOCK_ROWS = 2048
SIDE_BLOCKS = 16
FULL_ROWS = 32768
#: Queries and partners of one matrix product.
TILE_ROWS, TILE_PARTNERS = 256, 4096
#: Partners that are compared by their best score first.
RUN = 64
#: Scores are told apart to so many digits, so that equal vectors tie whatever block they are in.
DIGITS = 9


def _placed(vectors: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    return vectors.select(*keys, F.col("id").cast("long").alias("id"), F.col("embedding").alias("_e"),
                          F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b"))


def _matrix(column: pd.Series, cosine: bool) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)  # single precision travels as it is
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if cosine else x


def _best_few(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) that hold at least the ``k`` best of each row, all that tie with the last one included."""
    n, width = scores.shape
    runs = width // RUN
    if runs < k:
        return np.divmod(np.arange(n * width), width)
    best = scores[:, :runs * RUN].reshape(n, runs, RUN).max(axis=2)
    if np.isnan(best).any():
        return np.divmod(np.arange(n * width), width)
    # k runs have a score no lower than this, so no row's k-th best is lower
    tops = np.partition(best, runs - k, axis=1)[:, runs - k]
    finite = np.where(np.isinf(tops), 0.0, tops)
    low = tops - (2 * 10.0 ** -DIGITS + np.abs(finite) * 1e-15)  # scores that round to the same digits
    return np.nonzero(scores >= low[:, None])


def _first_few(at: np.ndarray, partner: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best entries of each row ``at``, ties by the smaller partner."""
    order = np.lexsort((partner, -score, at))
    at, partner, score = at[order], partner[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], partner[keep], score[keep]


def similar(queries: DataFrame, gallery: DataFrame, k: int = 1, method: str = "dot", temperature: float = 1.0, keys: Sequence[str] = (),
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``keys.., id, partner, score, rank`` of the ``k`` best partners of every query.

    ``queries`` and ``gallery`` have ``id, embedding`` and the ``keys`` inside which they are compared. ``method``: ``dot``,
    ``cosine``, or ``softmax``, the mean of each product's softmax over the query's partners and over the partner's queries.
    Products are divided by ``temperature``. Ties go to the smaller partner id. Null vectors are left out.
    """
    if method not in ("dot", "cosine", "softmax"):
        raise ValueError(f"unknown method {method}")
    keys = list(keys)
    kind = dict(gallery.dtypes)["embedding"]
    kind = kind if kind == dict(queries.dtypes)["embedding"] == "array<float>" else "array<double>"
    queries, gallery = (x.where("id IS NOT NULL AND embedding IS NOT NULL").withColumn("embedding", F.col("embedding").cast(kind)) for x in (queries, gallery))
    # blocks are cut inside the keys: the largest key sets their number
    n_q, n_g = (x.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0 for x in (queries, gallery))
    qb, gb = (max(1, -(-n // max(block_rows, min(FULL_ROWS, -(-n // SIDE_BLOCKS))))) for n in (n_q, n_g))
    kinds = ", ".join(f"{c} {t}" for c, t in queries.select(*keys).dtypes)
    kinds += ", " if kinds else ""
    other = lambda blocks, name: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
    left = _placed(queries, keys, qb).select(*keys, F.col("_b").alias("_qb"), other(gb, "_gb"), "id", "_e")
    # Both sides may be one table: renamed columns keep them apart.
    right = _placed(gallery, keys, gb).select(*[F.col(c).alias(c) for c in keys], F.col("_b").alias("_gb"), other(qb, "_qb"), F.col("id").alias("_g"), F.col("_e").alias("_e"))
    meet = [*keys, "_qb", "_gb"]
    cosine = method == "cosine"

    def tiles(a: pd.DataFrame, b: pd.DataFrame):
        """(slice of the queries, slice of the partners, their products)."""
        x, y = _matrix(a["_e"], cosine), _matrix(b["_e"], cosine)
        for i in range(0, len(x), TILE_ROWS):
            for j in range(0, len(y), TILE_PARTNERS):
                yield slice(i, i + TILE_ROWS), slice(j, j + TILE_PARTNERS), x[i:i + TILE_ROWS] @ y[j:j + TILE_PARTNERS].T / temperature

    def best(key: tuple, a: pd.DataFrame, partners: np.ndarray, scored) -> pd.DataFrame:
        ids, found = a["id"].to_numpy(), []
        for rows, columns, scores in scored:
            at, to = _best_few(scores, k)
            found.append(_first_few(np.arange(len(a))[rows][at], partners[columns][to], np.round(scores[at, to], DIGITS), k))
        at, partner, score = _first_few(*(np.concatenate(x) for x in zip(*found)), k)
        return pd.DataFrame({c: key[i] for i, c in enumerate(keys)} | {"id": ids[at], "partner": partner, "score": score}, columns=[*keys, "id", "partner", "score"])

    found_schema = kinds + "id long, partner long, score double"
    if method != "softmax":
        def search(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=[*keys, "id", "partner", "score"])
            return best(key, a, b["_g"].to_numpy(), tiles(a, b))
        found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(search, found_schema)
    else:
        def partial(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            names = [*keys, "side", "node", "m", "s"]
            if not len(a) or not len(b):
                return pd.DataFrame(columns=names)
            # per side the largest product of a node and the sum of exponentials below it
            tops, sums = ([np.full(len(a), -np.inf), np.full(len(b), -np.inf)], [np.zeros(len(a)), np.zeros(len(b))])
            for rows, columns, x in tiles(a, b):
                for side, at, axis in ((0, rows, 1), (1, columns, 0)):
                    old = tops[side][at]
                    m = np.maximum(old, x.max(axis=axis))
                    grown = np.exp(x - (m[:, None] if axis else m)).sum(axis=axis)
                    sums[side][at] = sums[side][at] * np.exp(old - m) + grown
                    tops[side][at] = m
            return pd.concat([pd.DataFrame({c: key[i] for i, c in enumerate(keys)} | {"side": side, "node": ids.to_numpy(), "m": tops[side], "s": sums[side]}, columns=names)
                              for side, ids in ((0, a["id"]), (1, b["_g"]))])
        parts = cut_lineage(left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(partial, kinds + "side int, node long, m double, s double"))
        tops = parts.groupBy(*keys, "side", "node").agg(F.max("m").alias("top"))
        sums = (parts.join(tops, [*keys, "side", "node"]).groupBy(*keys, "side", "node")
                .agg((F.max("top") + F.log(F.sum(F.col("s") * F.exp(F.col("m") - F.col("top"))))).alias("_lse")))
        left = left.join(sums.where("side = 0").select(*keys, F.col("node").alias("id"), "_lse"), [*keys, "id"])
        right = right.join(sums.where("side = 1").select(*[F.col(c).alias(c) for c in keys], F.col("node").alias("_g"), F.col("_lse").alias("_lse")), [*keys, "_g"])

        def search(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame(columns=[*keys, "id", "partner", "score"])
            over, under = a["_lse"].to_numpy(), b["_lse"].to_numpy()
            scored = ((rows, columns, (np.exp(x - over[rows, None]) + np.exp(x - under[None, columns])) / 2) for rows, columns, x in tiles(a, b))
            return best(key, a, b["_g"].to_numpy(), scored)
        found = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(search, found_schema)
    order = Window.partitionBy(*keys, "id").orderBy(F.col("score").desc(), "partner")
    # at most k rows per block of the gallery reach this window
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
