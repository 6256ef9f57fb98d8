"""Anchor shapes fitted to a dataset: clustering by overlap and an evolutionary search.

The driver holds the few candidate shapes; every step is one aggregation over all boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.functions.hashing import hash_key
from detframe.session import cut_lineage

Shape = tuple[float, float]


def _sizes(boxes: DataFrame) -> DataFrame:
    """Distinct shapes with their number of boxes: rounds read these only."""
    sizes = boxes.select((F.col("x2") - F.col("x1")).cast("double").alias("w"), (F.col("y2") - F.col("y1")).cast("double").alias("h")).where("w > 0 AND h > 0")
    return cut_lineage(sizes.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")))


def _overlaps(rows: pd.DataFrame, shapes: np.ndarray) -> np.ndarray:
    """Overlap of every row with every shape (.., 2), both centred at the origin; an empty shape has 0."""
    w, h = rows["w"].to_numpy(), rows["h"].to_numpy()
    flat = shapes.reshape(-1, 2)
    inter = np.minimum(w[:, None], flat[None, :, 0]) * np.minimum(h[:, None], flat[None, :, 1])
    return (inter / ((w * h)[:, None] + (flat[:, 0] * flat[:, 1])[None] - inter)).reshape(len(rows), *shapes.shape[:-1])


def kmeans_anchors(boxes: DataFrame, k: int, seed: int = 0, rounds: int = 1000) -> tuple[list[Shape], float]:
    """(shapes by area, mean best overlap). A cluster's centre is the mean shape; an empty one becomes (0, 0).

    Runs until the centres no longer change; ``rounds`` is a ceiling that raises. A round is one aggregation over the distinct shapes.
    """
    data = _sizes(boxes)
    first = boxes.where("x2 > x1 AND y2 > y1").orderBy(hash_key(seed, F.col("ann_id")), "ann_id").limit(k).collect()  # k rows
    shapes = np.zeros((k, 2))
    shapes[:len(first)] = [(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in first]

    def sums(now: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                over = _overlaps(rows, now)
                found = pd.DataFrame({"c": over.argmax(axis=1), "n": rows["n"], "w": rows["w"] * rows["n"], "h": rows["h"] * rows["n"], "best": over.max(axis=1) * rows["n"]})
                yield found.groupby("c", as_index=False).sum()
        return data.mapInPandas(run, "c long, n long, w double, h double, best double").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("n", "w", "h", "best")]).collect()  # at most k rows

    for _ in range(rounds):
        rows = sums(shapes)
        new = np.zeros((k, 2))
        for r in rows:
            new[r["c"]] = r["w"] / r["n"], r["h"] / r["n"]
        if np.allclose(new, shapes, rtol=1e-12, atol=0):
            total = sum(r["n"] for r in rows)
            return sorted(map(tuple, new.tolist()), key=lambda s: s[0] * s[1]), sum(r["best"] for r in rows) / total if total else 0.0
        shapes = new
    raise RuntimeError(f"centres still move after {rounds} rounds")


def evolve_anchors(boxes: DataFrame, k: int, generations: int = 1000, population: int = 15, seed: int = 0, mix: float = 0.7,
                   strength: tuple[float, float] = (0.5, 1.0), tolerance: float = 1e-4) -> tuple[list[Shape], float]:
    """Differential evolution of ``k`` shapes for the mean best overlap, with ``population`` members per parameter.

    Runs until the spread of the members' overlaps is at most ``tolerance`` of their mean; ``generations`` is a ceiling.
    All trial vectors of a generation are scored in one pass over the distinct shapes.
    """
    data = _sizes(boxes)
    top = data.agg(F.max("w").alias("w"), F.max("h").alias("h"), F.sum("n").alias("n")).first()
    if not top["n"]:
        return [], 0.0
    draw = np.random.default_rng(seed)
    bounds, size = np.array([top["w"], top["h"]] * k), population * 2 * k

    def score(members: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for rows in batches:
                for at in range(0, len(rows), 4096):
                    part = rows.iloc[at:at + 4096]
                    total += part["n"].to_numpy() @ _overlaps(part, members.reshape(size, k, 2)).max(axis=2)
            yield pd.DataFrame({"m": np.arange(size), "s": total})
        rows = data.mapInPandas(run, "m long, s double").groupBy("m").agg(F.sum("s").alias("s")).collect()  # one row per member
        out = np.zeros(size)
        for r in rows:
            out[r["m"]] = r["s"] / top["n"]
        return out

    members = draw.uniform(1e-3, bounds, (size, 2 * k))
    fitness = score(members)
    for _ in range(generations):
        if fitness.std() <= tolerance * abs(fitness.mean()):
            break
        pick = np.array([draw.choice(size, 2, replace=False) for _ in range(size)])
        mutant = members[fitness.argmax()] + draw.uniform(*strength) * (members[pick[:, 0]] - members[pick[:, 1]])
        cross = draw.random((size, 2 * k)) < mix
        cross[np.arange(size), draw.integers(2 * k, size=size)] = True
        # What leaves the bounds is drawn anew.
        mutant = np.where((mutant < 1e-3) | (mutant > bounds), draw.uniform(1e-3, bounds, mutant.shape), mutant)
        trials = np.where(cross, mutant, members)
        got = score(trials)
        better = got > fitness
        members[better], fitness[better] = trials[better], got[better]
    best = members[fitness.argmax()].reshape(k, 2)
    return sorted(map(tuple, best.tolist()), key=lambda s: s[0] * s[1]), float(fitness.max())
