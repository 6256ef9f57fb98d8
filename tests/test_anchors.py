import numpy as np

from detframe.operators import anchors as A
from detframe.functions.hashing import hash_key
from pyspark.sql import functions as F

BOXES = "ann_id long, x1 double, y1 double, x2 double, y2 double"


def overlaps(sizes, shapes):
    inter = np.minimum(sizes[:, None, 0], shapes[None, :, 0]) * np.minimum(sizes[:, None, 1], shapes[None, :, 1])
    return inter / (sizes.prod(axis=1)[:, None] + shapes.prod(axis=1)[None] - inter)


def boxes(spark):
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(4, 12, (150, 2)), rng.integers(30, 50, (150, 2)), rng.integers(60, 64, (100, 2))]).astype(float)
    return sizes, spark.createDataFrame([(i, 1.0, 2.0, 1.0 + w, 2.0 + h) for i, (w, h) in enumerate(sizes.tolist())] + [(999, 5.0, 5.0, 5.0, 9.0)], BOXES)


def test_clusters_match_a_twin_run_until_stable(spark):
    sizes, frame = boxes(spark)
    first = [r.ann_id for r in frame.where("x2 > x1").orderBy(hash_key(3, F.col("ann_id")), "ann_id").limit(4).collect()]
    shapes = sizes[first]
    for _ in range(1000):
        at = overlaps(sizes, shapes).argmax(axis=1)
        new = np.array([sizes[at == c].mean(axis=0) if (at == c).any() else (0, 0) for c in range(4)])
        if np.allclose(new, shapes, rtol=1e-12):
            break
        shapes = new
    got, quality = A.kmeans_anchors(frame, 4, seed=3)
    assert np.allclose(got, sorted(shapes.tolist(), key=lambda s: s[0] * s[1]))
    assert abs(quality - overlaps(sizes, shapes).max(axis=1).mean()) < 1e-9


def test_evolution_converges_at_least_as_well_as_clusters(spark):
    sizes, frame = boxes(spark)
    shapes, quality = A.evolve_anchors(frame, 3, seed=1)
    assert abs(quality - overlaps(sizes, np.array(shapes)).max(axis=1).mean()) < 1e-9
    assert quality >= A.kmeans_anchors(frame, 3, seed=3)[1] - 0.01
    assert A.evolve_anchors(frame.limit(0), 2) == ([], 0.0)
