import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators import augment as A
from detframe.operators import segments as S
from detframe.queries import augment as Q

LIST = "image_id long, ann_id long, runs array<struct<start: long, length: long>>"


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_pasted_lists_equal_pasted_pixels(spark, limit):
    rng = np.random.default_rng(3)

    def masks(n, most):
        return [(int(rng.integers(6)), int(i), [(int(s), int(rng.integers(0, 9))) for s in np.sort(rng.integers(0, 300, rng.integers(0, most)))]) for i in range(n)]
    own, top = masks(60, 8) + [(2, 5, [(1, 30)]), (2, 777, None), (None, 3, [(1, 9)])], masks(12, 6) + [(3, 1, None)]
    left = {}
    cover = {}
    for image, _, runs in top:
        cover.setdefault(image, set()).update(p for s, n in runs or [] for p in range(s, s + n))
    for image, ann, runs in own:
        for s, n in runs or []:
            if image is not None and n > 0:
                left[image, ann] = left.get((image, ann), 0) + sum(p not in cover.get(image, set()) for p in range(s, s + n))
    both = [(*r, False) for r in own] + [(*r, True) for r in top]
    got = A.copy_paste_masks(spark.createDataFrame(both, LIST + ", top boolean"), F.col("top"), 4, limit=limit)
    assert {(r.image_id, r.ann_id): r.area for r in got.collect()} == {k: v for k, v in left.items() if v > 4}


def test_copy_paste_makes_no_row_of_a_run(spark, sf, monkeypatch):
    def no_rows(*args, **kwargs):
        raise AssertionError("runs of ordinary images must not become rows")
    monkeypatch.setattr(S, "run_overlaps", no_rows)
    assert Q.copy_paste(spark, sf).where(F.col("area") <= 300).count() == 0
