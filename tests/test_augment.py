import math
import random

import pytest
from pyspark.sql import functions as F

from detframe.functions import polygons as P
from detframe.operators import augment as A
from detframe.operators.segments import box_run_list

BOXES = "image_id long, ann_id long, x1 double, y1 double, x2 double, y2 double, width long, height long, poly array<double>"


def table(spark):
    rows = []
    for i in range(40):
        x, y = float(i * 7 % 60), float(i * 11 % 40)
        rows.append((i, i, x, y, x + 30, y + 20, 100, 80, [x, y, x + 30, y, x + 30, y + 20, x, y + 20]))
    return spark.createDataFrame(rows, BOXES)


def test_polygons_follow_their_boxes(spark):
    flipped = A.random_flip(table(spark), {"horizontal": 0.4, "diagonal": 0.4}, 3, polygon="poly")
    cropped = A.random_crop(table(spark), 0.4, 0.9, 5, polygon="poly")
    for out in (flipped, cropped):
        rows = out.select("x1", "y1", "x2", "y2", *[v.alias(f"b{i}") for i, v in enumerate(P.bbox(F.col("poly")))], P.area(F.col("poly")).alias("area")).collect()
        assert len(rows) > 10
        for r in rows:
            assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx((r.b0, r.b1, r.b2, r.b3))
            assert r.area == pytest.approx((r.x2 - r.x1) * (r.y2 - r.y1)), "an upright rectangle stays one"


def test_rotated_polygons_keep_their_vertices(spark):
    out = A.random_rotate(table(spark), 10.0, 7, polygon="poly").collect()
    known = {r.ann_id: r for r in table(spark).collect()}
    whole = 0
    for r in out:
        a = math.radians(r.angle)
        old = known[r.ann_id].poly
        turned = [(math.cos(a) * (x - 50) - math.sin(a) * (y - 40) + 50, math.sin(a) * (x - 50) + math.cos(a) * (y - 40) + 40) for x, y in zip(old[::2], old[1::2])]
        assert all(-1e-9 <= x <= 100 + 1e-9 and -1e-9 <= y <= 80 + 1e-9 for x, y in zip(r.poly[::2], r.poly[1::2]))
        if all(0 <= x <= 100 and 0 <= y <= 80 for x, y in turned):
            whole += 1
            got = {(round(x, 6), round(y, 6)) for x, y in zip(r.poly[::2], r.poly[1::2])}
            assert got == {(round(x, 6), round(y, 6)) for x, y in turned}
    assert whole > 10


def test_trial_rounds_change_nothing(spark):
    boxes = table(spark).drop("poly")
    images = boxes.select("image_id", "width", "height").distinct()
    propose = lambda rows: rows.withColumn("w", (F.col("image_id") * 7 + F.col("trial") * 3) % 11)
    judge = lambda rows: rows.where("w = 0 AND image_id % 5 <> 0").select("image_id", "trial", "w")
    want = {i: next(t for t in range(1, 31) if (i * 7 + t * 3) % 11 == 0) for i in range(40) if i % 5}
    for first, growth in ((1, 1), (2, 4), (50, 1)):
        assert {r.image_id: r.trial for r in A.first_fit(images, 30, propose, judge, first, growth).collect()} == want


def pasting_twin(masks, pasted, box_shift, area_thr, height=20):
    """Pixel sets, object by object."""
    def box(px):
        return min(p // height for p in px), min(p % height for p in px), max(p // height for p in px) + 1, max(p % height for p in px) + 1
    out = set()
    for image, ann, px in masks:
        rest = px - set().union(*[q for i, _, q in pasted if i == image])
        if rest == px or rest and (len(rest) > area_thr or all(abs(a - b) <= box_shift for a, b in zip(box(rest), box(px)))):
            out.add((image, ann, False, *box(rest), len(rest)))
    return out | {(i, a, True, *box(px), len(px)) for i, a, px in pasted}


def test_pasting_by_images_and_by_joins_follows_the_pixels(spark):
    rng = random.Random(4)

    def made(n, first):
        out = []
        for k in range(n):
            cuts = sorted(rng.sample(range(400), 2 * rng.randrange(1, 7)))
            out.append((k % 6, first + k, [(s, e - s) for s, e in zip(cuts[::2], cuts[1::2])]))
        return out
    masks, pasted = made(40, 0), [m for m in made(14, 100) if m[0] != 3]
    frames = [spark.createDataFrame([(i, a, r, 20) for i, a, r in rows], "image_id long, ann_id long, runs array<struct<start: long, length: long>>, height long") for rows in (masks, pasted)]
    pixels = [[(i, a, {p for s, n in r for p in range(s, s + n)}) for i, a, r in rows] for rows in (masks, pasted)]
    want = pasting_twin(*pixels, 2, 40)
    for limit in (100_000, 30, 0):
        got = A.pasted_objects(*frames, 2.0, 40.0, limit=limit).select("image_id", "ann_id", "pasted", "x1", "y1", "x2", "y2", "area")
        assert {tuple(r) for r in got.collect()} == want, limit
    assert any(not r[2] for r in want) and len(want) < len(masks) + len(pasted)


def test_pasted_masks_are_not_shuffled_as_runs(spark):
    boxes = table(spark).drop("poly").where("image_id < 8")
    out = A.pasted_objects(boxes, boxes.withColumn("image_id", F.col("image_id") - 1), runs=box_run_list())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_the_angle_of_a_shear_is_drawn_once_a_row(spark, sf):
    from detframe.queries import augment

    def written(df, word):
        return df._jdf.queryExecution().optimizedPlan().toString().lower().count(word)
    boxes = augment._boxes(spark, sf)
    assert written(A.shear(boxes, 20.0, "x", 51), "tan(") == 1
    assert written(A.random_affine(boxes, 10.0, 0.1, (0.5, 1.5), 2.0, 61), "tan(") <= 12
