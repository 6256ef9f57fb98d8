import random

from pyspark.sql import functions as F

from detframe.functions import polygons as P

H = 12


def inside(parts, px, py):
    """Even-odd rule at a pixel centre."""
    x, y, hits = px + 0.5, py + 0.5, 0
    for flat in parts:
        pts = list(zip(flat[::2], flat[1::2]))
        for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1]):
            if (a <= x) != (c <= x):
                hits += b + (x - a) * (d - b) / (c - a) < y
    return hits % 2 == 1


def test_filled_pixels_follow_the_rule_in_one_shuffle(spark):
    rng = random.Random(3)
    masks = {k: [[rng.uniform(-4, 18) for _ in range(2 * rng.randrange(3, 7) + k % 2)] for _ in range(1 + k % 3)] for k in range(30)}
    masks[30] = []
    rows = [(k, parts[:1], H) for k, parts in masks.items()] + [(k, parts[1:], H) for k, parts in masks.items()]  # a mask on two rows
    frame = spark.createDataFrame([*rows, (31, None, H)], "mask long, parts array<array<double>>, height int")
    out = P.fill(frame, ["mask"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    got = {}
    for r in out.collect():
        assert r.length > 0 and r.start // H == (r.start + r.length - 1) // H
        got.setdefault(r["mask"], []).extend(range(r.start, r.start + r.length))
    for k, parts in masks.items():
        even = [p[:len(p) // 2 * 2] for p in parts]
        want = [x * H + y for x in range(20) for y in range(H) if inside(even, x, y)]
        assert sorted(got.get(k, [])) == want, k


def test_fill_in_small_lots(spark, monkeypatch):
    frame = spark.range(50).select("id", F.array(F.array(*[F.col("id") % 7 + v for v in (0.0, 1.0, 9.0, 0.0, 5.0, 11.0)])).alias("parts"), F.lit(H).alias("height"))
    whole = {tuple(r) for r in P.fill(frame, ["id"]).collect()}
    udf = P.fill_runs.func
    monkeypatch.setattr(P, "FILLED", 8)
    import pyarrow as pa
    parts = pa.array([r.parts for r in frame.orderBy("id").collect()])
    lists = udf(parts, pa.array([H] * 50)).to_pylist()
    assert {(i, r["start"], r["length"]) for i, runs in enumerate(lists) for r in runs} == whole
