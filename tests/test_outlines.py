import random

from detframe.operators.outlines import outline_rings, ring_measures

HEIGHT = 9


def filled(rings):
    """Pixels whose centre an odd number of ring sides lies left of."""
    out = set()
    for x in range(14):
        for y in range(HEIGHT):
            crossings = 0
            for ring in rings:
                for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                    crossings += x0 == x1 and x0 <= x and min(y0, y1) <= y < max(y0, y1)
            if crossings % 2:
                out.add((x, y))
    return out


def test_filling_the_outline_gives_the_runs_back(spark):
    rng = random.Random(5)
    masks = {k: {(x, y) for x in range(1 + k % 12) for y in range(HEIGHT) if rng.random() < (0.3, 0.5, 0.9)[k % 3]} for k in range(24)}
    masks[24] = {(x, y) for x in range(5) for y in range(5) if (x, y) not in {(2, 2), (1, 3), (3, 1)}}  # holes
    masks[25] = {(0, 0), (1, 1), (2, 0), (1, 2)}  # touching corners
    masks[26] = {(x, y) for x in range(12) for y in range(HEIGHT)}  # runs over whole columns
    rows = [(k, x * HEIGHT + y, 1, HEIGHT) for k, px in masks.items() for x, y in px]
    rows += [(26, 3 * HEIGHT, 2 * HEIGHT, HEIGHT)]  # a run over a column border, twice covered
    frame = spark.createDataFrame(rows, "mask long, start long, length long, height long")
    rings = outline_rings(frame, ["mask"])
    got = {}
    for r in rings.orderBy("mask", "ring", "nth").collect():
        got.setdefault(r.mask, {}).setdefault(r.ring, []).append((r.x, r.y))
    for k, px in masks.items():
        mine = list(got.get(k, {}).values())
        assert filled(mine) == px, k
        for ring in mine:
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1])), "sides are straight"
    assert len(got[25]) == 3 and len(got[24]) == 2 and len(got[26]) == 1 and len(got[26][min(got[26])]) == 4
    measured = {r["mask"]: r for r in ring_measures(rings, ["mask"]).collect()}
    for k, px in masks.items():
        if px:
            sides = sum((x + dx, y + dy) not in px for x, y in px for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
            assert measured[k].area == len(px) and measured[k].perimeter == sides
    assert outline_rings(frame.limit(0), ["mask"]).count() == 0


def test_tracing_and_joining_give_the_same_rings(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(40 if k % 2 else 12) * HEIGHT + rng.randrange(HEIGHT), rng.randrange(1, 2 * HEIGHT), HEIGHT) for k in range(30) for _ in range(1 + k)]
    frame = spark.createDataFrame(rows, "mask long, start long, length long, height long")
    traced, joined, both = ({tuple(r) for r in outline_rings(frame, ["mask"], limit=limit).collect()} for limit in (50_000, 0, 30))
    assert traced == joined == both and len(traced) > 300


def test_tracing_writes_no_joins_to_disk(spark):
    frame = spark.createDataFrame([(k, s, 3, HEIGHT) for k in range(20) for s in (0, 9, 20)], "mask long, start long, length long, height long")
    plan = ring_measures(outline_rings(frame, ["mask"]), ["mask"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
