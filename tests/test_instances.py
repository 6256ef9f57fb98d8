import random

import numpy as np
import pytest

from detframe.operators import instance_ap as I


def twin(gt, pred, void, levels, least):
    """Sequential: per class and threshold, truth by truth, then the precision curve at distinct scores. Masks are pixel sets."""
    out = {}
    for cat in {g["cat"] for g in gt}:
        truths = [g for g in gt if g["cat"] == cat]
        counted = [g for g in truths if not g["crowd"] and len(g["px"]) >= least]
        if not counted:
            continue
        aps = []
        for t in levels:
            events = []

            def iou(g, p):
                return len(g["px"] & p["px"]) / len(g["px"] | p["px"]) if g["im"] == p["im"] else 0.0
            mine = [p for p in pred if p["cat"] == cat]
            for g in counted:
                got = sorted((p["score"] for p in mine if iou(g, p) > t), reverse=True)
                events += [(s, int(i == 0)) for i, s in enumerate(got)]
            for p in mine:
                if any(iou(g, p) > t for g in truths):
                    continue
                ignored = len(p["px"] & void.get(p["im"], set()))
                for g in truths:
                    if g["im"] == p["im"]:
                        ignored += len(g["px"] & p["px"]) * (g["crowd"] + (len(g["px"]) < least))
                if ignored / len(p["px"]) <= t:
                    events.append((p["score"], 0))
            precision, recall = [1.0], [0.0]
            for s in sorted({s for s, _ in events}, reverse=True):
                above = [hit for x, hit in events if x >= s]
                precision.append(sum(above) / len(above))
                recall.append(sum(above) / len(counted))
            left, right = [recall[0], *recall[:-1]], [*recall[1:], recall[-1]]
            aps.append(sum(p * (b - a) / 2 for p, a, b in zip(precision, left, right)))
        out[cat] = (len(counted), float(np.mean(aps)), aps[0])
    return out


def runs(rows, name):
    return [(r["im"], r[name], r["cat"], start, length) for r in rows for start, length in r["runs"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_predictions_match_a_sequential_twin(spark, seed):
    rng = random.Random(seed)
    gt, pred, void = [], [], {}
    for im in range(12):
        at = 0
        for k in range(6):
            length = rng.randrange(4, 40)
            gt.append(dict(im=im, g=k, cat=rng.randrange(2), crowd=int(rng.random() < 0.2), runs=[(at, length)], px=set(range(at, at + length))))
            for j in range(rng.randrange(3)):
                a, n = max(0, at + rng.randrange(-4, 5)), max(1, length + rng.randrange(-6, 6))
                pred.append(dict(im=im, p=len(pred), cat=gt[-1]["cat"] if rng.random() < 0.8 else 1, score=rng.randrange(20) / 20, runs=[(a, n)], px=set(range(a, a + n))))
            at += length
            if rng.random() < 0.3:
                void.setdefault(im, set()).update(range(at, at + 10))
                at += 10
    fields = "image_id long, {} long, category_id long, start long, length long"
    g_runs = spark.createDataFrame(runs(gt, "g"), fields.format("g")).drop("category_id")
    p_runs = spark.createDataFrame(runs(pred, "p"), fields.format("p")).drop("category_id")
    g_rows = spark.createDataFrame([(r["im"], r["g"], r["cat"], r["crowd"]) for r in gt], "image_id long, g long, category_id long, iscrowd int")
    p_rows = spark.createDataFrame([(r["im"], r["p"], r["cat"], r["score"]) for r in pred], "image_id long, p long, category_id long, score double")
    v_runs = spark.createDataFrame([(im, x, 1) for im, px in void.items() for x in px], "image_id long, start long, length long")
    want = twin(gt, pred, void, I.LEVELS, 10)
    for target in (10, 1_000_000):  # with and without score cells
        got = {r.category_id: (r.num_gts, r.ap, r.ap50) for r in I.instance_ap(g_runs, p_runs, g_rows, p_rows, v_runs, min_region=10, target=target).collect()}
        assert set(got) == set(want)
        assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
    assert I.instance_ap(g_runs, p_runs, g_rows, p_rows.limit(0), v_runs, min_region=10).agg({"ap": "max"}).first()[0] == 0
