import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators import tracks as K
from detframe.operators import trackers as TR
from detframe.operators.table_metrics import retrieval_scores
from detframe.streaming.monitor import drain
from detframe.streaming.tracking import track_stream

SCHEMA = "video_id long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double, score double"


def walk(n=6, frames=8):
    return [(v, f, t, 100.0 * t + 2 * f, 10.0 * t, 100.0 * t + 2 * f + 40, 10.0 * t + 50, 0.9) for v in (0, 1) for f in range(frames) for t in range(n)]


def test_perfect_tracks(spark):
    gt = spark.createDataFrame(walk(), SCHEMA)
    matches = K.clear_matches(gt, gt)
    out = K.clear_summary(gt, gt, matches).first()
    assert (out.mota, out.idsw, out.fp, out.fn, out.mt) == (1.0, 0, 0, 0, 12)
    assert K.identity_summary(gt, gt).first().idf1 == 1.0
    assert all(r.hota == pytest.approx(1.0) for r in K.hota(gt, gt).collect())


def test_identity_switch_is_counted_once(spark):
    gt = spark.createDataFrame(walk(1, 6), SCHEMA).where("video_id = 0")
    pred = gt.withColumn("track_id", F.when(F.col("frame_id") < 3, 10).otherwise(11).cast("long"))
    matches = K.clear_matches(gt, pred)
    assert K.clear_summary(gt, pred, matches).first().idsw == 1
    assert K.identity_summary(gt, pred).first().idtp == 3


@pytest.mark.parametrize("make", [TR.ByteTracker, TR.SortTracker, TR.ObservationTracker])
def test_trackers_follow_moving_boxes(spark, make):
    gt = spark.createDataFrame(walk(), SCHEMA)
    det = gt.withColumn("det_id", F.col("frame_id") * 1000 + F.col("track_id")).withColumn("category_id", F.lit(0))
    got = TR.run_tracker(det.drop("track_id"), make).join(det.select("video_id", "frame_id", "det_id", F.col("track_id").alias("true_id")), ["video_id", "frame_id", "det_id"])
    per = got.groupBy("video_id", "true_id").agg(F.countDistinct("track_id").alias("ids"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 12 and all(r.ids == 1 and r.n == 8 for r in per)


def test_stream_equals_batch(spark, tmp_path):
    det = spark.createDataFrame(walk(), SCHEMA).withColumn("det_id", F.col("frame_id") * 1000 + F.col("track_id")).withColumn("category_id", F.lit(0).cast("long")).drop("track_id")
    timed = det.withColumn("ts", F.timestamp_seconds(F.col("frame_id") * 10 + 1000))
    timed.write.parquet(str(tmp_path / "in"))
    got = drain(track_stream(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), TR.SortTracker), spark)
    rows = {(r.video_id, r.frame_id, r.det_id): r.track_id for r in got.collect()}
    want = {(r.video_id, r.frame_id, r.det_id): r.track_id for r in TR.run_tracker(det, TR.SortTracker).collect()}
    assert rows == want


def test_retrieval_against_full_ranking(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    out = retrieval_scores(df, (1, 5), block_rows=12).first()
    aps, firsts = [], []
    for i, label, e in rows:
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(e, x)), j, c) for j, c, x in rows if j != i)
        hits = [n + 1 for n, r in enumerate(ranked) if r[2] == label]
        aps.append(np.mean([(k + 1) / h for k, h in enumerate(hits)]))
        firsts.append(hits[0])
    assert out["map"] == pytest.approx(np.mean(aps))
    assert out.r1 == pytest.approx(np.mean([f <= 1 for f in firsts]))


def dense_smoothing(rows, tau):
    t = np.array([r[0] for r in rows], float)
    y = np.array([r[1:] for r in rows], float)
    scale = np.clip(tau * np.log(tau ** 3 / len(t)), 1 / tau, tau ** 2)
    kernel = np.exp(-0.5 * ((t[:, None] - t[None]) / scale) ** 2)
    return kernel @ np.linalg.solve(kernel + 1e-10 * np.eye(len(t)), y)


def test_smoothing_in_windows_equals_the_dense_solve(spark):
    rng = np.random.default_rng(6)
    rows, tracks = [], {}
    for track, n in ((1, 700), (2, 5), (3, 129)):
        frames = np.cumsum(rng.integers(1, 3, n))
        boxes = np.cumsum(rng.normal(size=(n, 4)), axis=0) + 50
        tracks[track] = [(int(f), *map(float, b)) for f, b in zip(frames, boxes)]
        rows += [(0, f, track, *b, 0.5) for f, *b in tracks[track]]
    frame = spark.createDataFrame(rows, "video_id long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double, score double")
    got = K.smooth_tracks(frame, tau=2.0, window=100, halo=45).orderBy("track_id", "frame_id").collect()
    assert len(got) == len(rows)
    for track, known in tracks.items():
        mine = [[r.x1, r.y1, r.x2, r.y2] for r in got if r.track_id == track]
        assert np.abs(np.array(mine) - dense_smoothing(known, 2.0)).max() < 1e-9


def test_tracks_are_linked_at_least_cost(spark):
    tracks = spark.createDataFrame([(0, t) for t in range(5)], "video_id long, track_id long")
    scored = spark.createDataFrame([(0, 0, 2, 1.0), (0, 0, 3, 2.0), (0, 1, 2, 1.5), (0, 1, 3, 9.0), (0, 3, 4, 1.0)], "video_id long, track_id long, next_id long, cost double")
    roots = {r.track_id: r.root_id for r in K.link_tracks(tracks, scored, 5.0, least_cost=True).collect()}
    assert roots == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
    greedy = {r.track_id: r.root_id for r in K.link_tracks(tracks, scored, 5.0).collect()}
    assert greedy[2] == 0 and greedy[3] == 3


def test_hota_of_whole_videos_equals_the_joins(spark, sf):
    from detframe.operators import tracks as K
    from detframe.queries import tables as T

    gt, pred = T.gt_tracks(spark, sf), T.pred_tracks(spark, sf)
    whole, joined = ({r.alpha: r for r in K.hota(gt, pred, limit=n).collect()} for n in (10 ** 6, 0))
    assert len(whole) == 19 and set(whole) == set(joined)
    assert all(whole[a][c] == pytest.approx(joined[a][c], abs=1e-9) for a in whole for c in ("hota", "det_a", "ass_a", "loc_a"))


def test_motion_model_equals_the_dense_filter():
    rng = np.random.default_rng(8)
    z, seen, score = (rng.uniform(20, 60, (5, 4)) for _ in range(2)), rng.uniform(20, 60, (7, 4)), rng.uniform(0, 0.9, 5)
    first, then = z
    mean, cov = TR.Motion.start(first)
    assert cov.shape == (5, 3, 4)  # 12 numbers a track in the state, not 64

    def dense(c):
        return np.stack([np.block([[np.diag(v[0]), np.diag(v[1])], [np.diag(v[1]), np.diag(v[2])]]) for v in c])
    step = np.eye(8) + np.diag(np.ones(4), 4)
    m, c = mean, dense(cov)
    for _ in range(3):
        h = m[:, 3]
        flat = np.ones_like(h)
        q = np.stack([h / 20, h / 20, 1e-2 * flat, h / 20, h / 160, h / 160, 1e-5 * flat, h / 160], axis=1)
        m, c = m @ step.T, step @ c @ step.T + q[:, :, None] ** 2 * np.eye(8)
        mean, cov = TR.Motion.predict(mean, cov)
        r = np.stack([m[:, 3] / 20, m[:, 3] / 20, 1e-1 * flat, m[:, 3] / 20], axis=1)
        gate = c[:, :4, :4] + r[:, :, None] ** 2 * np.eye(4)
        d = seen[None] - m[:, None, :4]
        assert np.allclose(TR.Motion.gate(mean, cov, seen), np.einsum("nmi,nij,nmj->nm", d, np.linalg.inv(gate), d), rtol=1e-9)
        p = c[:, :4, :4] + (r * (1 - score)[:, None])[:, :, None] ** 2 * np.eye(4)
        gain = c[:, :, :4] @ np.linalg.inv(p)
        m, c = m + np.einsum("nij,nj->ni", gain, then - m[:, :4]), c - gain @ p @ gain.transpose(0, 2, 1)
        mean, cov = TR.Motion.update(mean, cov, then, score)
        assert np.allclose(mean, m, rtol=1e-9) and np.allclose(dense(cov), c, rtol=1e-9, atol=1e-12)


def test_rows_with_a_column_of_their_own_look_for_no_path(monkeypatch):
    from detframe.functions import arrays

    calls = []
    monkeypatch.setattr(arrays.np, "full", lambda *a, full=np.full, **k: calls.append(a) or full(*a, **k))
    cost = np.random.default_rng(2).uniform(1, 2, (60, 80)) - 1.5 * np.eye(60, 80)
    rows, cols = arrays.assign_min_cost(cost)
    assert (rows == cols).all() and len(rows) == 60 and len(calls) <= 4
