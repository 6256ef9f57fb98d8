"""Tracks as tables ``(video_id, frame_id, track_id, x1..y2, score)``: gaps, smoothing and tracking metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions import boxes as B
from detframe.functions.arrays import assign_min_cost
from detframe.operators.overlap import overlap_pairs
from detframe.plans.grouped import GROUP_LIMIT, scan_groups, scan_states, split_by_size
from detframe.session import cut_lineage

TRACK = ["video_id", "track_id"]
ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def interpolate_gaps(tracks: DataFrame, min_frames: int = 5, max_gap: int = 20) -> DataFrame:
    """Fill gaps shorter than ``max_gap`` frames linearly, with score 1.

    Tracks of one or two rows are dropped; tracks up to ``min_frames`` rows are kept as they are.
    """
    order = Window.partitionBy(*TRACK).orderBy("frame_id")
    sized = tracks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*TRACK))).where("_n > 2")
    nxt = sized.withColumns({"_f": F.lead("frame_id").over(order), **{f"_{c}": F.lead(c).over(order) for c in B.COORDS}})
    gap = F.col("_f") - F.col("frame_id")
    holes = nxt.where((F.col("_n") > min_frames) & (gap > 1) & (gap < max_gap)).withColumn(
        "_j", F.explode(F.sequence(F.col("frame_id") + 1, F.col("_f") - 1)))
    share = (F.col("_j") - F.col("frame_id")) / gap
    filled = holes.select("video_id", F.col("_j").alias("frame_id"), "track_id",
                          *[(F.col(c) + share * (F.col(f"_{c}") - F.col(c))).alias(c) for c in B.COORDS], F.lit(1.0).alias("score"))
    return sized.select("video_id", "frame_id", "track_id", *B.COORDS, "score").unionByName(filled)


def frame_gaps(tracks: DataFrame) -> DataFrame:
    """Tracks with holes: ``(video_id, track_id, frame_id, gap)``."""
    order = Window.partitionBy(*TRACK).orderBy("frame_id")
    return (tracks.withColumn("gap", F.lead("frame_id").over(order) - F.col("frame_id")).where("gap > 1")
            .select(*TRACK, "frame_id", "gap"))


def velocity(tracks: DataFrame, steps: int = 3) -> DataFrame:
    """Unit direction of the centre over the last ``steps`` rows of the track: ``vx, vy``."""
    order = Window.partitionBy(*TRACK).orderBy("frame_id")
    cx, cy = B.center(B.box())
    dx, dy = cx - F.lag(cx, steps).over(order), cy - F.lag(cy, steps).over(order)
    norm = F.sqrt(dx * dx + dy * dy) + F.lit(1e-6)
    return tracks.withColumn("vx", dx / norm).withColumn("vy", dy / norm)


def smooth_tracks(tracks: DataFrame, tau: float = 10.0, window: int = 512, halo: int = 128) -> DataFrame:
    """Gaussian-process smoothing of each coordinate over time, with a fixed length scale set by track length.

    The scale shrinks with the rows of a track and stays at ``1 / tau`` from ``tau ** 3`` rows on. A kernel that narrow is
    near the identity and its inverse falls off within a few frames, so longer tracks are solved in windows of ``window`` rows
    that see ``halo`` rows on either side. No solve takes more than ``max(tau ** 3, window + 2 * halo)`` rows.
    """
    longest = max(tau ** 3, window)
    track, order = Window.partitionBy(*TRACK), Window.partitionBy(*TRACK).orderBy("frame_id")
    rows = tracks.select(*TRACK, "frame_id", *B.COORDS, "score").withColumn("_n", F.count(F.lit(1)).over(track)).withColumn("_k", F.row_number().over(order) - 1)
    mine, place = F.floor(F.col("_k") / window), F.col("_k") % window
    near = F.array_compact(F.array(mine, F.when((place < halo) & (mine > 0), mine - 1),
                                   F.when((place >= window - halo) & ((mine + 1) * window < F.col("_n")), mine + 1)))
    cut = rows.withColumn("_own", F.when(F.col("_n") > longest, mine).otherwise(0)).withColumn(
        "_w", F.explode(F.when(F.col("_n") > longest, near).otherwise(F.array(F.lit(0).cast("long")))))

    def smooth(rows):
        t = rows["frame_id"].astype(float)
        scale = np.clip(tau * np.log(tau ** 3 / rows["_n"][0]), 1 / tau, tau ** 2)
        kernel = np.exp(-0.5 * ((t[:, None] - t[None]) / scale) ** 2)
        fit = kernel @ np.linalg.solve(kernel + 1e-10 * np.eye(len(t)), np.stack([rows[c] for c in B.COORDS], axis=1))
        own = rows["_own"] == rows["_w"]
        return {"frame_id": rows["frame_id"][own], **{c: fit[own, i] for i, c in enumerate(B.COORDS)}, "score": rows["score"][own]}

    return scan_groups(cut.drop("_k"), [*TRACK, "_w"], ["frame_id"], smooth,
                       "video_id long, track_id long, _w long, frame_id long, x1 double, y1 double, x2 double, y2 double, score double").drop("_w")


def frame_pairs(gt: DataFrame, pred: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    """Overlapping (truth, prediction) pairs per frame: ``(video_id, frame_id, gt_track, pred_track, sim)``."""
    cols = ["video_id", "frame_id", "track_id", *B.COORDS]
    pairs = overlap_pairs(gt.select(*cols), pred.select(*cols), ["video_id", "frame_id"], "g_", "p_", min_overlap=min_overlap)
    return pairs.select("video_id", "frame_id", F.col("g_track_id").alias("gt_track"), F.col("p_track_id").alias("pred_track"), F.col("iou").alias("sim"))


def shared_frames(gt: DataFrame, pred: DataFrame, thr: float = 0.5) -> DataFrame:
    """Frames each pair of tracks overlaps enough in."""
    return frame_pairs(gt, pred, thr).groupBy("video_id", "gt_track", "pred_track").agg(F.count(F.lit(1)).alias("frames"))


def clear_matches(gt: DataFrame, pred: DataFrame, thr: float = 0.5) -> DataFrame:
    """Frame-by-frame matches ``(video_id, frame_id, gt_track, pred_track, sim, switched)``.

    A match of the previous frame is kept when it still overlaps; the rest are assigned at most overlap. The
    state of a video is one id per track; frames stream through in order, so a long video is never held.
    """
    pairs = frame_pairs(gt, pred, thr)
    key = ["video_id", "frame_id"]
    # frames with rows on both sides reset the continuity even when nothing overlaps
    both = gt.select(*key).distinct().join(pred.select(*key).distinct(), key)
    rows = both.join(pairs, key, "left").na.fill(-1, ["gt_track", "pred_track"]).na.fill(0.0, ["sim"])

    def step(state, rows):
        real = rows["gt_track"] >= 0
        g, gi = np.unique(rows["gt_track"][real], return_inverse=True)
        p, pi = np.unique(rows["pred_track"][real], return_inverse=True)
        score = np.zeros((len(g), len(p)))
        sim = np.zeros((len(g), len(p)))
        sim[gi, pi] = rows["sim"][real]
        stay = np.array([state["now"].get(a, -1) for a in g])
        score[gi, pi] = sim[gi, pi] + 1000 * (stay[gi] == p[pi])
        i, j = assign_min_cost(-score)
        ok = score[i, j] > 0
        i, j = i[ok], j[ok]
        switched = np.array([state["last"].get(a, b) != b for a, b in zip(g[i], p[j])], dtype=bool)
        state["now"] = dict(zip(g[i], p[j]))
        state["last"].update(state["now"])
        return {"frame_id": np.repeat(rows["frame_id"][:1], len(i)), "gt_track": g[i], "pred_track": p[j], "sim": sim[i, j], "switched": switched}

    return scan_states(rows, ["video_id"], ["frame_id"], ["gt_track", "pred_track"], lambda: {"now": {}, "last": {}}, step,
                       "video_id long, frame_id long, gt_track long, pred_track long, sim double, switched boolean")


def tracking_errors(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """``(video_id, frame_id, track_id, kind)`` with kind fn, fp or idsw."""
    key = ["video_id", "frame_id"]
    fn = gt.select(*key, "track_id").join(matches.select(*key, F.col("gt_track").alias("track_id")), [*key, "track_id"], "left_anti")
    fp = pred.select(*key, "track_id").join(matches.select(*key, F.col("pred_track").alias("track_id")), [*key, "track_id"], "left_anti")
    sw = matches.where("switched").select(*key, F.col("gt_track").alias("track_id"))
    return (fn.withColumn("kind", F.lit("fn")).unionByName(fp.withColumn("kind", F.lit("fp"))).unionByName(sw.withColumn("kind", F.lit("idsw"))))


def clear_summary(gt: DataFrame, pred: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MOTA, MOTP, switches, fragmentations, mostly tracked and mostly lost tracks, in total or per ``by``."""
    by = list(by)
    key = ["video_id", "frame_id", "track_id"]
    marked = gt.select(*key).join(matches.select("video_id", "frame_id", F.col("gt_track").alias("track_id"), F.lit(1).alias("_m")), key, "left")
    order = Window.partitionBy(*TRACK).orderBy("frame_id")
    hit = F.coalesce("_m", F.lit(0))
    runs = marked.withColumn("_h", hit).withColumn("_start", F.when((F.col("_h") == 1) & (F.coalesce(F.lag("_h").over(order), F.lit(0)) == 0), 1).otherwise(0))
    per = runs.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("hits"), F.sum("_start").alias("runs"))
    tracks = per.groupBy(*by).agg(
        F.sum("n").alias("gt"), F.sum("hits").alias("tp"), F.sum(F.greatest(F.col("runs") - 1, F.lit(0))).alias("frag"),
        F.sum((F.col("hits") / F.col("n") > 0.8).cast("long")).alias("mt"), F.sum((F.col("hits") / F.col("n") < 0.2).cast("long")).alias("ml"))
    found = matches.groupBy(*by).agg(F.sum("sim").alias("_sim"), F.sum(F.col("switched").cast("long")).alias("idsw"))
    preds = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("_pred"))
    if by:
        out = tracks.join(found, by, "left").join(preds, by, "left").na.fill(0)
    else:
        out = tracks.join(F.broadcast(found)).join(F.broadcast(preds))  # one row each
    out = out.withColumn("fp", F.col("_pred") - F.col("tp")).withColumn("fn", F.col("gt") - F.col("tp"))
    return out.select(*by, "gt", "tp", "fp", "fn", "idsw", "frag", "mt", "ml",
                      ((F.col("tp") - F.col("fp") - F.col("idsw")) / F.col("gt")).alias("mota"),
                      (F.col("_sim") / F.nullif(F.col("tp"), F.lit(0))).alias("motp"))


def identity_summary(gt: DataFrame, pred: DataFrame, thr: float = 0.5) -> DataFrame:
    """IDF1, precision and recall: whole tracks of a video are assigned to each other at most shared frames.

    Minimising missed plus false frames over one-to-one track pairs equals maximising shared frames.
    """
    shared = shared_frames(gt, pred, thr)

    def assign(rows):
        g, gi = np.unique(rows["gt_track"], return_inverse=True)
        p, pi = np.unique(rows["pred_track"], return_inverse=True)
        frames = np.zeros((len(g), len(p)))
        frames[gi, pi] = rows["frames"]
        i, j = assign_min_cost(-frames)
        return {"idtp": np.array([frames[i, j].sum()], dtype=np.int64)}

    best = scan_groups(shared, ["video_id"], ["gt_track", "pred_track"], assign, "video_id long, idtp long").agg(F.sum("idtp").alias("idtp"))
    sizes = gt.agg(F.count(F.lit(1)).alias("gt")).join(F.broadcast(pred.agg(F.count(F.lit(1)).alias("pred"))))  # one row
    out = best.join(F.broadcast(sizes))
    return out.select("idtp", (F.col("idtp") / F.col("pred")).alias("idp"), (F.col("idtp") / F.col("gt")).alias("idr"),
                      (2 * F.col("idtp") / (F.col("gt") + F.col("pred"))).alias("idf1"))


def alignment(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Global similarity of track pairs over the video, the weight of HOTA's frame assignment."""
    pairs = frame_pairs(gt, pred)
    key = ["video_id", "frame_id"]
    rows = pairs.groupBy(*key, "gt_track").agg(F.sum("sim").alias("_r"))
    cols = pairs.groupBy(*key, "pred_track").agg(F.sum("sim").alias("_c"))
    soft = (pairs.join(rows, [*key, "gt_track"]).join(cols, [*key, "pred_track"])
            .withColumn("_s", F.col("sim") / (F.col("_r") + F.col("_c") - F.col("sim"))))
    sums = soft.groupBy("video_id", "gt_track", "pred_track").agg(F.sum("_s").alias("_p"))
    ng = gt.groupBy("video_id", F.col("track_id").alias("gt_track")).agg(F.count(F.lit(1)).alias("_ng"))
    np_ = pred.groupBy("video_id", F.col("track_id").alias("pred_track")).agg(F.count(F.lit(1)).alias("_np"))
    return sums.join(ng, ["video_id", "gt_track"]).join(np_, ["video_id", "pred_track"]).select(
        "video_id", "gt_track", "pred_track", (F.col("_p") / (F.col("_ng") + F.col("_np") - F.col("_p"))).alias("align"), "_ng", "_np")


def hota(gt: DataFrame, pred: DataFrame, alphas: Sequence[float] = ALPHAS, limit: int = GROUP_LIMIT) -> DataFrame:
    """``(alpha, hota, det_a, ass_a, loc_a)`` over all videos together.

    Frames are assigned independently of each other by alignment times overlap. The overlaps of a video of up to ``limit``
    pairs are rated in one piece and leave it as one row per alpha; longer videos go through joins, frame by frame.
    """
    pairs = cut_lineage(frame_pairs(gt, pred))
    small, large = split_by_size(pairs, ["video_id"], limit)
    parts = _video_sums(small, gt, pred, alphas)
    if large is not None:
        videos = large.select("video_id").distinct()
        parts = parts.unionByName(_joined_sums(large, *[t.join(videos, "video_id", "left_semi") for t in (gt, pred)], alphas))
    sums = parts.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "s", "a")]).where("tp > 0")
    sizes = gt.agg(F.count(F.lit(1)).alias("gt")).join(F.broadcast(pred.agg(F.count(F.lit(1)).alias("pred"))))  # one row
    out = sums.join(F.broadcast(sizes))
    det_a, ass_a = F.col("tp") / (F.col("gt") + F.col("pred") - F.col("tp")), F.col("a") / F.col("tp")
    return out.select("alpha", F.sqrt(det_a * ass_a).alias("hota"), det_a.alias("det_a"), ass_a.alias("ass_a"), (F.col("s") / F.col("tp")).alias("loc_a"))


def _frame_choice(align: np.ndarray, sim: np.ndarray, gi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Places of the pairs of one frame that are assigned at most alignment times overlap."""
    g, gi = np.unique(gi, return_inverse=True)
    p, pi = np.unique(pi, return_inverse=True)
    score, place = np.zeros((len(g), len(p))), np.zeros((len(g), len(p)), dtype=np.int64)
    score[gi, pi] = align * sim
    place[gi, pi] = np.arange(len(sim))
    i, j = assign_min_cost(-score)
    return place[i, j][score[i, j] > 0]


def _video_sums(pairs: DataFrame, gt: DataFrame, pred: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """``(alpha, tp, s, a)`` of each video from its pairs and the lengths of its tracks, which travel as rows before them."""
    none = F.lit(-1).cast("long")

    def lengths(tracks: DataFrame, kind: int) -> DataFrame:
        ids = [F.col("track_id") if kind == k else none for k in (0, 1)]
        counted = tracks.groupBy("video_id", "track_id").agg(F.count(F.lit(1)).cast("double").alias("sim"))
        return counted.select("video_id", F.lit(kind).alias("kind"), none.alias("frame_id"), ids[0].alias("gt_track"), ids[1].alias("pred_track"), "sim")

    rows = lengths(gt, 0).unionByName(lengths(pred, 1)).unionByName(pairs.withColumn("kind", F.lit(2)))
    levels = np.array([float(a) for a in alphas])

    def rate(rows):
        kind, both = rows["kind"], rows["kind"] == 2
        if not both.any():
            return None
        g, gi = np.unique(rows["gt_track"][both], return_inverse=True)
        p, pi = np.unique(rows["pred_track"][both], return_inverse=True)
        ng = rows["sim"][kind == 0][np.searchsorted(rows["gt_track"][kind == 0], g)]
        np_ = rows["sim"][kind == 1][np.searchsorted(rows["pred_track"][kind == 1], p)]
        frame, sim = rows["frame_id"][both], rows["sim"][both]
        cuts = np.append(np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]]), len(frame))
        fi = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        side = []
        for ids, count in ((gi, len(g)), (pi, len(p))):
            at = np.unique(fi * count + ids, return_inverse=True)[1]
            side.append(np.bincount(at, sim)[at])
        tracks, ki = np.unique(gi * len(p) + pi, return_inverse=True)
        size = ng[tracks // len(p)] + np_[tracks % len(p)]
        soft = np.bincount(ki, sim / (side[0] + side[1] - sim))
        align = (soft / (size - soft))[ki]
        got = np.concatenate([a + _frame_choice(align[a:b], sim[a:b], gi[a:b], pi[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        out = {"alpha": levels, "tp": np.zeros(len(levels), np.int64), "s": np.zeros(len(levels)), "a": np.zeros(len(levels))}
        for n, level in enumerate(levels):
            hit = got[sim[got] >= level - 2.220446049250313e-16]
            m = np.bincount(ki[hit], minlength=len(tracks))
            out["tp"][n], out["s"][n], out["a"][n] = len(hit), sim[hit].sum(), (m * m / (size - m)).sum()
        return out

    return scan_groups(rows, ["video_id"], ["kind", "frame_id", "gt_track", "pred_track"], rate,
                       "video_id long, alpha double, tp long, s double, a double").drop("video_id")


def _joined_sums(pairs: DataFrame, gt: DataFrame, pred: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """:func:`_video_sums` of videos too long for one task, in total."""
    weights = alignment(gt, pred)
    weighted = pairs.join(weights.select("video_id", "gt_track", "pred_track", "align"), ["video_id", "gt_track", "pred_track"])

    def assign(rows):
        got = _frame_choice(rows["align"], rows["sim"], rows["gt_track"], rows["pred_track"])
        return {c: rows[c][got] for c in ("gt_track", "pred_track", "sim")}

    got = scan_groups(weighted, ["video_id", "frame_id"], ["gt_track", "pred_track"], assign,
                      "video_id long, frame_id long, gt_track long, pred_track long, sim double")
    levels = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    hits = got.select("*", levels).where("sim >= alpha - 2.220446049250313e-16")
    per = hits.groupBy("alpha", "video_id", "gt_track", "pred_track").agg(F.count(F.lit(1)).alias("m"), F.sum("sim").alias("s"))
    rated = per.join(weights.select("video_id", "gt_track", "pred_track", "_ng", "_np"), ["video_id", "gt_track", "pred_track"])
    return rated.groupBy("alpha").agg(F.sum("m").alias("tp"), F.sum("s").alias("s"),
                                      F.sum(F.col("m") * F.col("m") / (F.col("_ng") + F.col("_np") - F.col("m"))).alias("a"))


def tube_overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Spatio-temporal IoU: common area over all frames divided by union area over all frames.

    Only pairs that meet in some frame are listed; frames where one side is absent count in the union.
    """
    cols = ["video_id", "frame_id", "track_id", *B.COORDS]
    pairs = overlap_pairs(gt.select(*cols), pred.select(*cols), ["video_id", "frame_id"], "g_", "p_")
    inter = pairs.groupBy("video_id", F.col("g_track_id").alias("gt_track"), F.col("p_track_id").alias("pred_track")).agg(
        F.sum(B.intersection(B.box("g_"), B.box("p_"))).alias("_i"))
    ga = gt.groupBy("video_id", F.col("track_id").alias("gt_track")).agg(F.sum(B.area(B.box())).alias("_g"))
    pa = pred.groupBy("video_id", F.col("track_id").alias("pred_track")).agg(F.sum(B.area(B.box())).alias("_p"))
    both = inter.join(ga, ["video_id", "gt_track"]).join(pa, ["video_id", "pred_track"])
    return both.select("video_id", "gt_track", "pred_track", (F.col("_i") / (F.col("_g") + F.col("_p") - F.col("_i"))).alias("iou"))


#: Fixed values of the video protocol: ranges of a tube's mean area.
TUBE_AREAS = {"all": (0.0, 1e10), "small": (0.0, 16384.0), "medium": (16384.0, 65536.0), "large": (65536.0, 1e10)}


def tube_table(tracks: DataFrame, ident: str) -> DataFrame:
    """Tracks as the boxes of their video: ``image_id, category_id, score, area`` (mean over frames) and a packed id ``ident``.

    Scores are means, rounded to nine digits so that their order does not hang on the order of summation."""
    size = tracks.groupBy(*TRACK).agg(F.avg(B.area(B.box())).alias("area"))
    scored = tracks if "score" in tracks.columns else tracks.withColumn("score", F.lit(1.0))
    packed = F.shiftleft(F.col("video_id"), 32).bitwiseOR(F.col("track_id")).alias(ident)
    return track_results(scored).join(size, TRACK).select(packed, F.col("video_id").alias("image_id"), "track_id", "category_id", F.round("score", 9).alias("score"), "area")


def video_matches(gt: DataFrame, pred: DataFrame, areas: dict[str, tuple[float, float]] = TUBE_AREAS, max_det: int = 100) -> tuple[DataFrame, DataFrame]:
    """(matches of the detection protocol on whole tubes, truths per class and area range): what its AP and recall tables read.

    A video stands for an image and a track for a box; overlap is spatio-temporal, area the mean over a tube's frames. All
    thresholds and ranges of a tube travel in its two bit masks.
    """
    from detframe.operators.coco_metrics import count_real, match_masks

    truth, found = tube_table(gt, "ann_id"), tube_table(pred, "det_id")
    order = Window.partitionBy("image_id", "category_id").orderBy(F.col("score").desc(), "det_id")
    top = cut_lineage(found.withColumn("det_rank", F.row_number().over(order).cast("int")).where(F.col("det_rank") <= max_det))
    pairs = (tube_overlaps(gt, pred).withColumnRenamed("video_id", "image_id")
             .join(truth.select("image_id", F.col("track_id").alias("gt_track"), "ann_id", F.col("category_id").alias("_c"), "area"), ["image_id", "gt_track"])
             .join(top.select("image_id", F.col("track_id").alias("pred_track"), "det_id", "det_rank", "category_id"), ["image_id", "pred_track"]).where("_c = category_id"))
    keys = ["image_id", "category_id"]
    listed = pairs.select(*keys, "det_id", "det_rank", "ann_id", F.col("iou").alias("value"), F.lit(0).alias("crowd"), "area")
    return cut_lineage(match_masks(top, listed, keys, areas=areas, max_det=max_det)), count_real(truth.withColumn("iscrowd", F.lit(0)), areas)


def track_results(tracks: DataFrame) -> DataFrame:
    """Per (video, track): mean score, majority label (ties to the lowest), frames covered."""
    votes = tracks.groupBy(*TRACK, "category_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    return votes.groupBy(*TRACK).agg((F.sum("s") / F.sum("n")).alias("score"), F.sum("n").alias("frames"),
                                     F.max_by("category_id", F.struct("n", -F.col("category_id"))).alias("category_id"))


def link_candidates(tracks: DataFrame, max_gap: int, max_dist: float) -> DataFrame:
    """Pairs of tracks where one starts up to ``max_gap`` frames after, and near, the other's end.

    Ends and starts meet through cells of (frame gap, distance), so no all-pairs join is made.
    """
    first = tracks.groupBy(*TRACK).agg(F.min_by(F.struct("frame_id", *B.COORDS), "frame_id").alias("a"),
                                       F.max_by(F.struct("frame_id", *B.COORDS), "frame_id").alias("z"))

    def point(side):
        return [F.col(f"{side}.frame_id").alias("f"), ((F.col(f"{side}.x1") + F.col(f"{side}.x2")) / 2).alias("cx"),
                ((F.col(f"{side}.y1") + F.col(f"{side}.y2")) / 2).alias("cy")]

    def cells(df, spread):
        t, gx, gy = F.floor(F.col("f") / max_gap), F.floor(F.col("cx") / max_dist), F.floor(F.col("cy") / max_dist)
        if not spread:
            return df.withColumns({"_t": t, "_gx": gx, "_gy": gy})
        return (df.withColumn("_t", F.explode(F.sequence(t, t + 1))).withColumn("_gx", F.explode(F.sequence(gx - 1, gx + 1)))
                .withColumn("_gy", F.explode(F.sequence(gy - 1, gy + 1))))

    starts = cells(first.select("video_id", F.col("track_id").alias("next_id"), *point("a")), False).withColumnsRenamed({"f": "f2", "cx": "cx2", "cy": "cy2"})
    ends = cells(first.select(*TRACK, *point("z")), True)
    both = ends.join(starts, ["video_id", "_t", "_gx", "_gy"]).where("track_id <> next_id")
    gap = F.col("f2") - F.col("f")
    dx, dy = F.col("cx2") - F.col("cx"), F.col("cy2") - F.col("cy")
    near = both.withColumn("gap", gap).withColumn("dist", F.sqrt(dx * dx + dy * dy)).where((F.col("gap") > 0) & (F.col("gap") <= max_gap) & (F.col("dist") <= max_dist))
    return near.select("video_id", "track_id", "next_id", "gap", "dist")


def link_tracks(tracks: DataFrame, scored: DataFrame, limit: float, least_cost: bool = False) -> DataFrame:
    """``(video_id, track_id, root_id)``: tracks joined one to one, by ascending user-given ``scored.cost`` or, with
    ``least_cost``, so that the summed cost with ``limit`` for every track left open is least.

    ``scored(video_id, track_id, next_id, cost)``. Chains are followed by joins that double in reach each round.
    """
    from detframe.operators.assignment import least_cost_pairs
    from detframe.operators.greedy import match_by_value

    if least_cost:
        cost = scored.select("video_id", F.col("track_id").alias("a_id"), F.col("next_id").alias("b_id"), "cost")
        got = least_cost_pairs(cost, ["video_id"], limit).select("video_id", F.col("b_id").alias("track_id"), F.col("a_id").alias("prev"))
    else:
        pairs = scored.where(F.col("cost") <= limit).select("video_id", F.col("track_id").alias("det_id"), F.col("next_id").alias("ann_id"), (-F.col("cost")).alias("value"))
        got = match_by_value(pairs, ["video_id"]).select("video_id", F.col("ann_id").alias("track_id"), F.col("det_id").alias("prev"))
    jump = cut_lineage(got)
    while True:
        further = jump.alias("a").join(jump.alias("b"), (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.prev") == F.col("b.track_id")), "left").select(
            "a.video_id", "a.track_id", F.coalesce("b.prev", "a.prev").alias("prev"), F.col("b.prev").isNotNull().alias("_more"))
        further = cut_lineage(further)
        jump = further.drop("_more")
        if further.where("_more").limit(1).count() == 0:
            break
    ids = tracks.select(*TRACK).distinct()
    return ids.join(jump, TRACK, "left").select(*TRACK, F.coalesce("prev", "track_id").alias("root_id"))
