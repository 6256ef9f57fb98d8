"""Online association of detections to tracks, one video at a time, frame by frame.

A tracker object is the state of one video: a few arrays over its live tracks. ``run_tracker`` feeds it the
frames of a sorted partition; ``streaming.tracking`` keeps the same object as streaming state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.functions.arrays import assign_limited, assign_min_cost, pairwise_iou
from detframe.plans.grouped import scan_states

# fixed values of the motion model: noise in units of box height, 95 % point of chi-square with 4 degrees
POSITION_NOISE, VELOCITY_NOISE, GATE = 1 / 20, 1 / 160, 9.4877
LABEL_COST = 1e6


def to_state(box: np.ndarray) -> np.ndarray:
    w, h = box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]
    return np.stack([box[:, 0] + w / 2, box[:, 1] + h / 2, w / h, h], axis=1)


def to_box(state: np.ndarray) -> np.ndarray:
    w, h = state[:, 2] * state[:, 3], state[:, 3]
    return np.stack([state[:, 0] - w / 2, state[:, 1] - h / 2, state[:, 0] + w / 2, state[:, 1] + h / 2], axis=1)


class Motion:
    """Constant-velocity filter over (cx, cy, aspect, height), all tracks at once.

    Noise is independent per value, so each value meets its own velocity only: a covariance is ``(n, 3, 4)``, the variance of
    the four values, their covariance with the velocities, and the variance of these.
    """

    @staticmethod
    def _noise(h: np.ndarray, weight: float, aspect: float) -> np.ndarray:
        out = np.repeat((weight * h)[:, None], 4, axis=1)
        out[:, 2] = aspect
        return out

    @classmethod
    def start(cls, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, speed = cls._noise(z[:, 3], 2 * POSITION_NOISE, 1e-2), cls._noise(z[:, 3], 10 * VELOCITY_NOISE, 1e-5)
        return np.concatenate([z, np.zeros_like(z)], axis=1), np.stack([place ** 2, np.zeros_like(z), speed ** 2], axis=1)

    @classmethod
    def predict(cls, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, speed = cls._noise(mean[:, 3], POSITION_NOISE, 1e-2), cls._noise(mean[:, 3], VELOCITY_NOISE, 1e-5)
        moved, out = mean.copy(), np.empty_like(cov)
        moved[:, :4] += mean[:, 4:]
        out[:, 1] = cov[:, 1] + cov[:, 2]
        out[:, 0] = cov[:, 0] + cov[:, 1] + out[:, 1] + place ** 2
        out[:, 2] = cov[:, 2] + speed ** 2
        return moved, out

    @classmethod
    def project(cls, mean: np.ndarray, cov: np.ndarray, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected values and their variances, noise of the measurement included."""
        std = cls._noise(mean[:, 3], POSITION_NOISE, 1e-1)
        if score is not None:  # sure detections are trusted more
            std = std * (1 - score)[:, None]
        return mean[:, :4], cov[:, 0] + std ** 2

    @classmethod
    def update(cls, mean: np.ndarray, cov: np.ndarray, z: np.ndarray, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        pm, pv = cls.project(mean, cov, score)
        place, speed, off = cov[:, 0] / pv, cov[:, 1] / pv, z - pm
        moved = mean + np.concatenate([place * off, speed * off], axis=1)
        return moved, cov - np.stack([place * pv * place, place * pv * speed, speed * pv * speed], axis=1)

    @classmethod
    def gate(cls, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distance of every track to every measurement."""
        pm, pv = cls.project(mean, cov)
        out = np.zeros((len(pm), len(z)))
        for i in range(4):
            d = z[None, :, i] - pm[:, None, i]
            out += d * (d / pv[:, None, i])
        return out


class Tracker:
    """Live tracks as parallel arrays; subclasses say how a frame's detections get their ids."""

    def __init__(self, retain: int = 30, tentative_hits: int = 3):
        self.retain, self.tentative_hits, self.next_id = retain, tentative_hits, 0
        self.t = {"id": np.empty(0, int), "mean": np.empty((0, 8)), "cov": np.empty((0, 3, 4)), "box": np.empty((0, 4)),
                  "last": np.empty(0, int), "hits": np.empty(0, int), "tentative": np.empty(0, bool), "label": np.empty(0, int)}

    def fresh(self, n: int) -> np.ndarray:
        ids = np.arange(self.next_id, self.next_id + n)
        self.next_id += n
        return ids

    def cost(self, rows: np.ndarray, det: dict, cols: np.ndarray, boxes: np.ndarray, weigh: bool = False) -> np.ndarray:
        """1 - IoU of tracks and detections, with a prohibitive cost across classes."""
        iou = pairwise_iou(boxes, det["box"][cols])
        if weigh:
            iou = iou * det["score"][cols][None]
        return 1 - iou + LABEL_COST * (self.t["label"][rows][:, None] != det["label"][cols][None])

    def store(self, frame: int, ids: np.ndarray, det: dict, extra: dict | None = None, new_is_firm: bool = False) -> None:
        """Update matched tracks, start new ones, drop old and unconfirmed ones."""
        rows = np.searchsorted(self.t["id"], ids)  # tracks stand by id: new ones come last
        known = np.append(self.t["id"], -1)[rows] == ids
        rows = rows[known]
        z = to_state(det["box"])
        if len(rows):
            score = det["score"][known] if extra and extra.get("trust") else None
            self.t["mean"][rows], self.t["cov"][rows] = Motion.update(self.t["mean"][rows], self.t["cov"][rows], z[known], score)
            self.t["box"][rows], self.t["last"][rows], self.t["label"][rows] = det["box"][known], frame, det["label"][known]
            self.t["hits"][rows] += 1
            self.t["tentative"][rows] &= self.t["hits"][rows] < self.tentative_hits
            for name, values in (extra or {}).get("merge", {}).items():
                self.t[name][rows] = values(self.t[name][rows], known)
        if (~known).any():
            mean, cov = Motion.start(z[~known])
            n = len(mean)
            new = {"id": ids[~known], "mean": mean, "cov": cov, "box": det["box"][~known], "last": np.full(n, frame), "hits": np.ones(n, int),
                   "tentative": np.full(n, frame != 0 and not new_is_firm), "label": det["label"][~known]}
            for name, values in (extra or {}).get("start", {}).items():
                new[name] = values(~known)
            self.t = {k: np.concatenate([v, new[k]]) if len(v) else new[k] for k, v in self.t.items()}
        alive = (frame - self.t["last"] < self.retain) & ~(self.t["tentative"] & (self.t["last"] != frame))
        self.t = {k: v[alive] for k, v in self.t.items()}

    def assign(self, frame: int, det: dict) -> np.ndarray:
        raise NotImplementedError

    def frame(self, frame: int, det: dict) -> np.ndarray:
        """Track id per detection of this frame; -1 for detections that are not tracked."""
        if frame == 0:
            self.__init__(**self.options)
        return self.assign(frame, det)


class ByteTracker(Tracker):
    """High scores first, then young tracks, then low scores for tracks seen in the last frame."""

    def __init__(self, high: float = 0.6, low: float = 0.1, init: float = 0.7, iou_high: float = 0.1, iou_low: float = 0.5, iou_tentative: float = 0.3,
                 weigh: bool = True, retain: int = 30, tentative_hits: int = 3):
        self.options = dict(high=high, low=low, init=init, iou_high=iou_high, iou_low=iou_low, iou_tentative=iou_tentative, weigh=weigh,
                            retain=retain, tentative_hits=tentative_hits)
        super().__init__(retain, tentative_hits)
        self.o = self.options

    def assign(self, frame: int, det: dict) -> np.ndarray:
        o, n = self.o, len(det["score"])
        ids = np.full(n, -1)
        if not len(self.t["id"]) or n == 0:
            used = np.flatnonzero(det["score"] > o["init"])
            ids[used] = self.fresh(len(used))
        else:
            first = np.flatnonzero(det["score"] > o["high"])
            second = np.flatnonzero((det["score"] <= o["high"]) & (det["score"] > o["low"]))
            firm = np.flatnonzero(~self.t["tentative"])
            gap = firm[self.t["last"][firm] != frame - 1]
            self.t["mean"][gap, 7] = 0
            if len(firm):
                self.t["mean"][firm], self.t["cov"][firm] = Motion.predict(self.t["mean"][firm], self.t["cov"][firm])

            def match(rows, cols, weigh, thr):
                if not len(rows) or not len(cols):
                    return np.empty(0, int), np.empty(0, int)
                i, j = assign_limited(self.cost(rows, det, cols, to_box(self.t["mean"][rows, :4]), weigh), 1 - thr)
                return rows[i], cols[j]

            r, c = match(firm, first, o["weigh"], o["iou_high"])
            ids[c] = self.t["id"][r]
            young = np.flatnonzero(self.t["tentative"])
            r2, c2 = match(young, first[ids[first] < 0], o["weigh"], o["iou_tentative"])
            ids[c2] = self.t["id"][r2]
            open_rows = ~self.t["tentative"]
            open_rows[r] = False
            lost = np.flatnonzero(open_rows)
            r3, c3 = match(lost[self.t["last"][lost] == frame - 1], second, False, o["iou_low"])
            ids[c3] = self.t["id"][r3]
            new = first[ids[first] < 0]
            ids[new] = self.fresh(len(new))
        seen = ids >= 0
        self.store(frame, ids[seen], {k: v[seen] for k, v in det.items()})
        return ids


class SortTracker(Tracker):
    """Appearance first (when given), gated by the motion model; then overlap with last frame's boxes.

    ``motion_weight`` > 0 mixes the gated distance into a cosine appearance cost.
    """

    def __init__(self, score_thr: float = 0.3, iou_thr: float = 0.7, reid_thr: float = 2.0, momentum: float | None = None,
                 motion_weight: float = 0.0, retain: int = 100, tentative_hits: int = 2):
        self.options = dict(score_thr=score_thr, iou_thr=iou_thr, reid_thr=reid_thr, momentum=momentum, motion_weight=motion_weight,
                            retain=retain, tentative_hits=tentative_hits)
        super().__init__(retain, tentative_hits)
        self.o = self.options

    def assign(self, frame: int, det: dict) -> np.ndarray:
        o = self.o
        out = np.full(len(det["score"]), -1)
        used = np.flatnonzero(det["score"] > o["score_thr"])
        d = {k: v[used] for k, v in det.items()}
        ids = np.full(len(used), -1)
        if len(self.t["id"]) and len(used):
            self.t["mean"], self.t["cov"] = Motion.predict(self.t["mean"], self.t["cov"])
            open_rows = self.t["last"] == frame - 1
            if "embedding" in d and "embedding" in self.t:
                firm = np.flatnonzero(~self.t["tentative"])
                if len(firm):
                    gate = Motion.gate(self.t["mean"][firm], self.t["cov"][firm], to_state(d["box"]))
                    mine, theirs = self.t["embedding"][firm], d["embedding"]
                    if o["motion_weight"] > 0:
                        unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (mine, theirs)]
                        dist = (1 - o["motion_weight"]) * (1 - unit[0] @ unit[1].T) + o["motion_weight"] * gate
                    else:
                        dist = np.sqrt(np.maximum(((mine[:, None] - theirs[None]) ** 2).sum(axis=2), 0))
                    dist = dist + LABEL_COST * (self.t["label"][firm][:, None] != d["label"][None])
                    dist[gate > GATE] = LABEL_COST
                    i, j = assign_min_cost(dist)
                    ok = dist[i, j] <= o["reid_thr"]
                    ids[j[ok]] = self.t["id"][firm[i[ok]]]
                    open_rows[firm[i[ok]]] = False
            rows = np.flatnonzero(open_rows)
            cols = np.flatnonzero(ids < 0)
            if len(rows) and len(cols):
                cost = self.cost(rows, d, cols, self.t["box"][rows])
                i, j = assign_min_cost(cost)
                ok = cost[i, j] < 1 - o["iou_thr"]
                ids[cols[j[ok]]] = self.t["id"][rows[i[ok]]]
        new = np.flatnonzero(ids < 0)
        ids[new] = self.fresh(len(new))
        extra = {}
        if "embedding" in d:
            if "embedding" not in self.t:
                self.t["embedding"] = np.empty((0, d["embedding"].shape[1]))
            m = o["momentum"]
            extra = {"merge": {"embedding": lambda old, at: d["embedding"][at] if m is None else (1 - m) * old + m * d["embedding"][at]},
                     "start": {"embedding": lambda at: d["embedding"][at]}}
        self.store(frame, ids, d, extra)
        out[used] = ids
        return out


class ObservationTracker(Tracker):
    """Overlap plus consistency of direction; lost tracks are recovered by their last observation.

    When a track returns after a gap its filter is replayed along the straight line between the two
    observations.
    """

    def __init__(self, score_thr: float = 0.3, init: float = 0.7, iou_thr: float = 0.3, iou_last: float = 0.3, direction: float = 0.2, back: int = 3,
                 retain: int = 30, tentative_hits: int = 3):
        self.options = dict(score_thr=score_thr, init=init, iou_thr=iou_thr, iou_last=iou_last, direction=direction, back=back,
                            retain=retain, tentative_hits=tentative_hits)
        super().__init__(retain, tentative_hits)
        self.o = self.options
        self.t["saved_mean"], self.t["saved_cov"] = np.empty((0, 8)), np.empty((0, 3, 4))
        self.past: dict[int, list] = {}

    def _directions(self, frame: int) -> np.ndarray:
        out = np.zeros((len(self.t["id"]), 2))
        for i, k in enumerate(self.t["id"]):
            seen = self.past.get(k, [])
            if len(seen) < 2:
                continue
            earlier = [b for f, b in seen if f <= frame - self.o["back"]]
            a, b = (earlier[-1] if earlier else seen[0][1]), seen[-1][1]
            v = (b[:2] + b[2:]) / 2 - (a[:2] + a[2:]) / 2
            out[i] = v / (np.linalg.norm(v) + 1e-6)
        return out

    def assign(self, frame: int, det: dict) -> np.ndarray:
        o, n = self.o, len(det["score"])
        ids = np.full(n, -1)
        if not len(self.t["id"]) or n == 0:
            used = np.flatnonzero(det["score"] > o["init"])
            ids[used] = self.fresh(len(used))
        else:
            used = np.flatnonzero(det["score"] > o["score_thr"])
            gap = self.t["last"] != frame - 1
            self.t["mean"][gap, 7] = 0
            self.t["mean"], self.t["cov"] = Motion.predict(self.t["mean"], self.t["cov"])
            way = self._directions(frame)
            centers = (det["box"][:, :2] + det["box"][:, 2:]) / 2
            mine = (self.t["box"][:, :2] + self.t["box"][:, 2:]) / 2

            def match(rows, cols, last_box):
                if not len(rows) or not len(cols):
                    return np.empty(0, int), np.empty(0, int)
                if last_box:
                    i, j = assign_limited(self.cost(rows, det, cols, self.t["box"][rows]), 1 - o["iou_last"])
                    return rows[i], cols[j]
                cost = self.cost(rows, det, cols, to_box(self.t["mean"][rows, :4]))
                to = centers[cols][None] - mine[rows][:, None]
                to = to / (np.linalg.norm(to, axis=2, keepdims=True) + 1e-6)
                turn = np.arccos(np.clip((to * way[rows][:, None]).sum(axis=2), -1, 1))
                known = (np.abs(way[rows]).sum(axis=1) > 0)[:, None]
                agree = np.where(known, (np.pi / 2 - turn) / np.pi, 0) * det["score"][cols][None]
                i, j = assign_limited(cost - o["direction"] * agree, 1 - o["iou_thr"])
                return rows[i], cols[j]

            firm, young = np.flatnonzero(~self.t["tentative"]), np.flatnonzero(self.t["tentative"])
            r, c = match(firm, used, False)
            ids[c] = self.t["id"][r]
            r2, c2 = match(young, np.setdiff1d(used, c), False)
            ids[c2] = self.t["id"][r2]
            left = np.setdiff1d(used, np.concatenate([c, c2]))
            r3, c3 = match(np.setdiff1d(firm, r), left, True)
            ids[c3] = self.t["id"][r3]
            self._replay(frame, np.concatenate([r, r3]), np.concatenate([c, c3]), det)
            new = used[ids[used] < 0]
            ids[new] = self.fresh(len(new))
        seen = ids >= 0
        d = {k: v[seen] for k, v in det.items()}
        start = {"saved_mean": lambda at: np.zeros((at.sum(), 8)), "saved_cov": lambda at: np.zeros((at.sum(), 3, 4))}
        self.store(frame, ids[seen], d, {"start": start})
        now = self.t["last"] == frame
        self.t["saved_mean"][now], self.t["saved_cov"][now] = self.t["mean"][now], self.t["cov"][now]
        for k, b in zip(ids[seen], d["box"]):
            self.past.setdefault(k, []).append((frame, b))
            self.past[k] = self.past[k][-(o["back"] + 2):]
        self.past = {k: v for k, v in self.past.items() if k in set(self.t["id"])}
        return ids

    def _replay(self, frame: int, rows: np.ndarray, cols: np.ndarray, det: dict) -> None:
        for r, c in zip(rows, cols):
            gap = frame - self.t["last"][r]
            if gap <= 1:
                continue
            mean, cov = self.t["saved_mean"][r:r + 1], self.t["saved_cov"][r:r + 1]
            for s in range(1, gap):
                mean, cov = Motion.predict(mean, cov)
                virtual = self.t["box"][r] + (det["box"][c] - self.t["box"][r]) * s / gap
                mean, cov = Motion.update(mean, cov, to_state(virtual[None]))
            self.t["mean"][r:r + 1], self.t["cov"][r:r + 1] = Motion.predict(mean, cov)


class SimilarityTracker(Tracker):
    """Quasi-dense association: two-way softmax of embedding products between detections and remembered tracks."""

    def __init__(self, init: float = 0.8, obj: float = 0.5, match: float = 0.5, momentum: float = 0.8, retain: int = 10):
        self.options = dict(init=init, obj=obj, match=match, momentum=momentum, retain=retain)
        super().__init__(retain, 1)
        self.o = self.options

    def assign(self, frame: int, det: dict) -> np.ndarray:
        o, n = self.o, len(det["score"])
        ids = np.full(n, -1)
        if "embedding" not in self.t:
            self.t["embedding"] = np.empty((0, det["embedding"].shape[1]))
        if len(self.t["id"]) and n:
            product = det["embedding"] @ self.t["embedding"].T
            rows = np.exp(product - product.max(axis=1, keepdims=True))
            cols = np.exp(product - product.max(axis=0, keepdims=True))
            sim = (rows / rows.sum(axis=1, keepdims=True) + cols / cols.sum(axis=0, keepdims=True)) / 2
            sim[det["label"][:, None] != self.t["label"][None]] = 0
            for i in np.argsort(-det["score"], kind="stable"):
                j = int(np.argmax(sim[i]))
                if sim[i, j] > o["match"] and det["score"][i] > o["obj"]:
                    ids[i] = self.t["id"][j]
                    sim[:, j] = 0
        new = np.flatnonzero((ids < 0) & (det["score"] > o["init"]))
        ids[new] = self.fresh(len(new))
        seen = ids >= 0
        e, m = det["embedding"][seen], o["momentum"]
        self.store(frame, ids[seen], {k: v[seen] for k, v in det.items()},
                   {"merge": {"embedding": lambda old, at: (1 - m) * old + m * e[at]}, "start": {"embedding": lambda at: e[at]}}, new_is_firm=True)
        return ids


def frame_input(rows: dict) -> dict:
    det = {"box": np.stack([rows[c] for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float), "score": rows["score"].astype(float),
           "label": rows["category_id"].astype(int)}
    if "embedding" in rows:
        det["embedding"] = np.stack([np.asarray(v, dtype=float) for v in rows["embedding"]]) if len(rows["embedding"]) else np.empty((0, 1))
    return det


def run_tracker(det: DataFrame, make: Callable[[], Tracker], keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``(keys.., frame_id, det_id, track_id)`` for detections that belong to a track.

    ``det(keys.., frame_id, det_id, x1..y2, score, category_id[, embedding])``. Frames are numbered from 0.
    """
    kinds = dict(det.dtypes)

    def step(tracker, rows):
        ids = tracker.frame(int(rows["frame_id"][0]), frame_input(rows))
        kept = ids >= 0
        return {"frame_id": rows["frame_id"][kept], "det_id": rows["det_id"][kept], "track_id": ids[kept].astype(np.int64)}

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", frame_id long, det_id long, track_id long"
    return scan_states(det, list(keys), ["frame_id"], ["det_id"], make, step, schema)


def sweep(det: DataFrame, settings: DataFrame, make: Callable[[dict], Tracker]) -> DataFrame:
    """Run a tracker for every row of ``settings(setting_id, ..)``: key = (setting, video).

    The settings table is a handful of rows, all of them used; each run sees its own copy of the detections.
    """
    options = {r["setting_id"]: {k: v for k, v in r.asDict().items() if k != "setting_id"} for r in settings.collect()}
    each = det.withColumn("setting_id", F.explode(F.array(*[F.lit(s) for s in options])))

    def start():
        return {}

    def step(state, rows):
        setting = rows["setting_id"][0]
        if "t" not in state:
            state["t"] = make(options[setting])
        ids = state["t"].frame(int(rows["frame_id"][0]), frame_input(rows))
        kept = ids >= 0
        return {"frame_id": rows["frame_id"][kept], "det_id": rows["det_id"][kept], "track_id": ids[kept].astype(np.int64)}

    kinds = dict(each.dtypes)
    return scan_states(each, ["setting_id", "video_id"], ["frame_id"], ["det_id"], start, step,
                       f"setting_id {kinds['setting_id']}, video_id long, frame_id long, det_id long, track_id long")
