"""Online tracking with Structured Streaming: one tracker per video as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from detframe.operators.trackers import Tracker, frame_input

OUTPUT = "video_id long, frame_id long, det_id long, track_id long"
COLUMNS = ["frame_id", "det_id", "x1", "y1", "x2", "y2", "score", "category_id", "ts"]


def track_stream(frames: DataFrame, make: Callable[[], Tracker], delay: str = "0 seconds") -> DataFrame:
    """``(video_id, frame_id, det_id, track_id)`` of a stream of detections with event time ``ts``.

    Frames may arrive out of order within ``delay``: they wait in the state until the watermark has passed
    them and are then tracked in frame order, so the result equals the batch one. State per video is its
    live tracks plus the frames still waiting.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, waiting = pickle.loads(state.get[0]) if state.exists else (make(), None)
        parts = [{c: b[c].to_numpy() for c in COLUMNS} for b in batches if len(b)]
        if parts:
            parts = parts if waiting is None else [waiting, *parts]
            waiting = {c: np.concatenate([p[c] for p in parts]) for c in COLUMNS}
        mark = max(state.getCurrentWatermarkMs(), 0)
        out = []
        if waiting is not None:
            due = waiting["ts"] <= np.datetime64(mark, "ms")
            if due.any():
                order = np.flatnonzero(due)[np.lexsort((waiting["det_id"][due], waiting["frame_id"][due]))]
                rows = {c: v[order] for c, v in waiting.items()}
                cuts = np.r_[0, np.flatnonzero(np.diff(rows["frame_id"])) + 1, len(order)]
                ids = np.concatenate([tracker.frame(int(rows["frame_id"][a]), frame_input({c: v[a:b] for c, v in rows.items()}))
                                      for a, b in zip(cuts[:-1], cuts[1:])])
                seen = ids >= 0
                out.append(pd.DataFrame({"video_id": key[0], "frame_id": rows["frame_id"][seen], "det_id": rows["det_id"][seen], "track_id": ids[seen]}))
                waiting = None if due.all() else {c: v[~due] for c, v in waiting.items()}
        state.update((pickle.dumps((tracker, waiting), pickle.HIGHEST_PROTOCOL),))
        if waiting is not None:
            state.setTimeoutTimestamp(max(int(waiting["ts"].min().astype("datetime64[ms]").astype(np.int64)), state.getCurrentWatermarkMs() + 1))
        yield from out

    return (frames.withWatermark("ts", delay).groupBy("video_id")
            .applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.EventTimeTimeout))
