"""Anchored groups of a stream of frames: the open group of each video is the state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cuespark.operators.segment import THRESHOLD, mean_difference

_OUT = "video_id bigint, seq bigint, start_time double, end_time double, frame string, n_frames bigint"
_STATE = "seq bigint, start double, end double, frame string, n bigint, anchor array<double>, last bigint"


def stream_groups(frames: DataFrame, threshold: float = THRESHOLD, quiet: str = "5 minutes") -> DataFrame:
    """Groups of a streaming frames (video_id, seq, path, timestamp, signal), as each is closed by a frame that differs.

    signal is a number or a vector of numbers. Frames of a video come in order; one whose seq isn't over that of the video's last
    frame comes too late or again, and is left out, as are frames without video_id, seq or signal. A group also closes when its video
    has been quiet for the time given; the frames after that begin a new one.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def fold(key: tuple[int], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        done = []
        group = list(state.get) if state.exists else None
        if state.hasTimedOut:
            if group is not None:
                done.append((key[0], *group[:5]))
            state.remove()
            yield pd.DataFrame(done, columns=[x.split()[0] for x in _OUT.split(", ")])
            return
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            if group is not None and row.seq <= group[6]:
                continue
            signal = np.atleast_1d(np.asarray(row.signal, float))
            if group is not None and mean_difference(group[5], signal) <= threshold:
                group[2] = float(row.timestamp)
                group[4] += 1
                group[6] = int(row.seq)
                continue
            if group is not None:
                done.append((key[0], *group[:5]))
            group = [int(row.seq), float(row.timestamp), float(row.timestamp), row.path, 1, signal.tolist(), int(row.seq)]
        if group is not None:
            state.update(tuple(group))
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(done, columns=[x.split()[0] for x in _OUT.split(", ")])

    return frames.dropna(subset=["video_id", "seq", "signal"]).groupBy("video_id").applyInPandasWithState(fold, _OUT, _STATE, "append", "ProcessingTimeTimeout")
