"""Frames to groups that look alike: each frame is compared with the first one of its group.

The first frame of a group depends on all groups before, so this is a fold in frame order. It
streams: a partition holds whole videos, sorted, and only the open group's first frame is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

#: The share of an image's height in each of the two strips that are looked at; the largest difference inside a group.
STRIP = 0.20
THRESHOLD = 8.0
_OUT = "video_id bigint, seq bigint, start_time double, end_time double, frame string, n_frames bigint"


def edge_map(pixels: np.ndarray) -> np.ndarray:
    """Edges of the top and bottom strips of an RGB image, one above the other: 8-bit grey, 3x3 kernel of 8 and -1, border as it is.

    Of images of one size, stacked along the axes before the last three, the map of each.
    """
    height = pixels.shape[-3]
    strip = round(height * STRIP)
    if strip == 0:
        raise ValueError("the image is too low for strips")
    rgb = np.concatenate((pixels[..., :strip, :, :], pixels[..., height - strip :, :, :]), axis=-3).astype(np.int32)
    grey = (19595 * rgb[..., 0] + 38470 * rgb[..., 1] + 7471 * rgb[..., 2] + 32768) >> 16
    out = grey.copy()
    high, wide = grey.shape[-2:]
    if high > 2 and wide > 2:
        near = sum(grey[..., 1 + y : high - 1 + y, 1 + x : wide - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1))
        out[..., 1:-1, 1:-1] = np.clip(9 * grey[..., 1:-1, 1:-1] - near, 0, 255)
    return out.astype(np.uint8)


def edge_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference; maps of different shapes differ by all."""
    if a.shape != b.shape:
        return 255.0
    return float(np.abs(a.astype(np.int16) - b).mean())


def pack_edges(edges: np.ndarray) -> bytes:
    return np.array(edges.shape, "<u4").tobytes() + edges.tobytes()


def unpack_edges(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, offset=8).reshape(np.frombuffer(raw, "<u4", 2))


def mean_difference(a: Any, b: Any) -> float:
    """Of numbers or vectors."""
    return float(np.abs(np.asarray(a, float) - np.asarray(b, float)).mean())


def same(x: Any) -> Any:
    return x


def decode_image(row: dict[str, Any]) -> np.ndarray:
    """RGB of a row of Spark's image source: BGR or grey bytes."""
    data = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(data, 3, axis=2) if row["nChannels"] == 1 else data[..., 2::-1]


def anchored_groups(
    frames: DataFrame,
    threshold: float = THRESHOLD,
    signal: str = "signal",
    load: Callable[[Any], Any] = same,
    difference: Callable[[Any, Any], float] = mean_difference,
    at_once: int = 0,
) -> DataFrame:
    """(video_id, seq, start_time, end_time, frame, n_frames) of each group of frames (video_id, seq, path, timestamp, signal).

    load turns a frame's signal (a number, a vector, a path, image bytes) into what difference compares; it
    runs in the fold, so a path column moves paths, not pixels. With at_once it gets a list of up to that many signals and
    returns their values in order, which are held together. A group ends at its last frame's own time. Frames
    without video_id, seq or signal take no part; frames that repeat a seq are compared in any order.
    """
    names = ["video_id", "seq", "path", "timestamp", signal]
    # plain numbers are compared as such, without a call for each row
    numeric = load is same and difference is mean_difference and isinstance(frames.schema[signal].dataType, NumericType)

    def values(signals: list[Any]) -> Iterable[Any]:
        if numeric:
            return signals
        return chain.from_iterable(load(signals[i : i + at_once]) for i in range(0, len(signals), at_once)) if at_once else map(load, signals)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[Any] | None = None
        anchor: Any = None
        for batch in batches:
            done = []
            for video, seq, path, time, value in zip(*(batch[c].tolist() for c in names[:-1]), values(batch[signal].tolist()), strict=True):
                if group is not None and group[0] == video and (abs(anchor - value) if numeric else difference(anchor, value)) <= threshold:
                    group[3] = time
                    group[5] += 1
                    continue
                if group is not None:
                    done.append(group)
                group, anchor = [video, seq, time, time, path, 1], value
            yield pd.DataFrame(done, columns=[x.split()[0] for x in _OUT.split(", ")])
        if group is not None:
            yield pd.DataFrame([group], columns=[x.split()[0] for x in _OUT.split(", ")])

    return frames.select(*names).dropna(subset=["video_id", "seq", signal]).repartition("video_id").sortWithinPartitions("video_id", "seq").mapInPandas(fold, _OUT)
