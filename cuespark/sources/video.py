"""Videos to frames: probing, frame listings, timestamps, images."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.functions.times import fps


class VideoProbe(Protocol):
    def __call__(self, path: str) -> str:
        """The probe's JSON for a video; RuntimeError if it can't be read."""


class FrameDecoder(Protocol):
    def __call__(self, path: str, folder: str) -> None:
        """Write the frames of a video as numbered .jpg files to a folder."""


def ffprobe(path: str) -> str:
    command = ["ffprobe", "-v", "quiet", "-print_format", "json", "-show_streams", "-select_streams", "v:0", path]
    done = subprocess.run(command, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"ffprobe failed on {path}: {done.stderr[-500:]}")
    return done.stdout


def ffmpeg(path: str, folder: str) -> None:
    """folder is one that the executors share. Frames that an earlier run left there are deleted."""
    from pathlib import Path

    for old in Path(folder).glob("*.jpg"):
        old.unlink()
    done = subprocess.run(["ffmpeg", "-i", path, "-q:v", "3", f"{folder}/%06d.jpg"], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"ffmpeg failed on {path}: {done.stderr[-500:]}")
    if not any(Path(folder).glob("*.jpg")):
        raise RuntimeError(f"no frames in {path}")


def parse_probe(raw: str) -> tuple[int, int, float]:
    """(width, height, frames a second) of the first stream."""
    try:
        streams = json.loads(raw).get("streams") or []
        if not streams:
            raise ValueError("there is no video stream")
        first = streams[0]
        num, _, den = str(first["r_frame_rate"]).partition("/")
        rate = float(num) / float(den or 1)
        width, height = int(first["width"]), int(first["height"])
    except (KeyError, TypeError, AttributeError, ZeroDivisionError) as error:
        raise ValueError(f"unusable probe output: {error}") from error
    if rate <= 0:
        raise ValueError("the frame rate must be above 0")
    return width, height, rate


def probe_videos(videos: DataFrame, probe: Callable[[str], str] = ffprobe) -> DataFrame:
    """(video_id, width, height, fps, error) of (video_id, path): each video is probed on an executor."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                try:
                    rows.append((video, *parse_probe(probe(path)), None))
                except (ValueError, RuntimeError) as error:
                    rows.append((video, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["video_id", "width", "height", "fps", "error"]).astype({"width": "Int32", "height": "Int32"})

    return videos.select("video_id", "path").mapInPandas(work, "video_id bigint, width int, height int, fps double, error string")


def parse_probes(raw: DataFrame, column: str = "probe") -> DataFrame:
    """raw with width, height and fps of stored probe output, null where it is unusable."""
    kind = "struct<streams:array<struct<width:int,height:int,r_frame_rate:string>>>"
    first = F.try_element_at(F.from_json(column, kind)["streams"], F.lit(1))
    return raw.withColumn("_s", first).withColumns({"width": F.col("_s.width"), "height": F.col("_s.height"), "fps": fps(F.col("_s.r_frame_rate"))}).drop("_s")


def extract_frames(videos: DataFrame, folder: str, decode: Callable[[str, str], None] = ffmpeg) -> DataFrame:
    """(video_id, folder, error) of (video_id, path): each video's frames in a folder of its own below a shared one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        for batch in batches:
            rows = []
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                to = f"{folder}/{video}"
                try:
                    Path(to).mkdir(parents=True, exist_ok=True)
                    decode(path, to)
                    rows.append((video, to, None))
                except RuntimeError as error:
                    rows.append((video, to, str(error)))
            yield pd.DataFrame(rows, columns=["video_id", "folder", "error"])

    return videos.select("video_id", "path").mapInPandas(work, "video_id bigint, folder string, error string")


def list_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, path, number) of folder/<video_id>/<number>.jpg; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(folder)
    return numbered_paths(files.select("path")).select("video_id", "path", "number")


def frame_times(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """frames (video_id, path, number) with seq from 0 and timestamp = seq / fps, by frame number."""
    order = W.partitionBy("video_id").orderBy("number", "path")
    return (
        frames.withColumn("seq", F.row_number().over(order).cast("bigint") - 1)
        .join(videos.select("video_id", "fps"), "video_id")
        .withColumn("timestamp", F.col("seq") / F.col("fps"))
        .drop("fps")
    )


def edge_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, path, number, edges) of folder/<video_id>/<number>.jpg: the pictures decoded by Spark's image source, and their
    edge maps made beside it, so that the pixels stay in the task that read them. edges: height and width as 4 bytes each, then the map.

    Null where a picture can't be decoded or is too low.
    """
    from cuespark.operators.segment import decode_image, edge_map, pack_edges

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch[["height", "width", "nChannels", "data"]].to_dict("records"):
                try:
                    made.append(pack_edges(edge_map(decode_image(row))))
                except ValueError:
                    made.append(None)
            yield pd.DataFrame({"path": batch["path"], "edges": made})

    images = spark.read.format("image").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(folder)
    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    return numbered_paths(flat.mapInPandas(work, "path string, edges binary"))


def numbered_paths(files: DataFrame) -> DataFrame:
    """files (path, ...) with video_id and number of .../<video_id>/<number>.jpg."""
    return files.withColumns(
        {
            "video_id": F.regexp_extract("path", r"/(\d+)/\d+\.jpg$", 1).try_cast("bigint"),
            "number": F.regexp_extract("path", r"(\d+)\.jpg$", 1).try_cast("bigint"),
        }
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image struct) of Spark's image source."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image")
