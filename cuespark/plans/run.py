"""From video files to .ass files: probe, decode, time, group, read, write."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.config import EngineConfig
from cuespark.operators.lookup import required_lookup
from cuespark.operators.segment import edge_difference, unpack_edges
from cuespark.plans.captions import captions
from cuespark.plans.checkpoint import Store, callable_name, fingerprint
from cuespark.sources.files import file_identity, write_file, write_json_array
from cuespark.sources.models import HttpClient, TextClient, VisionClient
from cuespark.sources.video import edge_frames, extract_frames, ffmpeg, ffprobe, frame_times, probe_videos
from cuespark.sources.workers import read_worker_limit


def clients(config: EngineConfig) -> tuple[HttpClient, HttpClient, HttpClient]:
    """Of the settings' service: the clients that filter, analyze and reconcile."""
    return tuple(HttpClient(model, config.inference_url.rstrip("/")) for model in (config.filter_model, config.analyze_model, config.reconcile_model))


def file_limits(config: EngineConfig) -> dict[str, int]:
    """Parallel calls of each model by the worker file, if there is one; an option that is given goes before it."""
    if not config.worker_config:
        return {}
    asked = ((config.filter_model, config.filter_workers), (config.analyze_model, config.analyze_workers), (config.reconcile_model, config.reconcile_workers))
    return {model: read_worker_limit(config.worker_config, model) for model, own in asked if own is None}


def _or_fail(rows: DataFrame) -> DataFrame:
    """rows without error, which a row that has one makes the query fail with."""
    checked = F.when(F.col("error").isNull(), F.col("video_id")).otherwise(F.raise_error(F.col("error")))
    return rows.withColumn("video_id", checked.cast("bigint")).drop("error")


def _readable(pictures: DataFrame) -> DataFrame:
    made = F.when(F.col("edges").isNotNull(), F.col("edges")).otherwise(F.raise_error(F.concat(F.lit("unreadable picture: "), "path")))
    return pictures.withColumn("edges", made)


def run(
    videos: DataFrame,
    config: EngineConfig,
    work: str,
    probe: Callable[[str], str] = ffprobe,
    decode: Callable[[str, str], None] = ffmpeg,
    vision: VisionClient | None = None,
    reader: VisionClient | None = None,
    text: TextClient | None = None,
    **options: Any,
) -> DataFrame:
    """(video_id, content) of videos (video_id, path): the .ass document of each.

    work is a folder that all executors share: pictures go below it, and every stage is stored there, so a run that
    failed goes on where it was. Clients that aren't given are made from the settings. A video that can't be probed or decoded
    makes the run fail with its error. In debug mode the events are also written as a JSON manifest.
    """
    spark, work = videos.sparkSession, work.rstrip("/")
    store = Store(spark, f"{work}/stages")
    made = clients(config)
    asked = sorted(tuple(r) for r in videos.select("video_id", "path").collect())  # the arguments of a run
    named = {"videos": [(*x, *file_identity(spark, x[1])) for x in asked]}
    info = store.whole("videos", lambda: _or_fail(probe_videos(videos, probe)), probe=callable_name(probe), **named)
    folder = f"{work}/frames"
    done = store.whole("decoded", lambda: _or_fail(extract_frames(videos, folder.removeprefix("file://"), decode)), decode=callable_name(decode), **named)
    # the times of frames are known by their numbers alone; pictures meet them again by path
    pictures = store.whole("edges", lambda: _readable(edge_frames(spark, folder)), decode=callable_name(decode), **named)
    listed = required_lookup(pictures.select("video_id", "path", "number", "edges"), done.select("video_id", "folder"), ["video_id"]).drop("folder")
    frames = frame_times(listed, info)
    out = captions(
        frames,
        info,
        config,
        vision or made[0],
        text or made[2],
        store,
        signal="edges",
        load=unpack_edges,
        difference=edge_difference,
        limits=file_limits(config),
        reader=reader or vision or made[1],
        source=fingerprint(decode=callable_name(decode), **named),
        **options,
    )
    if config.debug:
        write_json_array(frames.select("video_id", "path", "timestamp"), f"{work}/manifest.json", ["video_id", "timestamp"])
    return out


def parse(arguments: Sequence[str]) -> EngineConfig:
    """Command-line options to settings; an unusable value is an error that names it."""
    p = argparse.ArgumentParser(prog="cuespark", description="Burned-in subtitles of a video to an .ass file.")
    p.add_argument("video")
    p.add_argument("-o", "--output")
    p.add_argument("--workdir")
    for stage in ("filter", "analyze", "reconcile"):
        p.add_argument(f"--{stage}-model", default=getattr(EngineConfig, f"{stage}_model"))
        p.add_argument(f"--{stage}-workers", type=int)
    p.add_argument("--edge-diff-threshold", type=float, default=EngineConfig.edge_diff_threshold)
    p.add_argument("--similarity-threshold", type=float, default=EngineConfig.similarity_threshold)
    p.add_argument("--gap-tolerance", type=float, default=EngineConfig.gap_tolerance)
    p.add_argument("--inference-url", default=EngineConfig.inference_url)
    p.add_argument("--worker-config")
    p.add_argument("--skip", action="append", default=[], metavar="START-END")
    p.add_argument("--debug", action="store_true")
    given = vars(p.parse_args(arguments))
    try:
        return EngineConfig(**given | {"skip": tuple(given["skip"])})
    except ValueError as error:
        p.error(str(error))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, **parts: Any) -> str:
    """Runs one video and writes its document; returns the document's path."""
    import sys

    config = parse(sys.argv[1:] if arguments is None else arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    videos = spark.createDataFrame([(0, config.video)], "video_id bigint, path string")
    write_file(spark, config.output_path, run(videos, config, config.work_path, **parts).first()["content"])
    return config.output_path


if __name__ == "__main__":
    main()
