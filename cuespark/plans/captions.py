"""The nine steps from frames to subtitle documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.config import EngineConfig, resolve_workers
from cuespark.functions.ass import ass_documents
from cuespark.functions.times import parse_skip_range
from cuespark.operators.cluster import similar_clusters
from cuespark.operators.ranges import drop_in_ranges, merged
from cuespark.operators.runs import identical_runs
from cuespark.operators.segment import anchored_groups, mean_difference, same
from cuespark.plans.checkpoint import Store, callable_name, content
from cuespark.plans.infer import analyze, prefilter, reconcile
from cuespark.sources.models import ANALYZE_PROMPT, FILTER_PROMPT, RECONCILE_PROMPT, TextClient, VisionClient


def captions(
    frames: DataFrame,
    videos: DataFrame,
    config: EngineConfig,
    vision: VisionClient,
    text: TextClient,
    store: Store,
    signal: str = "signal",
    load: Callable[[Any], Any] = same,
    difference: Callable[[Any, Any], float] = mean_difference,
    limits: dict[str, int] | None = None,
    source: str | None = None,
    reader: VisionClient | None = None,
    **options: Any,
) -> DataFrame:
    """(video_id, content) of frames (video_id, seq, path, timestamp, signal) and videos (video_id, width, height, fps).

    Every stage is stored under what it and those before it ran with: the frames, the settings, the prompts, and the names of
    signal, load and difference; model stages row by row. source names the frames; without it their content does,
    which takes a pass over them. reader: the client that analyzes, vision by default. Frames without video_id, seq or signal take no part.
    """
    limits = limits or {}
    skip = merged(parse_skip_range(x) for x in config.skip)
    own = frames.select("video_id", "seq", "path", "timestamp", signal).dropna(subset=["video_id", "seq", signal])
    so_far: dict[str, object] = {"frames": source if source is not None else content(own), "skip": skip}
    kept = store.whole("frames", lambda: drop_in_ranges(own, skip), **so_far)
    so_far |= {"edge": config.edge_diff_threshold, "signal": signal, "load": callable_name(load), "difference": callable_name(difference)}
    groups = store.whole("groups", lambda: anchored_groups(kept, config.edge_diff_threshold, signal, load, difference), **so_far)
    named = groups.withColumn("id", F.concat_ws(":", "video_id", "seq"))
    so_far["filter"] = (config.filter_model, FILTER_PROMPT)
    n = resolve_workers(config.filter_workers, limits.get(config.filter_model), "filter")
    filtered = store.rows("filter", named, lambda df: prefilter(df, vision, n, config.retry, **options), **so_far)
    so_far["analyze"] = (config.analyze_model, ANALYZE_PROMPT)
    m = resolve_workers(config.analyze_workers, limits.get(config.analyze_model), "analyze")
    analyses = store.rows("analysis", filtered, lambda df: analyze(df, reader or vision, m, config.retry, **options), **so_far)
    events = store.whole("events", lambda: identical_runs(analyses.select("video_id", "seq", "start_time", "end_time", "elements")), **so_far)
    so_far |= {"similar": config.similarity_threshold, "gap": config.gap_tolerance}
    clusters = store.whole("clusters", lambda: similar_clusters(events, config.similarity_threshold, config.gap_tolerance), **so_far)
    so_far["reconcile"] = (config.reconcile_model, RECONCILE_PROMPT)
    k = resolve_workers(config.reconcile_workers, limits.get(config.reconcile_model), "reconcile")
    ids = clusters.groupBy("video_id", "cluster_id").agg(F.min("seq").alias("seq")).withColumn("id", F.concat_ws(":", "video_id", "cluster_id"))

    def settle(some: DataFrame) -> DataFrame:
        keys = some.select("video_id", "cluster_id", "id")
        members = clusters.join(keys.drop("id"), ["video_id", "cluster_id"], "left_semi")
        return reconcile(members, text, k, config.retry, **options).join(keys, ["video_id", "cluster_id"])

    settled = store.rows("reconciled", ids, settle, **so_far)
    return ass_documents(settled.select("video_id", "seq", "start_time", "end_time", "elements"), videos)
