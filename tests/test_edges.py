"""Nulls, empty tables, ties, repeated rows and clashing names in the caption operators."""

from pyspark.sql import functions as F

from cuespark.functions.ass import ass_documents, dialogue_lines
from cuespark.operators.cluster import similar_clusters
from cuespark.operators.ranges import merge_ranges
from cuespark.operators.reconcile import collapse, distinct_positions, first_majority, majority_text, readings
from cuespark.operators.runs import identical_runs
from cuespark.operators.segment import anchored_groups
from cuespark.plans import infer
from cuespark.config import RetryPolicy
from cuespark.schema import EVENT
from cuespark.sources.models import ScriptedClient
from cuespark.sources.video import frame_times
from cuespark.sources.workers import worker_limits

E = ("a", "regular", "#FFFFFF", "bottom")


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_empty_tables(spark):
    none = events(spark, [])
    assert identical_runs(none).count() == 0 == similar_clusters(none).count()
    clustered = none.withColumn("cluster_id", F.lit(1).cast("bigint"))
    assert collapse(clustered, majority_text).count() == 0 == readings(clustered).count()
    assert infer.reconcile(clustered, ScriptedClient(), 1, RetryPolicy(1, 0, 0)).count() == 0
    videos = spark.createDataFrame([(1, 10, 20)], "video_id bigint, width int, height int")
    assert dialogue_lines(none).count() == 0 and ass_documents(none, videos).count() == 1 and ass_documents(none, videos.limit(0)).count() == 0
    ranges = spark.createDataFrame([], "range_start double, range_end double")
    assert merge_ranges(ranges).count() == 0
    frames = spark.createDataFrame([], "video_id bigint, seq bigint, path string, timestamp double, signal double")
    assert anchored_groups(frames).count() == 0
    assert first_majority(frames, ["video_id"], "path", "seq").count() == 0
    assert distinct_positions(spark.createDataFrame([], "k int, position string"), ["k"]).count() == 0
    assert worker_limits(spark.createDataFrame([], "model_name string, max_parallel_requests bigint")).count() == 0


def test_nulls(spark):
    """Null elements end a run and are no event; null signals, ids and numbers take no part; rows without a video stay apart."""
    rows = [(1, 0, 0.0, 1.0, [E]), (1, 1, 1.0, 2.0, None), (1, 2, 2.0, 3.0, [E]), (1, 3, 3.0, 4.0, [E]), (None, 0, 0.0, 1.0, [E]), (1, 4, None, 5.0, [E])]
    got = sorted(((r.video_id or 0, r.seq, r.start_time, r.end_time) for r in identical_runs(events(spark, rows)).collect()))
    assert got == [(0, 0, 0.0, 1.0), (1, 0, 0.0, 1.0), (1, 2, 2.0, 5.0)]
    clusters = {(r.video_id or 0, r.seq): r.cluster_id for r in similar_clusters(events(spark, rows)).collect()}
    assert clusters[1, 0] == 1 and (1, 1) not in clusters and clusters[1, 2] == clusters[1, 3] == 2 and clusters[1, 4] == 3
    frames = spark.createDataFrame(
        [(1, 0, "a", 0.0, 1.0), (1, 1, "b", 0.5, None), (1, 2, "c", 1.0, 1.5), (None, 3, "d", 1.0, 1.0), (1, None, "e", 9.0, 99.0)],
        "video_id bigint, seq bigint, path string, timestamp double, signal double",
    )
    assert [(r.start_time, r.end_time, r.n_frames) for r in anchored_groups(frames, 1.0).collect()] == [(0.0, 1.0, 2)]
    ranges = spark.createDataFrame([(1.0, 2.0, 1), (1.5, None, 1), (None, 4.0, 1), (3.0, 5.0, None), (1.0, 2.0, 1)], "range_start double, range_end double, video_id int")
    assert (1.0, 2.0) in [(r.range_start, r.range_end) for r in merge_ranges(ranges.dropna(), ("video_id",)).collect()]
    votes = spark.createDataFrame([(1, None, 0), (1, None, 1), (1, "a", 2)], "k int, v string, o int")
    assert [(r.v, r.n) for r in first_majority(votes, ["k"], "v", "o").collect()] == [(None, 2)]


def test_names_that_clash(spark):
    """Columns named like those the operators make for themselves don't disturb them."""
    rows = events(spark, [(1, 0, 0.0, 1.0, [E]), (1, 1, 1.0, 2.0, [E]), (1, 2, 9.0, 9.5, [E, E])])
    odd = rows.withColumns({c: F.lit("x") for c in ("kind", "position", "value", "pos", "n", "x", "size", "first")})
    assert [(r.start_time, r.end_time) for r in identical_runs(odd).collect()] == [(0.0, 2.0), (9.0, 9.5)]
    clustered = similar_clusters(odd)
    assert sorted(r.cluster_id for r in clustered.collect()) == [1, 1, 2]
    got = sorted((r.seq, len(r.elements)) for r in collapse(clustered, majority_text).collect())
    assert got == [(0, 1), (2, 2)]


def test_repeated_rows(spark):
    rows = events(spark, [(1, 0, 0.0, 1.0, [E]), (1, 0, 0.0, 1.0, [E]), (1, 1, 1.0, 2.0, [E])])
    assert [(r.start_time, r.end_time) for r in identical_runs(rows).collect()] == [(0.0, 2.0)]
    clustered = rows.withColumn("cluster_id", F.lit(1).cast("bigint"))
    assert [r.texts for r in readings(clustered).collect()] == [["a", "a", "a"]]
    paths = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 1), (2, "c", None)], "video_id bigint, path string, number bigint")
    fps = spark.createDataFrame([(1, 2.0), (2, 1.0)], "video_id bigint, fps double")
    assert sorted((r.video_id, r.seq, r.timestamp) for r in frame_times(paths, fps).collect()) == [(1, 0, 0.0), (1, 1, 0.5), (1, 2, 1.0), (2, 0, 0.0)]
