"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.config import EngineConfig, RetryPolicy
from cuespark.functions import ass, text, times
from cuespark.operators import cluster, lookup, ranges, reconcile, runs, segment
from cuespark.plans import captions, checkpoint, infer
from cuespark.schema import ELEMENTS, color
from cuespark.sources import files
from cuespark.sources.files import shared_folder
from cuespark.sources.models import ScriptedClient
from cuespark.sources.video import parse_probes
from cuespark.sources.workers import worker_limits

SKIP = [(86400.0, 172800.0), (150000.0, 200000.0), (200000.0, 260000.0), (1000000.0, 1100000.5)]
GAP = 14400.0
RATE = 24000 / 1001
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the frames of a video; seconds since 2024-01-01."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order).cast("bigint") - 1).alias("seq"),
        "event_id",
        "event_type",
        F.col("value").alias("signal"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D").alias("timestamp"),
        F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string")).alias("path"),
    )


def element(t: Column, style: Column, hue: Column, position: Column) -> Column:
    return F.struct(t.alias("text"), style.alias("style"), hue.alias("color"), position.alias("position"))


def analyses(spark: SparkSession, sf_dir: str, varied: bool = False) -> DataFrame:
    """A frame's event type as its one element; `error` has none. varied: style, colour and position follow the id."""
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    lasts = F.coalesce(F.lead("timestamp").over(W.partitionBy("video_id").orderBy("seq")), F.col("timestamp"))
    style = F.when(i % 3 == 0, "italic").otherwise("regular") if varied else F.lit("regular")
    names = F.array(*(F.lit(x) for x in ("white", "yellow", "cyan", "other")))
    hue = color(F.element_at(names, (i % 4 + 1).cast("int"))) if varied else F.lit("#FFFFFF")
    position = F.when(i % 5 == 0, "top").otherwise("bottom") if varied else F.lit("bottom")
    one = F.array(element(F.col("event_type"), style, hue, position))
    elements = F.when(F.col("event_type") == "error", F.from_json(F.lit("[]"), ELEMENTS)).otherwise(one)
    return f.select("video_id", "seq", "event_id", F.col("timestamp").alias("start_time"), lasts.alias("end_time"), elements.alias("elements"))


def ranges_table(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("range_start"), F.lit(b).alias("range_end")) for a, b in SKIP))))


def skip_anti_join(spark, sf_dir):
    return ranges.drop_in_ranges(frames(spark, sf_dir), ranges.merged(SKIP)).select("video_id", "seq", "event_id")


def skip_merge_ranges(spark, sf_dir):
    own = frames(spark, sf_dir).select("video_id", F.col("timestamp").alias("range_start"), (F.col("timestamp") + F.col("signal") * 100).alias("range_end"))
    return ranges.merge_ranges(own, ("video_id",))


def skip_range_counts(spark, sf_dir):
    return ranges.range_counts(frames(spark, sf_dir), ranges_table(spark))


def time_format(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", times.time_text(F.col("timestamp") / 500).alias("shown"), times.ass_time(F.col("timestamp") / 500).alias("ass"))


_TIME_TEXT = (
    "CASE event_id % 5 WHEN 0 THEN concat(' ', cast(event_id % 90 as string), '.5 ') WHEN 1 THEN concat(cast(event_id % 70 as string), ':', cast(event_id % 60 as string)) "
    "WHEN 2 THEN concat(cast(event_id % 9 as string), ':', cast(event_id % 75 as string), ':07.25') WHEN 3 THEN '1:2:3:4' ELSE 'abc' END"
)


def time_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.time_seconds(F.expr(_TIME_TEXT)).alias("seconds"))


def frame_timestamps(spark, sf_dir):
    from cuespark.sources.video import frame_times

    f = frames(spark, sf_dir).select("video_id", "path", F.col("event_id").alias("number"))
    videos = f.select("video_id").distinct().withColumn("fps", F.lit(RATE))
    return frame_times(f, videos).select("video_id", "number", "seq", "timestamp")


_RATES = "CASE event_id % 5 WHEN 0 THEN '24000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '0/0' WHEN 3 THEN '30' ELSE 'x/1' END"


def fps_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.fps(F.expr(_RATES)).alias("fps"))


def anchored_groups(spark, sf_dir):
    return segment.anchored_groups(frames(spark, sf_dir), 100.0).drop("frame")


def anchored_groups_l1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    order = W.partitionBy("label").orderBy("vec_id")
    rows = e.select(
        F.col("label").cast("bigint").alias("video_id"),
        (F.row_number().over(order).cast("bigint") - 1).alias("seq"),
        F.col("vec_id").cast("string").alias("path"),
        F.col("vec_id").cast("double").alias("timestamp"),
        "embedding",
    )
    return segment.anchored_groups(rows, 0.12, "embedding").select("video_id", "seq", "n_frames")


_HAS_TEXT = (
    """CASE event_id % 8 WHEN 0 THEN '{"has_text": true}' WHEN 1 THEN '{"has_text": false}' WHEN 2 THEN '{"has_text": "True"}' WHEN 3 THEN '{"has_text": "FALSE"}' """
    """WHEN 4 THEN '{"has_text": 1}' WHEN 5 THEN '{"other": true}' WHEN 6 THEN 'not json' ELSE '{"has_text": "yes"}' END"""
)


def _tried(call: Callable, kind: str):
    def one(raw):
        try:
            return json.dumps(call(raw))
        except ValueError:
            return None

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=object), T.StringType())


def prefilter_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_HAS_TEXT).alias("raw"))
    return raw.select("event_id", _tried(text.parse_has_text, "boolean")("raw").cast("boolean").alias("has_text"))


_ELEMENTS = (
    """CASE event_id % 9 WHEN 0 THEN concat('{"subtitles": [{"text": "', event_type, '"}]}') WHEN 1 THEN '{"subtitles": []}' WHEN 2 THEN '{}' """
    """WHEN 3 THEN concat('```json\n{"subtitles": [{"text": "', event_type, '", "style": "italic", "color": "yellow", "position": "top"}, {"text": "b"}]}\n```') """
    """WHEN 4 THEN '[]' WHEN 5 THEN '{"subtitles": null}' WHEN 6 THEN '{"subtitles": [{"text": "a", "style": "bold"}]}' """
    """WHEN 7 THEN '{"subtitles": [{"text": "a", "color": null}]}' ELSE '{"subtitles": "x"}' END"""
)


def elements_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_ELEMENTS).alias("raw"))
    found = raw.select("event_id", F.from_json(_tried(text.parse_elements, ELEMENTS)("raw"), ELEMENTS).alias("e"))
    flat = F.array_join(F.transform("e", lambda x: F.concat_ws("|", x["text"], x["style"], x["color"], x["position"])), ";")
    return found.select("event_id", F.col("e").isNotNull().alias("ok"), F.when(F.col("e").isNotNull(), flat).alias("elements"))


_COLORS = "CASE event_id % 7 WHEN 0 THEN 'white' WHEN 1 THEN 'yellow' WHEN 2 THEN 'cyan' WHEN 3 THEN 'other' WHEN 4 THEN 'Yellow' WHEN 5 THEN '#a1b2c3' ELSE '#ABC' END"


def color_resolve(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", color(F.expr(_COLORS)).alias("color"))


def ass_color(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ass.ass_color(color(F.expr(_COLORS))).alias("code"))


def identical_runs(spark, sf_dir):
    return runs.identical_runs(analyses(spark, sf_dir)).select("video_id", "seq", "start_time", "end_time", F.col("elements")[0]["text"].alias("text"))


def ratio_pairs(spark, sf_dir):
    """The ratio of each event's type against the one before, once for each pair that occurs."""
    before = F.lag("event_type").over(W.partitionBy("video_id").orderBy("seq"))
    pairs = frames(spark, sf_dir).select(before.alias("a"), F.col("event_type").alias("b")).where("a is not null").distinct()
    return pairs.select("a", "b", F.round(text.ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


def _clusters(spark, sf_dir, threshold):
    return cluster.similar_clusters(analyses(spark, sf_dir), threshold, GAP).select("video_id", "seq", "cluster_id")


def fuzzy_clusters_gap(spark, sf_dir):
    return _clusters(spark, sf_dir, 1.0)


def fuzzy_clusters_sim(spark, sf_dir):
    return _clusters(spark, sf_dir, 0.2)


def fuzzy_clusters_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    place = F.when(F.col("role") == "user", "top").otherwise("bottom")
    rows = c.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("seq"),
        F.col("turn").cast("double").alias("start_time"),
        (F.col("turn") + 1).cast("double").alias("end_time"),
        F.array(element(F.coalesce("text", F.lit("")), F.lit("regular"), F.lit("#FFFFFF"), place)).alias("elements"),
    )
    return cluster.similar_clusters(rows, 0.75, 0.5).select("video_id", "seq", "cluster_id")


def majority_first_tie(spark, sf_dir):
    return reconcile.first_majority(frames(spark, sf_dir), ["video_id"], "event_type", "seq")


def majority_quality(spark, sf_dir):
    votes = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return reconcile.first_majority(votes, ["source"], "quality", "doc_id")


def _varied(spark, sf_dir):
    rows = analyses(spark, sf_dir, True)
    day = F.floor(F.col("start_time") / 86400).cast("bigint")
    return rows.where(F.size("elements") > 0).withColumn("cluster_id", day)


def distinct_positions(spark, sf_dir):
    rows = _varied(spark, sf_dir).select("video_id", "cluster_id", F.col("elements")[0]["position"].alias("position"))
    return reconcile.distinct_positions(rows, ["video_id", "cluster_id"]).select("video_id", "cluster_id", F.array_join("positions", ",").alias("positions"))


def cluster_collapse(spark, sf_dir):
    done = reconcile.collapse(_varied(spark, sf_dir), reconcile.majority_text)
    flat = F.array_join(F.transform("elements", lambda x: F.concat_ws("|", x["position"], x["text"], x["style"], x["color"])), ";")
    return done.select("video_id", "seq", "start_time", "end_time", flat.alias("elements"))


def numbered_readings(spark, sf_dir):
    rows = _varied(spark, sf_dir).select("video_id", "cluster_id", F.struct("seq", F.col("elements")[0]["text"].alias("t")).alias("x"))
    texts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return rows.groupBy("video_id", "cluster_id").agg(text.numbered(texts).alias("body"))


def _lines(spark, sf_dir):
    f = frames(spark, sf_dir)
    line = lambda no, payload, keep: f.where(keep).select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") * 2 + no).alias("line_no"), payload.alias("payload"))
    stale = f.where("event_id % 50 = 0").select(F.concat(F.lit("x"), F.col("event_id")).alias("id"), F.lit(0).cast("bigint").alias("line_no"), F.lit("stale").alias("payload"))
    return line(0, F.col("event_type"), F.col("event_id") % 3 == 0).unionByName(line(1, F.lit("again"), F.col("event_id") % 6 == 0)).unionByName(stale)


def resume_last_write(spark, sf_dir):
    return checkpoint.last_written(_lines(spark, sf_dir)).select("id", "payload")


def resume_split(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "video_id", "seq")
    done, rest = checkpoint.split_done(f, _lines(spark, sf_dir))
    return done.select("id", "video_id", "seq", "payload").unionByName(rest.select("id", "video_id", "seq", F.lit(None).cast("string").alias("payload")))


def backend_sum(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("model"), F.col("s_nationkey").cast("string")).alias("model_name"), (F.col("s_suppkey") % 16 + 1).alias("max_parallel_requests"))
    return worker_limits(s)


def kept_count(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("video_id").agg(F.count_if(F.col("event_type") != "error").alias("kept"))


def event_similarity(spark, sf_dir):
    """Same positions, and for each the same joined text, of neighbours."""
    rows = analyses(spark, sf_dir, True)
    p = F.lag("elements").over(W.partitionBy("video_id").orderBy("seq"))
    e = rows.withColumn("p", p).where(F.col("p").isNotNull())
    alike = text.positions(F.col("elements")) == text.positions(F.col("p"))
    for place in ("top", "bottom"):
        alike &= text.text_at(F.col("elements"), place) == text.text_at(F.col("p"), place)
    return e.select("video_id", "seq", alike.alias("alike"))


def _events(spark, sf_dir):
    return analyses(spark, sf_dir, True).withColumn("start_time", F.col("start_time") / 500).withColumn("end_time", F.col("end_time") / 500)


def dialogue_lines(spark, sf_dir):
    return ass.dialogue_lines(_events(spark, sf_dir))


def _videos(spark, sf_dir):
    v = frames(spark, sf_dir).select("video_id").distinct()
    return v.select("video_id", F.lit(1920).alias("width"), (F.col("video_id") % 3 * 360 + 360).cast("int").alias("height"), F.lit(RATE).alias("fps"))


def ass_document(spark, sf_dir):
    return ass.ass_documents(_events(spark, sf_dir), _videos(spark, sf_dir))


def _answer(path: str) -> str:
    kind = path.partition("/")[0]
    return json.dumps({"has_text": kind != "error", "subtitles": [{"text": kind}]})


def _seen(path: str) -> str:
    return "no answer" if int(path.partition("/")[2]) % 97 == 0 else _answer(path)


VISION = ScriptedClient(seen=_seen)
READER = ScriptedClient(seen=_answer)
PICKER = ScriptedClient(said=lambda prompt: sorted(x.partition(". ")[2] for x in prompt.split("\n"))[0])
ONCE = RetryPolicy(2, 0.0, 0.0)


def model_cascade(spark, sf_dir):
    groups = frames(spark, sf_dir).withColumnRenamed("path", "frame").select("event_id", "frame")
    read = infer.analyze(infer.prefilter(groups, READER, 8, ONCE), READER, 8, ONCE)
    return read.select("event_id", "has_text", F.coalesce(F.get("elements", F.lit(0))["text"], F.lit("")).alias("text"))


def stage_failures(spark, sf_dir):
    groups = frames(spark, sf_dir).withColumnRenamed("path", "frame").select("event_id", "frame")
    done = infer.prefilter(groups, VISION, 8, ONCE)
    return done.groupBy().agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("attempts").cast("bigint").alias("attempts"))


def pipeline_end_to_end(spark, sf_dir):
    store = checkpoint.Store(spark, f"{shared_folder(spark)}/captions-{uuid.uuid4().hex}")
    config = EngineConfig(edge_diff_threshold=100.0, similarity_threshold=0.2, gap_tolerance=GAP, skip=("24:00:00-48:00:00",), retry=ONCE)
    return captions.captions(frames(spark, sf_dir), _videos(spark, sf_dir), config, READER, PICKER, store)


#: Pictures made from events: grey, WIDE x HIGH, so strips of 3 rows at the top and the bottom.
WIDE, HIGH = 5, 15


def _pictures(event_ids: np.ndarray) -> np.ndarray:
    y, x = np.mgrid[0:HIGH, 0:WIDE]
    grey = (event_ids[:, None, None] * 7 + y * y * 31 + x * 17) % 256
    return np.repeat(grey.astype(np.uint8)[..., None], 3, axis=-1)


def edge_maps(spark, sf_dir):
    """The sum and the largest value of the edge map of each event's picture."""

    def work(batches):
        for batch in batches:
            maps = segment.edge_map(_pictures(batch["event_id"].to_numpy())).astype(np.int64)
            yield pd.DataFrame({"event_id": batch["event_id"], "total": maps.sum(axis=(1, 2)), "most": maps.max(axis=(1, 2))})

    return table(spark, sf_dir, "events").select("event_id").mapInPandas(work, "event_id bigint, total bigint, most bigint")


def edge_groups(spark, sf_dir):
    """Frames grouped by the edges of their pictures, loaded by path inside the fold."""
    load = lambda paths: segment.edge_map(_pictures(np.array([int(path.rpartition("/")[2]) for path in paths])))
    groups = segment.anchored_groups(frames(spark, sf_dir).withColumn("file", F.col("path")), 100.0, "file", load, segment.edge_difference, 1000)
    return groups.select("video_id", "seq", "n_frames")


def required_lookup(spark, sf_dir):
    """Every nation must have its region, as every group must have its answer."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r_regionkey"))
    return lookup.required_lookup(nations, table(spark, sf_dir, "region"), ["r_regionkey"]).select("id", "r_name")


def _written(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lines_round_trip(spark, sf_dir):
    """Frames written as JSON lines, in two appends, and read again."""
    f, path = frames(spark, sf_dir).select("video_id", "seq", "path", "timestamp"), _written(spark, "lines")
    files.write_lines(f.where("seq % 2 = 0"), path)
    files.write_lines(f.where("seq % 2 = 1"), path, append=True)
    return files.read_lines(spark, path).select(F.from_json("value", "video_id bigint, seq bigint, path string, timestamp double").alias("r")).select("r.*")


def manifest_round_trip(spark, sf_dir):
    """The videos' manifest, one JSON array, written and read again."""
    path = _written(spark, "manifest")
    files.write_json_array(_videos(spark, sf_dir), path, ["video_id"])
    return files.read_json(spark, path, "video_id bigint, width int, height int, fps double")


def document_files(spark, sf_dir):
    """The written .ass files, line by line."""
    path = _written(spark, "documents")
    files.write_documents(ass_document(spark, sf_dir), path)
    lines = files.read_documents(spark, path).select("video_id", F.explode(F.split("content", r"\r\n|\r|\n")).alias("value")).where("value like 'Dialogue%'")
    return lines.groupBy("video_id").agg(F.count("*").alias("n"), F.min("value").alias("least"))


def probe_parse(spark, sf_dir):
    raw = F.concat(F.lit('{"streams": [{"width": '), F.col("event_id") % 3000, F.lit(', "height": 720, "r_frame_rate": "'), F.expr(_RATES), F.lit('"}]}'))
    probe = F.when(F.col("event_id") % 11 == 0, '{"streams": []}').otherwise(raw)
    return parse_probes(table(spark, sf_dir, "events").select("event_id", probe.alias("probe"))).select("event_id", "width", "height", "fps")


def model_reconcile(spark, sf_dir):
    """Clusters of a day, settled by a client that picks the reading that sorts first."""
    done = infer.reconcile(_varied(spark, sf_dir), PICKER, 8, ONCE)
    flat = F.array_join(F.transform("elements", lambda x: F.concat_ws("|", x["position"], x["text"], x["style"], x["color"])), ";")
    return done.select("video_id", "cluster_id", "seq", "start_time", "end_time", flat.alias("elements"), "attempts")


def stored_stages(spark, sf_dir):
    """Rows stored by a stage that fails for some, and by the run after it."""
    groups = frames(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), "seq", F.col("path").alias("frame"))
    store = checkpoint.Store(spark, _written(spark, "stages"))
    try:
        store.rows("filter", groups, lambda df: infer.prefilter(df, VISION, 8, ONCE), source=sf_dir)
    except checkpoint.StageFailed:
        pass
    return store.rows("filter", groups, lambda df: infer.prefilter(df, READER, 8, ONCE), source=sf_dir).select("id", "seq", "has_text", "attempts")


def queries() -> dict[str, Query]:
    own = (
        skip_anti_join, skip_merge_ranges, skip_range_counts, time_format, time_parse, frame_timestamps, fps_parse, anchored_groups,
        anchored_groups_l1, prefilter_parse, elements_parse, color_resolve, ass_color, identical_runs, ratio_pairs, fuzzy_clusters_gap,
        fuzzy_clusters_sim, fuzzy_clusters_text, majority_first_tie, majority_quality, distinct_positions, cluster_collapse, numbered_readings,
        resume_last_write, resume_split, backend_sum, kept_count, event_similarity, dialogue_lines, ass_document, model_cascade, stage_failures,
        pipeline_end_to_end, edge_maps, edge_groups, required_lookup, lines_round_trip, manifest_round_trip, document_files, probe_parse,
        model_reconcile, stored_stages,
    )
    return {f.__name__: f for f in own}


_F = (
    "f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, event_type, value, "
    "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t FROM events)"
)
_R = "r(range_start, range_end) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in SKIP) + ")"
_A = (
    "a AS (SELECT video_id, seq, event_id, event_type AS text, t AS start_time, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY seq), t) AS end_time, "
    "CASE WHEN event_id % 3 = 0 THEN 'italic' ELSE 'regular' END AS style, "
    "CASE event_id % 4 WHEN 1 THEN '#FFFF00' WHEN 2 THEN '#00FFFF' ELSE '#FFFFFF' END AS color, "
    "CASE WHEN event_id % 5 = 0 THEN 'top' ELSE 'bottom' END AS position FROM f)"
)
_SHOW = (
    "CASE WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60 % 60, s % 60) END"
)
_CS = "printf('%d:%02d:%02d.%02d', {c} // 360000, {c} // 6000 % 60, {c} // 100 % 60, {c} % 100)"
_RGB = "CASE {c} WHEN 'white' THEN '#FFFFFF' WHEN 'yellow' THEN '#FFFF00' WHEN 'cyan' THEN '#00FFFF' ELSE CASE WHEN {c}[1] = '#' THEN {c} ELSE '#FFFFFF' END END"
# Ratios of the event types, row against column.
_RATIOS = """r(a, b, ratio) AS (VALUES ('click','click',1.0),('click','error',0.0),('click','purchase',0.1538),('click','signup',0.1818),('click','view',0.2222),
('error','click',0.0),('error','error',1.0),('error','purchase',0.1538),('error','signup',0.0),('error','view',0.2222),
('purchase','click',0.1538),('purchase','error',0.1538),('purchase','purchase',1.0),('purchase','signup',0.1429),('purchase','view',0.1667),
('signup','click',0.1818),('signup','error',0.0),('signup','purchase',0.1429),('signup','signup',1.0),('signup','view',0.2),
('view','click',0.2222),('view','error',0.2222),('view','purchase',0.1667),('view','signup',0.2),('view','view',1.0))"""


def _clusters_sql(threshold: float) -> str:
    return (
        f"WITH {_F}, {_A}, {_RATIOS}, n AS (SELECT *, lag(text) OVER w AS pt, lag(end_time) OVER w AS pe FROM a WHERE text <> 'error' WINDOW w AS (PARTITION BY video_id ORDER BY seq)), "
        f"k AS (SELECT n.video_id, seq, CASE WHEN pt IS NOT NULL AND start_time - pe <= {GAP} AND ratio >= {threshold} THEN 0 ELSE 1 END AS new FROM n LEFT JOIN r ON r.a = pt AND r.b = text) "
        "SELECT video_id, seq, sum(new) OVER (PARTITION BY video_id ORDER BY seq)::BIGINT AS cluster_id FROM k"
    )


def oracle_sql() -> dict[str, str]:
    groups = (
        "SELECT video_id, min(seq)::BIGINT AS seq, min(t) AS start_time, max(t) AS end_time, count(*) AS n_frames FROM x GROUP BY video_id, g"
    )
    line = (
        "'Dialogue: 0,' || " + _CS.format(c="cs") + " || ',' || " + _CS.format(c="ce") + " || ',Default,,0,0,0,,{\\an' || CASE position WHEN 'top' THEN '8' ELSE '2' END || "
        "'\\c&H' || substr(color, 6, 2) || substr(color, 4, 2) || substr(color, 2, 2) || '&' || CASE style WHEN 'italic' THEN '\\i1' ELSE '' END || '}' || text"
    )
    lines = (
        f"WITH {_F}, {_A}, c AS (SELECT *, round_even(start_time / 500 * 100, 0)::BIGINT AS cs, round_even(end_time / 500 * 100, 0)::BIGINT AS ce FROM a WHERE text <> 'error'), "
        f"l AS (SELECT video_id, seq, 0 AS pos, {line} AS line FROM c)"
    )
    # the two strips of a picture, one above the other, and their edges: 9 times a pixel less its 3 x 3 neighbours; borders as they are
    grey = "(event_id * 7 + {y} * {y} * 31 + {x} * 17) % 256"
    pixels = (
        "p AS (SELECT event_id, r, x, " + grey.format(y="([0, 1, 2, 12, 13, 14])[r]", x="x") + " AS v FROM (SELECT event_id FROM events), range(1, 7) AS a(r), range(0, 5) AS b(x)), "
        "s AS (SELECT *, sum(v) OVER (PARTITION BY event_id, r ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM p), "
        "n AS (SELECT *, sum(h) OVER (PARTITION BY event_id, x ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM s), "
        "e AS (SELECT event_id, r, x, CASE WHEN r IN (1, 6) OR x IN (0, 4) THEN v ELSE greatest(0, least(255, 9 * v - w)) END AS v FROM n)"
    )
    edges = f"{pixels}, m AS (SELECT event_id, list(v ORDER BY r, x) AS v FROM e GROUP BY event_id)"
    # the whole run: skip, group, filter, read, merge, cluster, pick the first reading, write
    run = (
        f"WITH RECURSIVE {_F}, {_RATIOS}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM f WHERE t NOT BETWEEN 86400 AND 172800), "
        "x AS (SELECT video_id, n, seq, t, value AS anchor, seq AS g FROM k WHERE n = 1 UNION ALL "
        "SELECT k.video_id, k.n, k.seq, k.t, CASE WHEN abs(x.anchor - k.value) <= 100 THEN x.anchor ELSE k.value END, CASE WHEN abs(x.anchor - k.value) <= 100 THEN x.g ELSE k.seq END "
        "FROM x JOIN k ON k.video_id = x.video_id AND k.n = x.n + 1), "
        "g AS (SELECT video_id, g AS seq, min(t) AS s, max(t) AS e FROM x GROUP BY video_id, g), "
        "o AS (SELECT g.video_id, g.seq, s, e, event_type AS text FROM g JOIN f ON f.video_id = g.video_id AND f.seq = g.seq), "
        "q AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY video_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM o), "
        "h AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY seq) AS run FROM q), "
        "v AS (SELECT video_id, min(seq) AS seq, arg_min(s, seq) AS s, arg_max(e, seq) AS e, min(text) AS text FROM h WHERE text <> 'error' GROUP BY video_id, run), "
        "p AS (SELECT *, lag(text) OVER w AS pt, lag(e) OVER w AS pe FROM v WINDOW w AS (PARTITION BY video_id ORDER BY seq)), "
        f"j AS (SELECT p.video_id, seq, s, e, text, CASE WHEN pt IS NOT NULL AND s - pe <= {GAP} AND ratio >= 0.2 THEN 0 ELSE 1 END AS new FROM p LEFT JOIN r ON r.a = pt AND r.b = text), "
        "c AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY seq) AS cluster_id FROM j), "
        "d AS (SELECT video_id, min(seq) AS seq, arg_min(s, seq) AS s, arg_max(e, seq) AS e, min(text) AS text FROM c GROUP BY video_id, cluster_id), "
        "t AS (SELECT video_id, seq, text, round_even(s * 100, 0)::BIGINT AS cs, round_even(e * 100, 0)::BIGINT AS ce FROM d), "
        "b AS (SELECT video_id, string_agg('Dialogue: 0,' || " + _CS.format(c="cs") + " || ',' || " + _CS.format(c="ce") + " || ',Default,,0,0,0,,{\\an2\\c&HFFFFFF&}' || text, chr(10) ORDER BY seq) AS body FROM t GROUP BY video_id) "
    )
    head = ass.HEADER.replace("'", "''").replace("{width}", "1920").replace("{height}", "' || (video_id % 3 * 360 + 360) || '")
    day = "floor(start_time / 86400)::BIGINT AS cluster_id"
    votes = lambda c: f"SELECT video_id, cluster_id, position, {c}, count(*) AS n, min(seq) AS o FROM d GROUP BY ALL"
    best = lambda c: f"(SELECT video_id, cluster_id, position, arg_max({c}, row(n, -o)) AS {c} FROM ({votes(c)}) GROUP BY ALL)"
    return {
        "skip_anti_join": f"WITH {_F}, {_R} SELECT video_id, seq, event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE t BETWEEN range_start AND range_end)",
        "skip_merge_ranges": f"WITH {_F}, x AS (SELECT video_id, t AS s, t + value * 100 AS e FROM f), "
        "n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM x), "
        "g AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) "
        "SELECT video_id, min(s) AS range_start, max(e) AS range_end FROM g GROUP BY video_id, g",
        "skip_range_counts": f"WITH {_F}, {_R} SELECT range_start, range_end, count(t) AS n FROM r LEFT JOIN f ON t BETWEEN range_start AND range_end GROUP BY ALL",
        "time_format": f"WITH {_F}, x AS (SELECT event_id, floor(t / 500)::BIGINT AS s, round_even(t / 500 * 100, 0)::BIGINT AS c FROM f) SELECT event_id, {_SHOW} AS shown, {_CS.format(c='c')} AS ass FROM x",
        "time_parse": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 90 + 0.5::DOUBLE WHEN 1 THEN (event_id % 70 * 60 + event_id % 60)::DOUBLE "
        "WHEN 2 THEN (event_id % 9 * 3600 + event_id % 75 * 60)::DOUBLE + 7.25::DOUBLE END AS seconds FROM events",
        "frame_timestamps": "WITH x AS (SELECT user_id AS video_id, event_id AS number, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events) "
        "SELECT video_id, number, seq, seq / (24000::DOUBLE / 1001) AS timestamp FROM x",
        "fps_parse": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 24000::DOUBLE / 1001 WHEN 1 THEN 25.0::DOUBLE WHEN 3 THEN 30.0::DOUBLE END AS fps FROM events",
        "anchored_groups": f"WITH RECURSIVE {_F}, x AS (SELECT video_id, seq, t, value AS anchor, seq AS g FROM f WHERE seq = 0 UNION ALL "
        "SELECT f.video_id, f.seq, f.t, CASE WHEN abs(x.anchor - f.value) <= 100 THEN x.anchor ELSE f.value END, CASE WHEN abs(x.anchor - f.value) <= 100 THEN x.g ELSE f.seq END "
        f"FROM x JOIN f ON f.video_id = x.video_id AND f.seq = x.seq + 1) {groups}",
        "anchored_groups_l1": "WITH RECURSIVE f AS (SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, embedding::DOUBLE[] AS v FROM embeddings), "
        "x AS (SELECT video_id, seq, v AS anchor, seq AS g FROM f WHERE seq = 0 UNION ALL SELECT video_id, seq, CASE WHEN near THEN anchor ELSE v END, CASE WHEN near THEN g ELSE seq END FROM ("
        "SELECT f.video_id, f.seq, f.v, x.anchor, x.g, list_avg(list_transform(list_zip(x.anchor, f.v), lambda p: abs(p[1] - p[2]))) <= 0.12 AS near FROM x JOIN f ON f.video_id = x.video_id AND f.seq = x.seq + 1)) "
        "SELECT video_id, min(seq)::BIGINT AS seq, count(*) AS n_frames FROM x GROUP BY video_id, g",
        "prefilter_parse": f"WITH x AS (SELECT event_id, {_HAS_TEXT} AS raw FROM events), y AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS j FROM x) "
        "SELECT event_id, CASE WHEN json_type(j, '$.has_text') = 'BOOLEAN' OR lower(j ->> '$.has_text') IN ('true', 'false') THEN lower(j ->> '$.has_text')::BOOLEAN END AS has_text FROM y",
        "elements_parse": "SELECT event_id, event_id % 9 < 4 AS ok, CASE event_id % 9 WHEN 0 THEN event_type || '|regular|#FFFFFF|bottom' WHEN 1 THEN '' WHEN 2 THEN '' "
        "WHEN 3 THEN event_type || '|italic|#FFFF00|top;b|regular|#FFFFFF|bottom' END AS elements FROM events",
        "color_resolve": f"WITH x AS (SELECT event_id, {_COLORS} AS c FROM events) SELECT event_id, {_RGB.format(c='c')} AS color FROM x",
        "ass_color": f"WITH x AS (SELECT event_id, {_COLORS} AS c FROM events), y AS (SELECT event_id, upper({_RGB.format(c='c')}) AS c FROM x) "
        "SELECT event_id, '&H' || substr(c, 6, 2) || substr(c, 4, 2) || substr(c, 2, 2) || '&' AS code FROM y",
        "identical_runs": f"WITH {_F}, {_A}, n AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY video_id ORDER BY seq) THEN 0 ELSE 1 END AS n FROM a), "
        "g AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY seq) AS g FROM n) "
        "SELECT video_id, min(seq)::BIGINT AS seq, arg_min(start_time, seq) AS start_time, arg_max(end_time, seq) AS end_time, min(text) AS text FROM g WHERE text <> 'error' GROUP BY video_id, g",
        "ratio_pairs": f"WITH {_F}, {_RATIOS}, k AS (SELECT DISTINCT lag(event_type) OVER (PARTITION BY video_id ORDER BY seq) AS a, event_type AS b FROM f) SELECT a, b, ratio::DOUBLE AS ratio FROM r JOIN k USING (a, b)",
        "fuzzy_clusters_gap": _clusters_sql(1.0),
        "fuzzy_clusters_sim": _clusters_sql(0.2),
        "majority_first_tie": f"WITH {_F}, v AS (SELECT video_id, event_type, count(*) AS n, min(seq) AS o FROM f GROUP BY ALL) SELECT video_id, arg_max(event_type, row(n, -o)) AS event_type, max(n) AS n FROM v GROUP BY video_id",
        "majority_quality": "WITH v AS (SELECT source, quality, count(*) AS n, min(doc_id) AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT source, arg_max(quality, row(n, -o)) AS quality, max(n) AS n FROM v GROUP BY source",
        "distinct_positions": f"WITH {_F}, {_A} SELECT video_id, cluster_id, string_agg(position, ',' ORDER BY position) AS positions FROM (SELECT DISTINCT video_id, {day}, position FROM a WHERE text <> 'error') GROUP BY ALL",
        "cluster_collapse": f"WITH {_F}, {_A}, d AS (SELECT *, {day} FROM a WHERE text <> 'error'), s AS (SELECT video_id, cluster_id, min(seq) AS seq, arg_min(start_time, seq) AS start_time, arg_max(end_time, seq) AS end_time FROM d GROUP BY ALL) "
        "SELECT s.video_id, s.seq, s.start_time, s.end_time, string_agg(position || '|' || text || '|' || style || '|' || color, ';' ORDER BY position) AS elements "
        f"FROM s JOIN {best('text')} USING (video_id, cluster_id) JOIN {best('style')} USING (video_id, cluster_id, position) JOIN {best('color')} USING (video_id, cluster_id, position) GROUP BY ALL",
        "numbered_readings": f"WITH {_F}, {_A}, d AS (SELECT video_id, {day}, seq, text, row_number() OVER (PARTITION BY video_id, floor(start_time / 86400) ORDER BY seq) AS k FROM a WHERE text <> 'error') "
        "SELECT video_id, cluster_id, string_agg(k || '. ' || text, chr(10) ORDER BY k) AS body FROM d GROUP BY ALL",
        "resume_last_write": "SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 6 = 0 THEN 'again' ELSE event_type END AS payload FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'x' || event_id, 'stale' FROM events WHERE event_id % 50 = 0",
        "resume_split": f"WITH {_F} SELECT event_id::VARCHAR AS id, video_id, seq, CASE WHEN event_id % 6 = 0 THEN 'again' WHEN event_id % 3 = 0 THEN event_type END AS payload FROM f",
        "backend_sum": "SELECT 'model' || s_nationkey AS model_name, sum(s_suppkey % 16 + 1)::BIGINT AS workers FROM supplier GROUP BY ALL",
        "kept_count": "SELECT user_id AS video_id, count(*) FILTER (event_type <> 'error') AS kept FROM events GROUP BY ALL",
        "event_similarity": f"WITH {_F}, {_A}, k AS (SELECT video_id, seq, CASE WHEN text = 'error' THEN '' ELSE position || '|' || text END AS k FROM a), "
        "p AS (SELECT *, lag(k) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM k) SELECT video_id, seq, k = p AS alike FROM p WHERE p IS NOT NULL",
        "edge_maps": f"WITH {pixels} SELECT event_id, sum(v)::BIGINT AS total, max(v)::BIGINT AS most FROM e GROUP BY event_id",
        "edge_groups": f"WITH RECURSIVE {_F}, {edges}, w AS MATERIALIZED (SELECT f.video_id, f.seq, f.t, m.v FROM f JOIN m USING (event_id)), "
        "y AS (SELECT video_id, seq, t, v AS anchor, seq AS g FROM w WHERE seq = 0 UNION ALL SELECT video_id, seq, t, CASE WHEN near THEN anchor ELSE v END, CASE WHEN near THEN g ELSE seq END FROM ("
        "SELECT w.video_id, w.seq, w.t, w.v, y.anchor, y.g, list_avg(list_transform(list_zip(y.anchor, w.v), lambda z: abs(z[1] - z[2]))) <= 100 AS near FROM y JOIN w ON w.video_id = y.video_id AND w.seq = y.seq + 1)) "
        "SELECT video_id, min(seq)::BIGINT AS seq, count(*) AS n_frames FROM y GROUP BY video_id, g",
        "required_lookup": "SELECT n_nationkey AS id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "lines_round_trip": f"WITH {_F} SELECT video_id, seq, event_type || '/' || event_id AS path, t AS timestamp FROM f",
        "manifest_round_trip": f"SELECT DISTINCT user_id AS video_id, 1920 AS width, (user_id % 3 * 360 + 360)::INTEGER AS height, 24000::DOUBLE / 1001 AS fps FROM events",
        "document_files": f"{lines} SELECT video_id, count(*) AS n, min(line) AS least FROM l GROUP BY video_id",
        "probe_parse": "SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 3000 END::INTEGER AS width, CASE WHEN event_id % 11 > 0 THEN 720 END AS height, "
        "CASE WHEN event_id % 11 > 0 THEN CASE event_id % 5 WHEN 0 THEN 24000::DOUBLE / 1001 WHEN 1 THEN 25.0::DOUBLE WHEN 3 THEN 30.0::DOUBLE END END AS fps FROM events",
        "model_reconcile": f"WITH {_F}, {_A}, d AS (SELECT *, {day} FROM a WHERE text <> 'error'), "
        "s AS (SELECT video_id, cluster_id, min(seq) AS seq, arg_min(start_time, seq) AS start_time, arg_max(end_time, seq) AS end_time, count(*) AS n FROM d GROUP BY ALL), "
        "m AS (SELECT video_id, cluster_id, position, min(text) AS text FROM d GROUP BY ALL) "
        "SELECT s.video_id, cluster_id, s.seq, s.start_time, s.end_time, string_agg(position || '|' || text || '|' || style || '|' || color, ';' ORDER BY position) AS elements, CASE WHEN any_value(s.n) > 1 THEN 1 ELSE 0 END AS attempts "
        f"FROM s JOIN m USING (video_id, cluster_id) JOIN {best('style')} USING (video_id, cluster_id, position) JOIN {best('color')} USING (video_id, cluster_id, position) GROUP BY ALL",
        "stored_stages": f"WITH {_F} SELECT event_id::VARCHAR AS id, seq, event_type <> 'error' AS has_text, 1 AS attempts FROM f",
        "pipeline_end_to_end": f"{run} SELECT video_id, '{head}' || coalesce(body || chr(10), '') AS content FROM (SELECT DISTINCT video_id FROM f) LEFT JOIN b USING (video_id)",
        "dialogue_lines": f"{lines} SELECT video_id, seq, pos, line FROM l",
        "ass_document": f"{lines}, v AS (SELECT DISTINCT video_id FROM f), b AS (SELECT video_id, string_agg(line, chr(10) ORDER BY seq) AS body FROM l GROUP BY ALL) "
        f"SELECT video_id, '{head}' || coalesce(body || chr(10), '') AS content FROM v LEFT JOIN b USING (video_id)",
        "model_cascade": "SELECT event_id, event_type <> 'error' AS has_text, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text FROM events",
        "stage_failures": "SELECT count(*) FILTER (event_id % 97 = 0) AS failed, sum(CASE WHEN event_id % 97 = 0 THEN 2 ELSE 1 END)::BIGINT AS attempts FROM events",
    }
