import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cuespark.config import EngineConfig, RetryPolicy
from cuespark.functions.ass import ass_documents
from cuespark.operators.cluster import similar_clusters
from cuespark.operators.ranges import drop_in_ranges, range_counts
from cuespark.operators.reconcile import collapse, first_majority, majority_text
from cuespark.operators.runs import identical_runs
from cuespark.operators.segment import anchored_groups
from cuespark.plans import checkpoint, queries
from cuespark.plans.captions import captions
from cuespark.schema import EVENT
from cuespark.sources.models import ScriptedClient

import pytest


def element(text, style="regular", color="#FFFFFF", position="bottom"):
    return (text, style, color, position)


def events(spark, rows):
    return spark.createDataFrame([(1, k, float(a), float(b), [element(*e) if isinstance(e, tuple) else element(e) for e in es]) for k, (a, b, es) in enumerate(rows)], EVENT)


def test_runs_break_on_empty(spark):
    got = identical_runs(events(spark, [(0, 1, ["A"]), (1, 2, ["A"]), (2, 3, []), (3, 4, ["A"]), (4, 3.5, ["A"])])).orderBy("seq").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(0, 2), (3, 3.5)]


def test_clusters_match_a_loop(spark):
    rng = random.Random(4)
    words = ["hello there", "hello here", "bye", "by", "", "hello theres"]
    rows, t = [], 0.0
    for _ in range(150):
        t += rng.choice([0.1, 0.4, 0.5, 0.9])
        es = [(rng.choice(words), "regular", "#FFFFFF", rng.choice(["top", "bottom"])) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
        rows.append((t, t + 0.2, es))
    for threshold, gap in ((0.75, 0.5), (0.4, 0.2), (1.0, 2.0)):
        got = {r.seq: r.cluster_id for r in similar_clusters(events(spark, rows), threshold, gap).collect()}
        want, last, k = {}, None, 0
        for seq, (a, b, es) in enumerate(rows):
            if not es:
                continue
            by = lambda x: {p: "".join(e[0] for e in x if e[3] == p) for p in {e[3] for e in x}}
            ok = last is not None and a - last[1] <= gap and by(es).keys() == by(last[2]).keys()
            ok = ok and all(SequenceMatcher(None, by(last[2])[p], by(es)[p]).ratio() >= threshold for p in by(es))
            k += not ok
            want[seq], last = k, (a, b, es)
        assert got == want


def test_segments_compare_with_the_first(spark):
    values = [0, 3, 6, 9, 12, 12.5, 4]
    frames = spark.createDataFrame([(v, k, f"{k}", k / 2, float(x)) for v in (1, 2) for k, x in enumerate(values)], "video_id bigint, seq bigint, path string, timestamp double, signal double")
    got = sorted((r.video_id, r.start_time, r.end_time, r.frame) for r in anchored_groups(frames, 8.0).collect())
    assert got == [(v, a, b, f) for v in (1, 2) for a, b, f in ((0.0, 1.0, "0"), (1.5, 3.0, "3"))]
    assert anchored_groups(frames.where("false")).count() == 0


def test_signals_loaded_by_lists(spark):
    """Lists of at most three signals, across videos, give the groups that signals loaded one by one give."""
    rng = random.Random(8)
    rows = [(v, k, f"{k}", k / 2, f"{rng.randrange(30)}") for v in (1, 2, 3) for k in range(25)]
    frames = spark.createDataFrame(rows, "video_id bigint, seq bigint, path string, timestamp double, file string")

    def load(files):
        if not isinstance(files, list) or not 0 < len(files) <= 3:
            raise ValueError(f"{files}")
        return [float(x) for x in files]

    asked = [frames, 8.0, "file"]
    got = sorted(map(tuple, anchored_groups(*asked, load, at_once=3).collect()))
    assert got == sorted(map(tuple, anchored_groups(*asked, float).collect())) and 3 < len(got) < 75


def test_edge_queries_match_a_loop(spark, tmp_path):
    """More events than an Arrow batch holds, so that maps are made of full, partial and no batches."""
    events = spark.range(12000).selectExpr("id * 37 AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.0D AS value")
    events.repartition(1).write.parquet(f"{tmp_path}/events.parquet")

    def edges(i):
        grey = [[(i * 7 + y * y * 31 + x * 17) % 256 for x in range(5)] for y in (0, 1, 2, 12, 13, 14)]
        inner = lambda r, x: 9 * grey[r][x] - sum(grey[r + a][x + b] for a in (-1, 0, 1) for b in (-1, 0, 1))
        return [grey[r][x] if r in (0, 5) or x in (0, 4) else max(0, min(255, inner(r, x))) for r in range(6) for x in range(5)]

    maps = {37 * k: edges(37 * k) for k in range(12000)}
    assert {r.event_id: (r.total, r.most) for r in queries.edge_maps(spark, str(tmp_path)).collect()} == {i: (sum(m), max(m)) for i, m in maps.items()}
    want = []
    for user in range(3):
        anchor = None
        for seq, k in enumerate(range(user, 12000, 3)):
            m = maps[37 * k]
            if anchor is None or sum(abs(a - b) for a, b in zip(anchor, m)) / 30 > 100:
                anchor = m
                want.append([user, seq, 0])
            want[-1][2] += 1
    assert sorted(map(list, queries.edge_groups(spark, str(tmp_path)).collect())) == want
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert queries.edge_maps(spark, f"{tmp_path}/none").count() == 0 == queries.edge_groups(spark, f"{tmp_path}/none").count()


def test_ranges(spark):
    frames = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 2.0)], "timestamp double")
    ranges = [(0.5, 1.0)]
    table = spark.createDataFrame([*ranges, (5.0, 6.0)], "range_start double, range_end double")
    assert sorted(r[0] for r in drop_in_ranges(frames, ranges).collect()) == [0, 2] == sorted(r[0] for r in drop_in_ranges(frames, table).collect())
    assert drop_in_ranges(frames, []).count() == 4
    assert {r.range_start: r.n for r in range_counts(frames, table).collect()} == {0.5: 2, 5.0: 0}


def test_majority_and_collapse(spark):
    votes = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "c", 0)], "k int, v string, o int")
    assert {r.k: (r.v, r.n) for r in first_majority(votes, ["k"], "v", "o").collect()} == {1: ("b", 2), 2: ("c", 1)}
    rows = events(spark, [(5, 6, [("x", "italic", "#FFFF00", "top"), "low"]), (6, 9.5, [("x", "regular", "#FFFF00", "top"), "low", "law"]), (20, 21, ["p", "q"])])
    clustered = rows.withColumn("cluster_id", F.when(F.col("seq") < 2, 1).otherwise(2).cast("bigint"))
    got = collapse(clustered, majority_text).orderBy("seq").collect()
    assert [(r.start_time, r.end_time) for r in got] == [(5, 9.5), (20, 21)]
    assert [tuple(e) for e in got[0].elements] == [element("low"), ("x", "italic", "#FFFF00", "top")]
    assert [e.text for e in got[1].elements] == ["p", "q"]


def test_documents(spark):
    videos = spark.createDataFrame([(1, 1920, 1080), (2, 640, 480)], "video_id bigint, width int, height int")
    got = {r.video_id: r.content for r in ass_documents(events(spark, [(0, 1.5, [("Hi", "italic", "#FFFF00", "top"), "low"])]), videos).collect()}
    assert got[1].endswith("Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,{\\an8\\c&H00FFFF&\\i1}Hi\nDialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,{\\an2\\c&HFFFFFF&}low\n")
    assert "PlayResX: 640\n" in got[2] and "Dialogue" not in got[2]


def test_pipeline_resumes(spark, tmp_path):
    frames = spark.createDataFrame([(1, k, f"{c}{k}", k / 2, float(ord(c))) for k, c in enumerate("aaabbbzaa")], "video_id bigint, seq bigint, path string, timestamp double, signal double")
    videos = spark.createDataFrame([(1, 1920, 1080, 2.0)], "video_id bigint, width int, height int, fps double")
    config = EngineConfig(edge_diff_threshold=0.5, retry=RetryPolicy(2, 0, 0))
    bad = ScriptedClient(seen=lambda p: "?" if p[0] == "b" else '{"has_text": true, "subtitles": [{"text": "%s"}]}' % p[0])
    good = ScriptedClient(seen=lambda p: '{"has_text": %s, "subtitles": [{"text": "%s"}]}' % ("false" if p[0] == "z" else "true", p[0]), said=lambda p: p)
    store = checkpoint.Store(spark, str(tmp_path))
    with pytest.raises(checkpoint.StageFailed) as failed:
        captions(frames, videos, config, bad, bad, store)
    assert failed.value.failed == 1
    fallback = ScriptedClient(seen=lambda p: good.seen(p) if p[0] in "bz" or True else "", said=lambda p: p)
    content = captions(frames, videos, config, fallback, fallback, store).collect()[0].content
    assert [x.rsplit("}")[-1] for x in content.split("\n") if x.startswith("Dialogue")] == ["a", "b", "z", "a"]
    changed = EngineConfig(edge_diff_threshold=0.5, retry=RetryPolicy(2, 0, 0), skip=("0-1",))
    content = captions(frames, videos, changed, good, good, store).collect()[0].content
    assert [x.rsplit("}")[-1] for x in content.split("\n") if x.startswith("Dialogue")] == ["b", "a"]


def test_pipeline_query_takes_every_frame(spark, tmp_path, monkeypatch):
    store = checkpoint.Store(spark, f"{tmp_path}/store")
    monkeypatch.setattr(checkpoint, "Store", lambda *_: store)
    rows = [(96, "click", 0.0), (97, "purchase", 500.0), (98, "click", 1000.0)]
    events = spark.createDataFrame([(i, 1, f"2024-01-01 0{i - 95}:00:00", k, v) for i, k, v in rows], "event_id bigint, user_id bigint, ts string, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    content = queries.pipeline_end_to_end(spark, str(tmp_path)).collect()[0].content
    assert [x.rsplit("}")[-1] for x in content.split("\n") if x.startswith("Dialogue")] == ["click", "purchase", "click"]


def test_last_write_wins(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("zz", 3, "s")], "id string, line_no bigint, payload string")
    elements = spark.createDataFrame([("b", 1), ("a", 0)], "id string, seq bigint")
    done, rest = checkpoint.split_done(elements, lines)
    assert [(r.id, r.payload) for r in done.collect()] == [("a", "y")] and [r.id for r in rest.collect()] == ["b"]
