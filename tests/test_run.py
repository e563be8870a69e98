"""Stores, calls, sinks, and a run from videos to documents with a made-up decoder and client."""

import http.server
import json
import struct
import sys
import threading
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cuespark.config import EngineConfig, RetryPolicy
from cuespark.operators import ranges
from cuespark.operators.lookup import required_lookup
from cuespark.plans import infer, queries, run
from cuespark.plans.captions import captions
from cuespark.plans.checkpoint import Store, content
from cuespark.sources import files
from cuespark.sources.models import HttpClient, ScriptedClient, read_image

# executors cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ONCE = RetryPolicy(2, 0, 0)
FRAME = "video_id bigint, seq bigint, path string, timestamp double, signal double"


def frames_of(spark, text):
    return spark.createDataFrame([(1, k, f"{c}{k}", k / 2, float(ord(c))) for k, c in enumerate(text)], FRAME)


def shown(content):
    return [x.rsplit("}")[-1] for x in content.split("\n") if x.startswith("Dialogue")]


def answer(path):
    return json.dumps({"has_text": path[0] != "z", "subtitles": [{"text": path[0]}]})


def test_two_inputs_in_one_store(spark, tmp_path):
    """Another input, another prompt or another way to compare never gets the first one's results."""
    videos = spark.createDataFrame([(1, 1920, 1080, 2.0)], "video_id bigint, width int, height int, fps double")
    config, store = EngineConfig(edge_diff_threshold=0.5, retry=ONCE), Store(spark, str(tmp_path))
    client = ScriptedClient(seen=answer, said=lambda p: p)
    made = lambda df, **more: shown(captions(df, videos, config, client, client, store, **more).collect()[0].content)
    assert made(frames_of(spark, "aab")) == ["a", "b"]
    assert made(frames_of(spark, "xyz")) == ["x", "y"]
    assert made(frames_of(spark, "aab")) == ["a", "b"]
    assert made(frames_of(spark, "ab"), difference=lambda a, b: 0.0) == ["a"]
    assert made(frames_of(spark, "xxq"), source="mine") == ["x", "q"] == made(frames_of(spark, "never read"), source="mine")
    df = frames_of(spark, "aab")
    assert content(df) == content(df.repartition(3)) != content(df.union(df.limit(1))) and content(df) != content(df.drop("path"))


def test_each_row_is_asked_once(spark, tmp_path):
    log = tmp_path / "calls"

    def seen(path):
        with log.open("a") as out:
            out.write(path + "\n")
        return answer(path)

    client = ScriptedClient(seen=seen)
    rows = spark.createDataFrame([(k, f"{'abz'[k % 3]}{k}") for k in range(30)], "event_id bigint, frame string")
    done = infer.analyze(infer.prefilter(rows, client, 4, ONCE), client, 4, ONCE).collect()
    assert len(done) == 30 and all((r.elements == []) == (r.frame[0] == "z") and r.attempts == (r.frame[0] != "z") for r in done)
    bad = ScriptedClient(seen=lambda path: "?" if path[0] == "a" else answer(path))
    kept = infer.analyze(infer.prefilter(rows, bad, 4, ONCE), bad, 4, ONCE).collect()
    assert all((r.error is not None) == (r.elements is None) == (r.frame[0] == "a") for r in kept) and len(kept) == 30
    asked = log.read_text().split()
    assert len(asked) == 50 and all(asked.count(r.frame) == 1 + r.has_text for r in done)


def test_rounds_dont_grow_with_rows(spark, tmp_path):
    rounds = []

    def call(df):
        rounds.append(1)
        return df.withColumns({"error": F.when(F.col("seq") == 7, "x"), "attempts": F.lit(1)})

    store = Store(spark, str(tmp_path))
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"))
    for n, want in ((5, 1), (5000, 4)):
        rounds.clear()
        try:
            assert store.rows(f"s{n}", rows(n), call, batch=10, most_rounds=4).count() == n
        except RuntimeError as error:
            assert n == 5000 and "1 rows" in str(error)
        assert len(rounds) == want
    rounds.clear()
    with pytest.raises(RuntimeError):
        store.rows("s5000", rows(5000), call, batch=10, most_rounds=4)
    assert len(rounds) == 1  # what was done isn't done again
    assert store.rows("none", rows(0), call).count() == 0
    assert store.rows("mine", rows(3).withColumn("id", F.when(F.col("seq") > 0, F.col("id"))), lambda df: call(df)).count() == 2


def test_range_counts_never_broadcast_frames(spark, monkeypatch):
    frames = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.5, 1.0, 2.0, 7.5, None)], "timestamp double")
    own = [(0.5, 1.0), (0.5, 1.0), (0.0, 8.0), (5.0, 6.0), (3.0, 1.0), (None, 1.0)]
    table = spark.createDataFrame(own, "range_start double, range_end double")
    want = {(0.5, 1.0): 3, (0.0, 8.0): 6, (5.0, 6.0): 0, (3.0, 1.0): 0, (None, 1.0): 0}
    for most in (ranges.MOST_BROADCAST, 1):
        monkeypatch.setattr(ranges, "MOST_BROADCAST", most)
        got = ranges.range_counts(frames, table)
        assert {(r.range_start, r.range_end): r.n for r in got.collect()} == want
        kept = ranges.drop_in_ranges(frames, table.where("range_end < 3"))
        assert sorted(r[0] for r in kept.collect() if r[0] is not None) == [0, 2, 7.5] and kept.count() == 4
        assert ranges.range_counts(frames, table.limit(0)).count() == 0 == ranges.range_counts(frames.limit(0), table).agg(F.sum("n")).first()[0]
    plan = ranges.range_counts(frames, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert ranges.drop_in_ranges(frames, [(0.5, 1.0)]).count() == 4


def test_a_missing_key_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "video_id int, frame string")
    known = spark.createDataFrame([("a", True, 1), ("b", False, 2), ("c", True, 3)], "frame string, has_text boolean, n int")
    assert sorted((r.video_id, r.has_text) for r in required_lookup(rows, known, ["frame"]).collect()) == [(1, True), (2, False), (2, False)]
    with pytest.raises(Exception, match="no entry for b"):
        required_lookup(rows, known.where("frame <> 'b'"), ["frame"]).collect()
    with pytest.raises(Exception, match="no entry for b"):
        required_lookup(rows, known.where("frame <> 'b'"), ["frame"]).where("has_text").count()
    assert required_lookup(rows.limit(0), known.limit(0), ["frame"]).count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, f'p"{k}', k / 2) for k in range(40)], "seq bigint, path string, t double").repartition(5)
    kind = "seq bigint, path string, t double"
    for df in (rows, rows.limit(1), rows.limit(0)):
        files.write_json_array(df, f"{tmp_path}/array", ["seq"])
        text = "".join(x.read_text() for x in (tmp_path / "array").glob("part*"))
        assert [tuple(x.values()) for x in json.loads(text)] == sorted(tuple(r) for r in df.collect())
        assert sorted(files.read_json(spark, f"{tmp_path}/array", kind).collect()) == sorted(df.collect())
    one = rows.where("seq = 3")
    files.write_json_object(one, f"{tmp_path}/object")
    assert files.read_json(spark, f"{tmp_path}/object", kind).collect() == one.collect()
    with pytest.raises(ValueError):
        files.write_json_object(rows, f"{tmp_path}/object")
    (tmp_path / "lines.jsonl").write_text('{"id": "a"}\n\n  {"id": "b"}  \n   \n')
    assert [r.value for r in files.read_lines(spark, f"{tmp_path}/lines.jsonl").collect()] == ['{"id": "a"}', '{"id": "b"}']
    assert files.read_lines(spark, f"{tmp_path}/nothing").count() == 0
    files.write_lines(rows, f"{tmp_path}/grown")
    files.write_lines(one, f"{tmp_path}/grown", append=True)
    assert spark.read.schema(kind).json(f"{tmp_path}/grown").count() == 41
    files.write_file(spark, f"{tmp_path}/a.ass", "é\n")
    assert (tmp_path / "a.ass").read_text() == "é\n" and files.file_identity(spark, f"{tmp_path}/a.ass")[0] == 3


def test_client_reads_listed_uris(tmp_path):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    picture = tmp_path / "a b.jpg"
    picture.write_bytes(b"picture")
    config = EngineConfig(filter_model="one", analyze_model="two", inference_url=f"http://127.0.0.1:{server.server_port}/")
    asks, reads, picks = run.clients(config)
    with pytest.raises(Exception, match="503"):
        asks.analyze(str(picture))
    for path in (str(picture), picture.as_uri(), f"file:{picture}".replace(" ", "%20"), picture.read_bytes()):
        assert reads.analyze(path, system="rules", json_mode=True) == "ok"
        assert asked[-1][0] == "/v1/chat/completions" and asked[-1][1]["model"] == "two"
        assert asked[-1][1]["messages"][1]["content"][0]["image_url"]["url"].endswith("cGljdHVyZQ==")
    assert picks.chat("a", "b") == "ok" and asks.model == "one" and isinstance(asks, HttpClient)
    server.shutdown()
    assert read_image(picture.as_uri()) == b"picture"


def png(pixels):
    """Rows of (red, green, blue) as a PNG."""
    raw = b"".join(b"\0" + bytes(x for p in row for x in p) for row in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def probe(path):
    if "bad" in path:
        raise RuntimeError(f"can't be probed: {path}")
    return json.dumps({"streams": [{"width": 20, "height": 15, "r_frame_rate": "2/1"}]})


def decode(path, folder):
    """A letter of the file's name is a frame; equal letters look alike."""
    from pathlib import Path

    for k, c in enumerate(Path(path).stem, 1):
        own = [[((x * 37 + y * 11) * ord(c) % 256,) * 3 for x in range(20)] for y in range(15)]
        Path(folder, f"{k:06d}.jpg").write_bytes(png(own))


def test_video_to_document(spark, tmp_path):
    for name in ("aabbz", "cbc", "bad"):
        (tmp_path / f"{name}.mkv").write_text("a video")

    def seen(path):
        k, name = int(path[-10:-4]), {0: "aabbz", 1: "cbc"}[int(path.split("/")[-2])]
        return answer(name[k - 1])

    client = ScriptedClient(seen=seen, said=lambda p: p)
    videos = spark.createDataFrame([(0, f"{tmp_path}/aabbz.mkv"), (1, f"{tmp_path}/cbc.mkv")], "video_id bigint, path string")
    parts = {"probe": probe, "decode": decode, "vision": client, "text": client}
    got = {r.video_id: r.content for r in run.run(videos, EngineConfig(retry=ONCE, debug=True), f"{tmp_path}/work", **parts).collect()}
    assert shown(got[0]) == ["a", "b"] and shown(got[1]) == ["c", "b", "c"] and "PlayResX: 20\n" in got[0]
    assert "0:00:00.00,0:00:00.50" in got[0] and "0:00:01.00,0:00:01.50" in got[0]
    assert len(files.read_json(spark, f"{tmp_path}/work/manifest.json", "path string").collect()) == 8
    path = run.main([f"{tmp_path}/aabbz.mkv", "--skip", "0-0.5"], spark, **parts)
    assert path == f"{tmp_path}/aabbz.ass" and shown((tmp_path / "aabbz.ass").read_text()) == ["b"]
    with pytest.raises(Exception, match="can't be probed"):
        run.main([f"{tmp_path}/bad.mkv"], spark, **parts)


def test_options(tmp_path):
    config = run.parse(["v.mkv", "--filter-workers", "3", "--skip", "0-90", "--skip", "1:30-22:00", "--gap-tolerance", "0.25", "--inference-url", "http://h:1"])
    assert config.filter_workers == 3 and config.skip == ("0-90", "1:30-22:00") and config.gap_tolerance == 0.25
    assert config.output_path == "v.ass" and run.clients(config)[0].host == "http://h:1" and run.file_limits(config) == {}
    for bad in (["v", "--skip", "9-1"], ["v", "--similarity-threshold", "2"], ["v", "--filter-workers", "0"], []):
        with pytest.raises(SystemExit):
            run.parse(bad)


def test_shared_folder(spark):
    from types import SimpleNamespace as N

    unset = N(get=lambda *_: None)
    assert files.shared_folder(N(conf=N(get=lambda *_: "hdfs://x/y/"))) == "hdfs://x/y"
    assert files.shared_folder(N(conf=unset, sparkContext=N(master="local[4]"))).endswith("checkpoints")
    for master in ("local-cluster[3,2,1024]", "spark://x:7077", "yarn"):
        with pytest.raises(ValueError):
            files.shared_folder(N(conf=unset, sparkContext=N(master=master)))


def test_documents_written_and_read(spark, tmp_path):
    """The same files' texts by the tasks' own writer as by Spark's, which another file system gets."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.documents.link./out", f"file://{tmp_path}")
    long = "\n".join(f"line {k} é" for k in range(3000))
    rows = [(1, "a\nb\n"), (-2, "c"), (3, None), (4, ""), (5, "d\n\n"), (None, "e"), (6, long), (7, "f\r\ng\r")]
    want = sorted((k or 0, {3: "", None: "e"}.get(k, t or "").removesuffix("\n") + "\n") for k, t in rows)
    read = lambda path: sorted((r.video_id or 0, r.content) for r in files.read_documents(spark, path).collect())
    df = spark.createDataFrame(rows, "video_id bigint, content string").repartition(3)
    for path in (f"file://{tmp_path}/own", "viewfs://documents/out/spark"):
        files.write_documents(df.selectExpr("video_id", "'old' AS content").union(df.selectExpr("video_id + 90", "'old'")), path)
        files.write_documents(df, path)
        assert read(path) == want
    assert (tmp_path / "own/video_id=1/document.ass").read_bytes() == b"a\nb\n" and sorted(x.name for x in tmp_path.iterdir()) == ["own", "spark"]
    files.write_documents(df.where("video_id = 4").union(df.where("video_id = -2")).withColumn("video_id", F.lit(9)), f"{tmp_path}/own/")
    assert sorted((tmp_path / "own/video_id=9/document.ass").read_text().split("\n")) == ["", "", "c"]  # one video's rows make one file
    with pytest.raises(Exception, match="broken"):
        files.write_documents(df.select("video_id", F.raise_error(F.lit("broken")).cast("string").alias("content")), f"{tmp_path}/own")
    assert [k for k, _ in read(f"{tmp_path}/own")] == [9] and len(list(tmp_path.iterdir())) == 2  # what was there stays
    files.write_documents(df.limit(0), f"{tmp_path}/own")
    assert read(f"{tmp_path}/own") == []


def test_documents_take_no_task_each(spark, tmp_path):
    """Writing, listing and reading 200 documents take fewer tasks than there are documents."""
    users, start = 200, "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts"
    events = spark.range(2 * users).selectExpr("id AS event_id", start, f"id % {users} AS user_id", "'click' AS event_type", "1.0D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.sparkContext.setJobGroup("documents", "documents")
    rows = queries.document_files(spark, str(tmp_path)).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = {stage for job in tracker.getJobIdsForGroup("documents") for stage in tracker.getJobInfo(job).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.video_id, r.n, r.least[:13]) for r in rows) == [(k, 2, "Dialogue: 0,0") for k in range(users)]
    assert 0 < sum(info.numTasks for info in map(tracker.getStageInfo, stages) if info) < users
