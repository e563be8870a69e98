import json
import math
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespark.config import EngineConfig, RetryPolicy, resolve_workers
from cuespark.functions import ass, text, times
from cuespark.functions.retry import NonRetryable, RetryExhausted, ServiceError, with_retry
from cuespark.operators.ranges import merged
from cuespark.operators.segment import edge_difference, edge_map
from cuespark.schema import color, resolve_color
from cuespark.sources.models import HttpClient
from cuespark.sources.video import parse_probe
from cuespark.sources.workers import worker_limit


@pytest.mark.parametrize(("given", "seconds"), [("90", 90), ("1:30", 90), (" 1:02:03.5 ", 3723.5), ("0:99", 99)])
def test_parse_time(given, seconds):
    assert times.parse_time(given) == seconds


@pytest.mark.parametrize("given", ["1:2:3:4", "abc", "-5", "", "1.5:30"])
def test_parse_time_rejects(given):
    with pytest.raises(ValueError):
        times.parse_time(given)


def test_skip_ranges():
    assert times.parse_skip_range("1:30-22:00") == (90, 1320)
    for bad in ("90", "90-90", "100-90", "abc-90"):
        with pytest.raises(ValueError):
            times.parse_skip_range(bad)
    assert merged([(100, 200), (0, 150)]) == [(0, 200)]
    assert merged([(0, 90), (90, 180)]) == [(0, 180)]
    assert merged([(0, 10), (20, 30)]) == [(0, 10), (20, 30)]
    assert times.format_time(59.9) == "0:59" and times.format_time(3661) == "1:01:01"


def test_column_times(spark):
    values = [0.005, 0.015, 0.025, 1.005, 59.995, 3599.995, 3661.127, 100000.0]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", times.ass_time(F.col("x")).alias("t")).collect()
    for r in rows:
        cs = int(Decimal(r.x * 100).quantize(Decimal(1), ROUND_HALF_EVEN))
        assert r.t == f"{cs // 360000}:{cs // 6000 % 60:02d}:{cs // 100 % 60:02d}.{cs % 100:02d}"
    got = spark.createDataFrame([(x,) for x in ("1:30", "x", "1:2:3:4", "-1", None)], "x string").select(times.time_seconds(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [90.0, None, None, None, None]


def test_colors(spark):
    names = ["white", "yellow", "cyan", "other", "White", "#ABC", "#a1b2c3"]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select("x", color(F.col("x")).alias("c"), ass.ass_color(F.col("x")).alias("a")).collect()
    assert [r.c for r in rows] == [resolve_color(x) for x in names] == ["#FFFFFF", "#FFFF00", "#00FFFF", "#FFFFFF", "#FFFFFF", "#ABC", "#a1b2c3"]
    assert rows[-1].a == "&HC3B2A1&"


def test_elements():
    one = {"text": "a", "style": "regular", "color": "#FFFFFF", "position": "bottom"}
    assert text.parse_elements('{"subtitles": [{"text": "a"}]}') == [one]
    assert text.parse_elements('```json\n{"subtitles": []}\n```') == [] == text.parse_elements("{}")
    for bad in ("[]", '"x"', '{"a": 1}', '{"subtitles": null}', '{"subtitles": [{"text": 1}]}', '{"subtitles": [{"text": "a", "style": "bold"}]}',
                '{"subtitles": [{"text": "a", "color": null}]}', '```json\n{"subtitles": []}'):
        with pytest.raises(ValueError):
            text.parse_elements(bad)


def test_has_text():
    assert [text.parse_has_text(json.dumps({"has_text": x})) for x in (True, False, "true", "False")] == [True, False, True, False]
    for bad in ("not json", "{}", '{"has_text": "yes"}', '{"has_text": 1}', "[]"):
        with pytest.raises(ValueError):
            text.parse_has_text(bad)


def test_retry():
    waits: list[float] = []

    def failing(error):
        def call():
            raise error

        return call

    with pytest.raises(RetryExhausted):
        with_retry(failing(ValueError("x")), RetryPolicy(4, 1, 3), sleep=waits.append)
    assert waits == [1, 2, 3]
    for error in (OSError(), ServiceError(401), ServiceError(404)):
        with pytest.raises(NonRetryable):
            with_retry(failing(error), RetryPolicy(), sleep=waits.append)
    with pytest.raises(KeyError):
        with_retry(failing(KeyError()), RetryPolicy(), sleep=waits.append)
    answers = iter([RuntimeError(), ServiceError(503), 7])

    def sometimes():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert with_retry(sometimes, RetryPolicy(), sleep=waits.append) == (7, 3)


def test_workers_and_config():
    entry = lambda name, n: {"model_name": name, "litellm_params": {"max_parallel_requests": n}}
    config = {"model_list": [entry("m", 10), entry("m", 8), entry("m", 16), entry("*", 5)]}
    assert worker_limit(config, "m") == 34
    for bad in (None, {}, {"model_list": [entry("x", 1)]}, {"model_list": [entry("m", "four")]}, {"model_list": [entry("m", -1)]}):
        with pytest.raises(ValueError):
            worker_limit(bad, "m")
    assert [resolve_workers(2, 5, "filter"), resolve_workers(None, 5, "filter"), resolve_workers(None, None, "reconcile")] == [2, 5, 8]
    assert EngineConfig(video="a/b.mkv").output_path == "a/b.ass"
    for bad in ({"similarity_threshold": 1.5}, {"filter_workers": 0}, {"skip": ("9-1",)}, {"gap_tolerance": -1}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_probe():
    raw = json.dumps({"streams": [{"width": 1920, "height": 1080, "r_frame_rate": "24000/1001"}]})
    assert parse_probe(raw)[:2] == (1920, 1080) and math.isclose(parse_probe(raw)[2], 23.976, abs_tol=1e-3)
    for bad in ('{"streams": []}', raw.replace("24000/1001", "0/0"), "{"):
        with pytest.raises(ValueError):
            parse_probe(bad)


def test_edges():
    white = np.full((100, 100, 3), 255, np.uint8)
    low, middle = white.copy(), white.copy()
    low[80:] = 0
    low[90:, 40:60] = 255
    middle[20:80] = 0
    assert edge_map(white).shape == (40, 100)
    assert edge_difference(edge_map(white), edge_map(low)) > 0
    assert edge_difference(edge_map(white), edge_map(middle)) == 0


def test_edges_of_a_stack():
    """The maps of many images at once are those of each."""
    rng = np.random.default_rng(3)
    for size in ((15, 5), (5, 9), (40, 2), (33, 7)):
        images = rng.integers(0, 256, (2, 6, *size, 3), np.uint8)
        got = edge_map(images)
        assert got.dtype == np.uint8 and got.tolist() == [[edge_map(x).tolist() for x in row] for row in images]
    assert edge_map(images[:, :0]).shape == (2, 0, 14, 7)
    with pytest.raises(ValueError):
        edge_map(np.zeros((20, 2, 5, 3), np.uint8))


def test_messages():
    made = HttpClient("m").messages(b"x", "read", "rules")
    assert made[0] == {"role": "system", "content": "rules"} and [p["type"] for p in made[1]["content"]] == ["text", "image_url"]
    assert len(HttpClient("m").messages(b"x", "", "")) == 1
