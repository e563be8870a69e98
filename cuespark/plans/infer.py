"""Stages that call a model for each row: bounded parallel calls, retry inside the call, errors as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.config import RetryPolicy
from cuespark.functions.retry import NonRetryable, RetryExhausted, with_retry
from cuespark.functions.text import parse_elements, parse_has_text
from cuespark.schema import ELEMENTS
from cuespark.sources.models import ANALYZE_PROMPT, FILTER_PROMPT, RECONCILE_PROMPT, TextClient, VisionClient


def call_rows(
    rows: DataFrame,
    column: str,
    call: Callable[[Any], Any],
    kind: str,
    workers: int,
    policy: RetryPolicy,
    pool: int = 1,
    sleep: Callable = time.sleep,
    when: str | None = None,
    otherwise: Any = None,
) -> DataFrame:
    """rows with result, error and attempts: call(value of column) for each row, with retry.

    when: a boolean column; where it isn't true there is no call and the result is otherwise, after 0 attempts.

    At most workers calls run at a time: workers / pool tasks of pool threads. Results are JSON between
    Python and Spark. Calls are not repeatable, so write the result before reading it twice.
    """
    names = rows.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(value: Any, wanted: bool) -> tuple[str | None, str | None, int]:
            if not wanted:
                return json.dumps({"v": otherwise}), None, 0
            try:
                result, tries = with_retry(lambda: call(value), policy, sleep=sleep)
                return json.dumps(result), None, tries
            except RetryExhausted as error:
                return None, str(error), policy.max_attempts
            except NonRetryable as error:
                return None, str(error), 1

        with ThreadPoolExecutor(pool) as threads:
            for batch in batches:
                wanted = [x is True or x == 1 for x in batch[when]] if when else [True] * len(batch)
                done = list(threads.map(one, batch[column], wanted))
                yield batch.assign(_json=[x[0] for x in done], error=[x[1] for x in done], attempts=[x[2] for x in done])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    tasks = max(1, workers // max(1, pool))
    out = rows.repartition(tasks).mapInPandas(work, f"{schema}, _json string, error string, attempts int")
    return out.select(*names, F.from_json("_json", f"struct<v:{kind}>")["v"].alias("result"), "error", "attempts")


def prefilter(groups: DataFrame, client: VisionClient, workers: int = 4, policy: RetryPolicy = RetryPolicy(), prompt: str = FILTER_PROMPT, **options: Any) -> DataFrame:
    """groups with has_text, error, attempts."""
    out = call_rows(groups, "frame", lambda frame: {"v": parse_has_text(client.analyze(frame, prompt, json_mode=True))}, "boolean", workers, policy, **options)
    return out.withColumnRenamed("result", "has_text")


def analyze(groups: DataFrame, client: VisionClient, workers: int = 1, policy: RetryPolicy = RetryPolicy(), prompt: str = ANALYZE_PROMPT, **options: Any) -> DataFrame:
    """groups (with has_text) with elements, error, attempts; rows without text get no elements and no call.

    A row that the filter has failed for keeps that error, without a call. One pass: groups is read once, so calls that it stands for are made once.
    """
    failed = F.col("error") if "error" in groups.columns else F.lit(None).cast("string")
    rows = groups.withColumn("_failed", failed).drop("error", "attempts")
    read = lambda frame: {"v": parse_elements(client.analyze(frame, system=prompt))}
    done = call_rows(rows, "frame", read, ELEMENTS, workers, policy, when="has_text", otherwise=[], **options)
    elements = F.when(F.col("_failed").isNull(), F.col("result"))
    return done.withColumns({"elements": elements, "error": F.coalesce("_failed", "error")}).drop("_failed", "result")


def reconcile(clustered: DataFrame, client: TextClient, workers: int = 8, policy: RetryPolicy = RetryPolicy(), system: str = RECONCILE_PROMPT, **options: Any) -> DataFrame:
    """(video_id, cluster_id, seq, start_time, end_time, elements, error, attempts): one event for each cluster.

    A cluster is tried again as a whole. One of a single event passes without a call, as does a position whose readings are equal.
    """
    from cuespark.operators.reconcile import cluster_readings

    def settle(raw: str) -> dict[str, Any]:
        out = []
        for p in json.loads(raw):
            texts = p["texts"]
            text = texts[0] if len(set(texts)) == 1 else client.chat("\n".join(f"{k}. {t}" for k, t in enumerate(texts, 1)), system).strip()
            out.append({"text": text, "style": p["style"], "color": p["color"], "position": p["position"]})
        return {"v": out}

    rows = cluster_readings(clustered).withColumns({"_ask": F.to_json("asks"), "_many": F.col("size") > 1}).drop("asks", "size")
    done = call_rows(rows, "_ask", settle, ELEMENTS, workers, policy, when="_many", otherwise=None, **options)
    elements = F.when(F.col("_many"), F.col("result")).otherwise(F.col("elements"))
    return done.withColumn("elements", elements).drop("_ask", "_many", "result")
