"""Limits of model back ends."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def worker_limit(config: Any, model: str) -> int:
    """Sum of max_parallel_requests over the entries whose model_name is model, of a parsed worker file."""
    if not isinstance(config, dict) or not isinstance(config.get("model_list"), list):
        raise ValueError("the worker file needs a model_list")
    own = [x for x in config["model_list"] if isinstance(x, dict) and x.get("model_name") == model]
    if not own:
        raise ValueError(f"no entry for {model}")
    total = 0
    for entry in own:
        n = (entry.get("litellm_params") or {}).get("max_parallel_requests")
        if not isinstance(n, int) or n < 1:
            raise ValueError(f"max_parallel_requests of {model} must be 1 or more")
        total += n
    return total


def read_worker_limit(path: str, model: str) -> int:
    import yaml

    with open(path) as file:
        return worker_limit(yaml.safe_load(file), model)


def worker_limits(backends: DataFrame) -> DataFrame:
    """(model_name, workers) of (model_name, max_parallel_requests)."""
    return backends.groupBy("model_name").agg(F.sum("max_parallel_requests").cast("bigint").alias("workers"))
