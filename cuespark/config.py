"""Settings of a run, with the bounds each of them has."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 10
    base_delay: float = 1.0
    max_delay: float = 30.0

    def __post_init__(self) -> None:
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")
        if self.base_delay < 0 or self.max_delay < 0:
            raise ValueError("delays can't be negative")

    def delay(self, failures: int) -> float:
        """Seconds to wait after so many failures."""
        return min(self.base_delay * 2 ** (failures - 1), self.max_delay)


@dataclass(frozen=True)
class EngineConfig:
    """Models, parallel calls and thresholds of the pipeline; skip holds START-END texts."""

    video: str = ""
    output: str | None = None
    workdir: str | None = None
    filter_model: str = "llava:7b"
    analyze_model: str = "qwen3-vl:4b"
    reconcile_model: str = "gemma3:1b-it-qat"
    filter_workers: int | None = None
    analyze_workers: int | None = None
    reconcile_workers: int | None = None
    edge_diff_threshold: float = 8.0
    similarity_threshold: float = 0.75
    gap_tolerance: float = 0.5
    inference_url: str = "http://localhost:11434"
    worker_config: str | None = None
    skip: tuple[str, ...] = ()
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    debug: bool = False

    def __post_init__(self) -> None:
        from cuespark.functions.times import parse_skip_range

        for name in ("filter_workers", "analyze_workers", "reconcile_workers"):
            n = getattr(self, name)
            if n is not None and n < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.edge_diff_threshold < 0 or self.gap_tolerance < 0:
            raise ValueError("thresholds can't be negative")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be from 0 to 1")
        for text in self.skip:
            parse_skip_range(text)

    @property
    def output_path(self) -> str:
        return self.output or str(Path(self.video).with_suffix(".ass"))

    @property
    def work_path(self) -> str:
        return self.workdir or str(Path(self.video).with_suffix("")) + "-work"


#: Parallel model calls by stage where neither an option nor the worker file says otherwise.
DEFAULT_WORKERS = {"filter": 4, "analyze": 1, "reconcile": 8}


def resolve_workers(explicit: int | None, from_file: int | None, stage: str) -> int:
    return explicit if explicit is not None else from_file if from_file is not None else DEFAULT_WORKERS[stage]
