"""Calls that may fail: which errors are worth another try, and how long to wait."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import TypeVar

from cuespark.config import RetryPolicy

T = TypeVar("T")


class ServiceError(Exception):
    """An error that a model service has answered with, by its HTTP status; 0 if it could not be reached."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status


class NonRetryable(Exception):
    """Another try can't help; the cause says why."""


class RetryExhausted(Exception):
    """All tries have failed; the cause is the last error."""


def retryable(error: Exception) -> bool | None:
    """True or False, or None for errors that are nobody's to handle here."""
    if isinstance(error, ServiceError):
        if error.status in (400, 401, 403, 404):
            return False
        return True if error.status in (0, 429) or error.status >= 500 else None
    if isinstance(error, OSError):
        return False
    if isinstance(error, ValueError | RuntimeError):
        return True
    return None


def with_retry(
    call: Callable[[], T], policy: RetryPolicy, log: logging.Logger | None = None, sleep: Callable[[float], None] = time.sleep
) -> tuple[T, int]:
    """(result, tries). Waits between tries, not after the last; errors of other kinds propagate."""
    for k in range(1, policy.max_attempts + 1):
        try:
            return call(), k
        except Exception as error:
            again = retryable(error)
            if again is None:
                raise
            if not again:
                raise NonRetryable(str(error)) from error
            if k == policy.max_attempts:
                raise RetryExhausted(f"failed {k} times: {error}") from error
            if log:
                log.warning("try %d of %d failed: %s", k, policy.max_attempts, error)
            sleep(policy.delay(k))
    raise AssertionError("unreachable")
