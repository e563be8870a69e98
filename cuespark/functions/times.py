"""Times: text to seconds and back, for options and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: str) -> float:
    """Seconds of SS, MM:SS or HH:MM:SS; parts are not range-checked, a negative total is an error."""
    parts = text.strip().split(":")
    if len(parts) > 3:
        raise ValueError(f"not a time: {text!r}")
    try:
        whole, seconds = [int(x) for x in parts[:-1]], float(parts[-1])
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    total = seconds
    for power, value in enumerate(reversed(whole), start=1):
        total += value * 60**power
    if total < 0:
        raise ValueError(f"a time can't be negative: {text!r}")
    return total


def parse_skip_range(text: str) -> tuple[float, float]:
    """START-END, with START before END."""
    first, dash, last = text.partition("-")
    if not dash:
        raise ValueError(f"not START-END: {text!r}")
    start, end = parse_time(first), parse_time(last)
    if start >= end:
        raise ValueError(f"the range must start before it ends: {text!r}")
    return start, end


def format_time(seconds: float) -> str:
    minutes, s = divmod(int(seconds), 60)
    hours, m = divmod(minutes, 60)
    return f"{hours}:{m:02d}:{s:02d}" if hours else f"{m}:{s:02d}"


def time_seconds(text: Column) -> Column:
    """Column form of parse_time; null where it is not a time."""
    parts = F.split(F.trim(text), ":", -1)
    n = F.size(parts)
    seconds = F.element_at(parts, -1).try_cast("double")
    before = lambda k: F.when(n > k, F.try_element_at(parts, F.greatest(n - k, F.lit(1))).try_cast("bigint")).otherwise(0)
    total = before(2) * 3600 + before(1) * 60 + seconds
    return F.when((n <= 3) & (total >= 0), total)


def time_text(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; fractions are cut."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def centiseconds(seconds: Column) -> Column:
    """Hundredths, halves to the even one."""
    return F.rint(seconds * 100).cast("bigint")


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc."""
    cs = centiseconds(seconds)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def fps(rate: Column) -> Column:
    """Frames a second of a text like 24000/1001; null where it is none or not above 0."""
    parts = F.split(rate, "/", -1)
    value = F.try_divide(
        F.element_at(parts, 1).try_cast("double"), F.when(F.size(parts) == 2, F.element_at(parts, -1).try_cast("double")).when(F.size(parts) == 1, F.lit(1.0))
    )
    return F.when(value > 0, value)
