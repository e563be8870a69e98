"""Time ranges: merging them, dropping frames inside them, counting what they drop."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to so many ranges are put into the filter itself, where they reach the scan.
MOST_LITERAL = 64
#: Up to so many ranges, of two numbers each, are broadcast.
MOST_BROADCAST = 100_000


def merge_ranges(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranges (range_start, range_end) that overlap or touch as one, within the columns by.

    Without by all ranges are one set, sorted in one task: they are options of a run, few.
    """
    order = W.partitionBy(*by).orderBy("range_start", "range_end")
    before = F.max("range_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("range_start") > before), 1).otherwise(0)
    return (
        ranges.withColumn("_new", new)
        .withColumn("_group", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*by, "_group")
        .agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
        .drop("_group")
    )


def merged(ranges: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """The same for the few ranges of an option."""
    out: list[tuple[float, float]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _inside(time: str) -> Column:
    return (F.col(time) >= F.col("range_start")) & (F.col(time) <= F.col("range_end"))


def _hits(frames: DataFrame, ranges: DataFrame, time: str, how: str) -> DataFrame:
    """frames joined to the ranges they are in, inner or left_anti.

    Up to MOST_BROADCAST ranges are broadcast, never the frames. More are cut into bins of their mean length, two a
    range on average, and join on the bin.
    """
    n, width, least = ranges.agg(F.count("*"), F.avg(F.col("range_end") - F.col("range_start")), F.min("range_start")).first()
    if n <= MOST_BROADCAST:
        return frames.join(F.broadcast(ranges), _inside(time), how)
    width = width or 1.0
    place = lambda c: F.floor((c - least) / width).cast("bigint")
    cut = ranges.withColumn("_bin", F.explode(F.sequence(place(F.col("range_start")), place(F.col("range_end")))))
    on = (F.col("_own") == F.col("_bin")) & _inside(time)
    return frames.withColumn("_own", place(F.col(time))).join(cut, on, how).drop("_own", "_bin")


def drop_in_ranges(frames: DataFrame, ranges: list[tuple[float, float]] | DataFrame, time: str = "timestamp") -> DataFrame:
    """Frames outside all ranges; both ends belong to a range. Frames without a time stay; ranges with a null end hold none.

    A short list becomes a filter that the scan gets; a longer list or a DataFrame is an anti join.
    """
    if not isinstance(ranges, DataFrame):
        if len(ranges) > MOST_LITERAL:
            ranges = frames.sparkSession.createDataFrame(merged(ranges), "range_start double, range_end double")
        else:
            t = F.col(time)
            hit = reduce(lambda a, b: a | b, (t.between(x, y) for x, y in ranges)) if ranges else None
            return frames if hit is None else frames.where(~F.coalesce(hit, F.lit(False)))
    own = ranges.select("range_start", "range_end").where("range_start <= range_end")
    return _hits(frames, own, time, "left_anti")


def range_counts(frames: DataFrame, ranges: DataFrame, time: str = "timestamp") -> DataFrame:
    """(range_start, range_end, n): frames in each range, 0 included; a frame counts in every range it is in.

    Repeated ranges are one. Frames are counted before they meet the list of ranges, so they are neither broadcast nor sorted.
    """
    own = ranges.select("range_start", "range_end").distinct()
    counts = _hits(frames.select(time), own.where("range_start <= range_end"), time, "inner").groupBy(
        F.col("range_start").alias("_start"), F.col("range_end").alias("_end")
    ).agg(F.count("*").alias("n"))
    same = F.col("range_start").eqNullSafe(F.col("_start")) & F.col("range_end").eqNullSafe(F.col("_end"))
    return own.join(counts, same, "left").select("range_start", "range_end", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
