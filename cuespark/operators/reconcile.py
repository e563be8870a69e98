"""Clusters of readings to one event each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions.text import numbered


def first_majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value; among equals the one that came first."""
    return (
        rows.groupBy(*keys, value)
        .agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
        .groupBy(*keys)
        .agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value), F.max("_n").alias("n"))
    )


def distinct_positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, positions): sorted."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("position")).alias("positions"))


_ITEMS = "array<struct<position:string,texts:array<string>,style:string,color:string>>"


def cluster_readings(clustered: DataFrame) -> DataFrame:
    """(video_id, cluster_id, seq, start_time, end_time, size, elements, asks): one row for each cluster.

    size: its events; elements: those of its first event; asks: for each position, ascending, the texts that it has been read as, in
    order, and the first majority of style and of colour. Two elements of one event at one position are rival readings. A cluster lasts
    from its first start to the last one's end.

    One pass: events, styles, colours and texts are counted together, combined before the shuffle, so of a large cluster only distinct
    values and the places of its texts come together.
    """
    by = ["video_id", "cluster_id"]
    null = lambda kind: F.lit(None).cast(kind)
    kind = "array<struct<kind:string,position:string,value:string,pos:int>>"
    own = F.flatten(
        F.transform(
            "elements",
            lambda e, k: F.array(*(F.struct(F.lit(c).alias("kind"), e["position"].alias("position"), e[c].alias("value"), k.alias("pos")) for c in ("style", "color", "text"))),
        )
    ).cast(kind)
    event = F.array(F.struct(F.lit("event").alias("kind"), null("string").alias("position"), null("string").alias("value"), F.lit(0).alias("pos"))).cast(kind)
    is_event = F.col("kind") == "event"
    at = F.struct("seq", "pos")
    counted = (
        clustered.withColumn("x", F.explode(F.concat(event, own)))
        .select(*by, "seq", "x.*", *(F.when(F.col("x.kind") == "event", F.col(c)).alias(c) for c in ("start_time", "end_time", "elements")))
        .groupBy(*by, "position", "kind", "value")
        .agg(
            F.count("*").alias("n"),
            F.min(at).alias("first"),
            F.collect_list(F.when(F.col("kind") == "text", at)).alias("places"),
            F.min_by("start_time", "seq").alias("start_time"),
            F.max_by("end_time", "seq").alias("end_time"),
            F.min_by("elements", "seq").alias("elements"),
        )
    )
    rank = F.struct("n", -F.col("first.seq"), -F.col("first.pos"))
    major = lambda c: F.max_by("value", F.when(F.col("kind") == c, rank)).alias(c)
    texts = F.transform(F.array_sort(F.flatten(F.collect_list("read"))), lambda x: x["t"]).alias("texts")
    placed = (
        counted.withColumn("read", F.transform("places", lambda p: F.struct(p.alias("at"), F.col("value").alias("t"))))
        .groupBy(*by, "position")
        .agg(major("style"), major("color"), texts, F.max(F.when(is_event, F.struct("n", "first", "start_time", "end_time", "elements"))).alias("event"))
    )
    item = F.struct("position", "texts", "style", "color")
    return (
        placed.groupBy(*by)
        .agg(F.max("event").alias("e"), F.array_sort(F.collect_list(F.when(F.col("event").isNull(), item))).cast(_ITEMS).alias("asks"))
        .select(*by, F.col("e.first.seq").alias("seq"), "e.start_time", "e.end_time", F.col("e.n").alias("size"), "e.elements", "asks")
    )


def readings(clustered: DataFrame) -> DataFrame:
    """(video_id, cluster_id, seq, start_time, end_time, position, texts, style, color): what each position of a cluster of two or more has been read as."""
    rows = cluster_readings(clustered).where("size > 1")
    return rows.select("video_id", "cluster_id", "seq", "start_time", "end_time", F.inline("asks"))


def prompt_body(texts: Column) -> Column:
    return numbered(texts)


def collapse(clustered: DataFrame, choose: Callable[[Column], Column]) -> DataFrame:
    """One event (video_id, seq, start_time, end_time, elements) for each cluster.

    A cluster of one event passes as it is. In others each position gives one element, positions ascending; equal readings
    need no choice, for the rest choose(texts) picks the text. The event lasts from the first start to the last one's end.
    """
    same = lambda x: F.size(F.array_distinct(x["texts"])) == 1
    text = lambda x: F.when(same(x), x["texts"][0]).otherwise(choose(x["texts"]))
    chosen = F.transform("asks", lambda x: F.struct(text(x).alias("text"), x["style"].alias("style"), x["color"].alias("color"), x["position"].alias("position")))
    elements = F.when(F.col("size") == 1, F.col("elements")).otherwise(chosen)
    return cluster_readings(clustered).select("video_id", "seq", "start_time", "end_time", elements.alias("elements"))


def majority_text(texts: Column) -> Column:
    """A chooser without a model: the first of the most frequent readings."""
    n = lambda t: F.size(F.filter(texts, lambda x: x == t))
    most = F.array_max(F.transform(texts, n))
    return F.filter(texts, lambda t: n(t) == most)[0]
