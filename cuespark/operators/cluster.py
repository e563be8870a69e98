"""Events to clusters of readings of one caption: near in time, and like the event before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.functions.text import positions, ratio, ratio_bound, text_at
from cuespark.schema import POSITIONS


def similar_clusters(events: DataFrame, threshold: float = 0.75, gap: float = 0.5) -> DataFrame:
    """events with cluster_id, from 1 in each video; events without elements are left out, and don't part others. A null time begins a cluster.

    An event joins the cluster of the one before if it starts at most gap after that one's end,
    both have the same positions, and at each position the texts' ratio is threshold or more. The
    ratio needs Python; it runs only where time, positions and lengths allow it and texts differ.
    """
    order = W.partitionBy("video_id").orderBy("seq")
    pairs = (
        events.where(F.size("elements") > 0)
        .withColumn("_p", F.lag(F.struct("end_time", "elements")).over(order))
        .withColumn(
            "_near",
            F.col("_p").isNotNull()
            & F.coalesce(F.col("start_time") - F.col("_p.end_time") <= gap, F.lit(False))
            & (positions(F.col("elements")) == positions(F.col("_p.elements"))),
        )
    )
    texts = [(text_at(F.col("_p.elements"), p), text_at(F.col("elements"), p)) for p in POSITIONS]
    same, may = F.lit(True), F.lit(True)
    for a, b in texts:
        same &= a == b
        may &= (a == b) | (ratio_bound(a, b) >= threshold)
    pairs = pairs.withColumn("_same", F.col("_near") & same).withColumn("_ask", F.col("_near") & ~same & may)
    asked = pairs.where("_ask").select("video_id", "seq", *(x.alias(f"_{s}{k}") for k, ab in enumerate(texts) for s, x in zip("ab", ab, strict=True)))
    for k in range(len(texts)):
        asked = asked.withColumn(f"_r{k}", ratio(F.col(f"_a{k}"), F.col(f"_b{k}")))
    like = asked.where(" and ".join(f"_r{k} >= {threshold!r}" for k in range(len(texts)))).select("video_id", "seq", F.lit(True).alias("_like"))
    joined = pairs.drop("_p").join(like, ["video_id", "seq"], "left")
    new = (~(F.col("_same") | F.coalesce("_like", F.lit(False)))).cast("long")
    return joined.withColumn("cluster_id", F.sum(new).over(order)).drop("_near", "_same", "_ask", "_like")
