"""Runs of equal neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identical_runs(analyses: DataFrame) -> DataFrame:
    """Neighbours with equal elements as one event (video_id, seq, start_time, end_time, elements).

    A row without elements ends a run and gives no event. The end is that of the run's last row.
    """
    order = W.partitionBy("video_id").orderBy("seq")
    new = ~F.col("elements").eqNullSafe(F.lag("elements").over(order))
    return (
        analyses.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(order))
        .where(F.size("elements") > 0)
        .groupBy("video_id", "_run")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("start_time", "seq").alias("start_time"),
            F.max_by("end_time", "seq").alias("end_time"),
            F.min_by("elements", "seq").alias("elements"),
        )
        .drop("_run")
    )
