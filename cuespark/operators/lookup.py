"""Joins in which every row must find its partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required_lookup(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with found's columns by equal keys; a row that finds none makes the query fail and names its key. Null keys find none.

    The check is part of the plan, so there is no second pass; an aggregate above keeps it as long as it reads any of found's columns.
    """
    rest = [c for c in found.columns if c not in keys]
    joined = rows.join(found.select(*keys, F.struct(*rest, F.lit(True).alias("_hit")).alias("_found")), keys, "left")
    key = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    checked = F.when(F.col("_found._hit"), F.col("_found")).otherwise(F.raise_error(F.concat(F.lit("no entry for "), key)))
    return joined.withColumn("_found", checked).select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in rest))
