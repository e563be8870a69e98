"""Resuming: rows that are done by id, stages that are done by the parameters they ran with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.sources.files import delete, exists


class StageFailed(RuntimeError):
    def __init__(self, stage: str, failed: int) -> None:
        super().__init__(f"{stage}: {failed} rows failed; what succeeded is kept, run again for the rest")
        self.stage, self.failed = stage, failed


def last_written(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """One row for each id: the one written last."""
    rest = [c for c in lines.columns if c != "id"]
    return lines.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", "_r.*")


def split_done(elements: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with what is stored for them, elements that remain), both with their seq; stored ids that no element has are ignored."""
    return elements.join(last_written(lines), "id"), elements.join(lines.select("id"), "id", "left_anti")


def failures(results: DataFrame) -> int:
    return results.where(F.col("error").isNotNull()).count()


def fingerprint(**parameters: object) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def content(df: DataFrame) -> str:
    """Names the rows of a table, whatever their order: their number and two sums of hashes."""
    own = [F.col(f"`{c}`") for c in sorted(df.columns)]
    whole = F.xxhash64(*own).cast("decimal(38,0)")
    other = F.xxhash64(F.lit("."), *reversed(own)).cast("decimal(38,0)")
    return fingerprint(columns=sorted(df.dtypes), rows=[str(x) for x in df.agg(F.count("*"), F.sum(whole), F.sum(other)).first()])


def callable_name(f: Callable) -> str:
    return f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', type(f).__qualname__)}"


class Store:
    """Tables of a run below one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def whole(self, stage: str, make: Callable[[], DataFrame], **parameters: object) -> DataFrame:
        """The stage's table; made if it isn't there for these parameters, which must name its input as well."""
        path = f"{self.folder}/{stage}-{fingerprint(**parameters)}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def rows(
        self, stage: str, elements: DataFrame, call: Callable[[DataFrame], DataFrame], batch: int = 1000, most_rounds: int = 16, **parameters: object
    ) -> DataFrame:
        """call's results for all elements (id, seq, ...), those stored before included.

        What remains is dealt once to rounds of `batch` rows or more, most_rounds at most, so the number of jobs doesn't grow
        with the rows, and each round reads its own rows alone. A round is appended as it ends, its failures left out: what
        a crash can lose is a round. After the last, failures raise StageFailed. Rows that repeat an id are all called.
        """
        path = f"{self.folder}/{stage}-{fingerprint(**parameters)}"
        todo, failed = elements, 0
        known = exists(self.spark, path)
        if known:
            todo = elements.join(self.spark.read.parquet(path).select("id").distinct(), "id", "left_anti")
        dealt = f"{path}-todo"
        todo.withColumn("_round", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(most_rounds)), F.lit(0)).cast("int")).write.mode("overwrite").partitionBy("_round").parquet(dealt)
        kind = elements.schema
        n = self.spark.read.schema(kind).parquet(dealt).count()
        rounds = [str(k) for k in range(most_rounds) if exists(self.spark, f"{dealt}/_round={k}")]
        per = max(1, -(-len(rounds) * batch // max(1, n)))
        for k in range(0, len(rounds), per) if n else [] if known else [0]:
            folders = [f"{dealt}/_round={x}" for x in rounds[k : k + per]] or [dealt]
            trial = f"{path}-batch"
            call(self.spark.read.schema(kind).parquet(*folders)).write.mode("overwrite").parquet(trial)  # a model is asked once, whatever is read from its answers
            done = self.spark.read.parquet(trial)
            failed += failures(done)
            done.where("error is null").write.mode("append").parquet(path)
        for name in (dealt, f"{path}-batch"):
            delete(self.spark, name)
        if failed:
            raise StageFailed(stage, failed)
        return self.spark.read.parquet(path).join(elements.select("id"), "id", "left_semi")
