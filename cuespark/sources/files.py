"""Manifests and lines of JSON: arrays, objects, one record a line, checkpoints that grow."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Texts read by a task are sent on in batches of this many bytes.
READ_BYTES = 8 << 20
# Fixed value: what Spark's writers call the folder of rows without a value.
_NULL = "__HIVE_DEFAULT_PARTITION__"


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_identity(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of last change) of a file; zeros if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(p):
        return 0, 0
    status = system.getFileStatus(p)
    return status.getLen(), status.getModificationTime()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small text as one file, in the file system that the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session may be without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/checkpoints"
    return where.rstrip("/")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array or object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array, a row a line, in order. The sort runs on all executors; one task streams the rows to the one file.

    Null fields are left out, as to_json does; an empty table is an empty array.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        held: list[str] = []
        for batch in batches:
            held += batch["value"].tolist()
            yield pd.DataFrame({"value": [f"  {row}," for row in held[:-1]]}, dtype=object)
            held = held[-1:]
        yield pd.DataFrame({"value": [*(f"  {row}" for row in held), "]"]})

    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value"))
    if df.isEmpty():  # a plan without rows has no task that could write the brackets
        rows = df.sparkSession.range(1).select(F.lit("[]").alias("value"))
        rows.write.mode("overwrite").text(path)
        return
    rows.coalesce(1).mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_json_object(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON object."""
    if len(df.take(2)) != 1:
        raise ValueError("an object needs exactly one row")
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines, stripped, without blank ones; no file is no lines."""
    if not exists(spark, path):
        return spark.range(0).select(F.lit("").alias("value"))
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value")).where("value <> ''")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """A JSON record a line."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_cluster_lines(clustered: DataFrame, path: str) -> None:
    """A line for each cluster: the array of its events in order."""
    event = F.struct("start_time", "end_time", "elements")
    lines = clustered.groupBy("video_id", "cluster_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", event.alias("e")))), lambda x: x["e"])).alias("value")
    )
    lines.select("value").write.mode("overwrite").text(path)


def _local(spark: SparkSession, path: str) -> str | None:
    """path as the operating system has it; None if it is in another file system than the local one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(p).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _write_texts(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A file for each run of rows (name, value) of one name. It gets its name when it is whole, so a task can be tried again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hidden = f".{uuid.uuid4().hex}"
        rows = ((name.as_py(), value) for batch in batches for name, value in zip(*batch.columns, strict=True))
        for name, own in groupby(rows, lambda row: row[0]):
            with contextlib.suppress(FileExistsError):
                os.mkdir(f"{folder}/{name}")
            with open(f"{folder}/{name}/{hidden}", "wb") as file:
                for _, value in own:
                    file.write((value.as_py() or b"") + b"\n")
            os.replace(f"{folder}/{name}/{hidden}", f"{folder}/{name}/document.ass")
        yield from ()

    return work


def _read_texts(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(name, value): the text of each file of the folders that rows name, sent on in batches of READ_BYTES."""

    def batch(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in held], t) for i, t in enumerate((pa.string(), pa.binary()))], ["name", "value"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name in (name for b in batches for name in b.column(0).to_pylist()):
            with os.scandir(f"{folder}/{name}") as files:
                paths = sorted(x.path for x in files if not x.name.startswith(("_", ".")))
            for path in paths:
                with open(path, "rb") as file:
                    held.append((name, file.read()))
                size += len(held[-1][1])
                if size >= READ_BYTES:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return work


def write_documents(documents: DataFrame, path: str) -> None:
    """(video_id, content) as a text file for each video, in a folder of its own, video_id=...; every file ends with one line break.

    On a local file system the tasks write the files themselves: Spark's writer starts processes for every file there, to set
    its permissions. The folder appears under its name when all are written.
    """
    spark = documents.sparkSession
    rows = documents.select("video_id", F.regexp_replace("content", r"\n\z", "").alias("value"))
    folder = _local(spark, path)
    if folder is None or not isinstance(documents.schema["video_id"].dataType, IntegralType):
        rows.repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(path)
        return
    name = F.concat(F.lit("video_id="), F.coalesce(F.col("video_id").cast("string"), F.lit(_NULL)))
    made = f"{folder}-{uuid.uuid4().hex}"
    os.makedirs(made)
    try:
        named = rows.select(name.alias("name"), F.col("value").cast("binary").alias("value")).repartition("name").sortWithinPartitions("name")
        named.mapInArrow(_write_texts(made), "name string").write.format("noop").mode("overwrite").save()
        open(f"{made}/_SUCCESS", "w").close()
        delete(spark, path)
        os.rename(made, folder)
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, content) of the files that write_documents wrote. On a local file system the driver lists only the videos' folders."""
    folder = _local(spark, path)
    if folder is None:
        rows = spark.read.text(path, wholetext=True).select("video_id", "value")
    else:
        with os.scandir(folder) as entries:
            names = sorted(x.name for x in entries if x.name.startswith("video_id="))
        found = spark.createDataFrame(names, "string").mapInArrow(_read_texts(folder), "name string, value binary")
        number = F.substring_index("name", "=", -1)
        rows = found.select(F.when(number != _NULL, number).alias("video_id"), F.col("value").cast("string").alias("value"))
    return rows.select(F.col("video_id").cast("bigint").alias("video_id"), F.col("value").alias("content"))
