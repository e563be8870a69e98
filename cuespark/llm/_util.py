"""Helpers shared by the training-data operators: shared storage, reading, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``. Only a local session may be without; it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if where and context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    if not where and context.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return (where or context.getCheckpointDir().get()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut in the lineage that outlives executors.

    The shuffle files of the write go when it ends. Tables lie in a folder of the application, which goes when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session can be gone
        context = spark.sparkContext
        conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(work, schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece holds more than most_bytes of column, unless it is one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for k in range(n):
            if k > start and total + sizes[k] > most_bytes:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += int(sizes[k])
        yield batch.slice(start, n - start)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) as (node, label): label is the smallest node reachable.

    Alternates large-star and small-star contraction; each step is a table in the shared
    folder. Self loops and repeated edges are allowed; null ends are dropped.
    Minima are combined map-side and stored, so that each join back is one of two tables with nothing between
    shuffle and join: AQE splits the rows of a node with very many links over many tasks.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _digest(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # Large star: every neighbour above a node is linked to the node's smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = stored(
            both.where("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large"
        )
        # Small star: every neighbour below a node, and the node, are linked to the smallest of them.
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.hint("merge").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        dropped(now, least, large, low)
        now, last = after, before
        before = _digest(now)
        if before == last:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """The number of edges and two 64-bit hash sums, which tell whether a round has changed them."""
    one, two = (F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in (("a", "b"), (F.lit(1), "b", "a")))
    return tuple(edges.agg(F.count("*"), one, two).first())
