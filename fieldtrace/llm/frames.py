"""Frames shared by the operators: intermediate tables, Arrow batches, linked groups."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Texts in an Arrow batch.
TEXT_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares, removed when the driver ends.

    ``spark.checkpoint.dir`` names it; where that is unset, as in tests, the
    warehouse is taken, which a cluster shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return fs.makeQualified(at).toString()


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again.

    Cuts the lineage, survives lost executors, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{folder or work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches() -> None:
    """Send texts to Python in batches of ``TEXT_ROWS``.

    Texts are long, and a batch lies in the executor's memory several times.  A
    session that sets a size of its own keeps it.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def row_slices(offsets: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each, or a single row beyond that."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column (null: empty) and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    return memoryview(data if data is not None else b""), offsets


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``(node, label)`` with the smallest node each node of an edge can reach.

    ``edges`` has columns ``a`` and ``b``, null free.  Alternates large-star and
    small-star steps; each is a partly aggregated minimum and a join, so a node
    with very many neighbours never meets them in one task by design of the step.
    """
    folder = folder or work_folder(edges.sparkSession)

    def pairs(df):
        return (df.where("a != b").select(F.greatest("a", "b").alias("a"),
                                          F.least("a", "b").alias("b")).distinct())

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = settle(pairs(edges), folder)
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = pairs(both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")))
        large = settle(large, folder)
        # Every edge now runs from a larger to a smaller node.
        hub = large.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs(large.join(hub, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .union(hub.select("a", F.col("m").alias("b"))))
        now, before = settle(small, folder), seen
        seen = mark(now)
        if seen == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
