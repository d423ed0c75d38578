"""Pieces that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 32 << 20) -> Iterator[None]:
    """``small_batches`` for what runs inside the block; the session has its own settings again afterwards."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local master gets a folder of its own and any other an error: what an executor wrote to its
    own disk would be lost with it.
    """
    sc = spark.sparkContext
    if shared := sc.getConf().get("spark.checkpoint.dir"):
        return shared
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that nothing refers to any more.

    They go when the driver collects its garbage, which a driver with room to spare may not do before the disks of
    the executors are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def content_key(text: Column) -> Column:
    """Second half of a row's identity: rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``doc``, so that no helper column can clash with them."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node at most and none that hangs has nodes below it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges`` (a, b): rows (node, root), root the smallest node; roots have no row.

    Large-star and small-star rounds: each node hangs its larger neighbours under its smallest one until only
    stars are left. Every round is two aggregations and two joins on the edge list, checkpointed, so lost executors
    cost one round at most. The smallest neighbours are dealt once more before each join, by which Spark can split
    the join where a node has very many neighbours.
    """
    parts = partitions(edges.sparkSession)

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m")).repartition(parts, "u", "m")

    current = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = smallest(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
