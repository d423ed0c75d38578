"""Sinks: fixed columns, write-once outputs, appended logs and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns in this order, nulls as empty; other columns are left out."""
    df.select(*columns).write.option("header", True).option("nullValue", "").csv(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free hash of all values, computed where the rows lie."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def write_once(df: DataFrame, path: str) -> bool:
    """Writes Parquet to ``path``. Where something is there it must be the same rows, else this is an error."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        if fingerprint(spark.read.parquet(path).select(*df.columns)) != fingerprint(df):
            raise ValueError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
