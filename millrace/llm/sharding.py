"""Sharding by size-tiered compaction, with DataFrame reads and writes only.

A store is a folder with immutable Parquet shards and a manifest in versions. Each arrival is appended as it comes,
as small shards. Shards that are still small fall into tiers by size (a tier spans a factor of ``fanout``); once a
tier has ``fanout`` shards, they are merged into files of the target size, without a shuffle. Both steps end by
writing the next version of the manifest beside the others and renaming it into place: the rename is atomic and
fails if another writer took the version, which then is tried anew on top of that writer's. A reader takes the
newest version and sees whole steps only; what a lost job leaves behind is in no manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import shared_folder

MANIFEST = "shard string, rows long, bytes long, since int"


class Store:
    """Shards under ``folder`` on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, fanout: int = 4, floor_bytes: int = 1 << 20) -> None:
        self.spark, self.folder, self.target, self.fanout, self.floor = spark, folder.rstrip("/"), target_bytes, fanout, floor_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._files.mkdirs(self._path(f"{self.folder}/manifest"))

    def version(self) -> int:
        """The newest committed version, 0 for a new store."""
        found = self._files.listStatus(self._path(f"{self.folder}/manifest"))
        names = [s.getPath().getName() for s in found]
        return max([0, *(int(n[2:]) for n in names if n.startswith("v-"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v-{version:08d}")

    def _written(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as new shards; their part of the manifest."""
        run = f"{self.folder}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(run)
        files = self.spark.read.schema(df.schema).parquet(run).select("_metadata.file_path", "_metadata.file_size")
        return files.groupBy(F.col("file_path").alias("shard")).agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))

    def _commit(self, added: DataFrame, merged: DataFrame | None = None) -> int:
        while True:
            version = self.version() + 1
            now = self.manifest(version - 1)
            if merged is not None:
                now = now.join(merged.select("shard"), "shard", "left_anti")
            new = now.unionByName(added.select("shard", "rows", "bytes", F.lit(version).alias("since")))
            aside = f"{self.folder}/manifest/aside-{uuid.uuid4().hex}"
            new.coalesce(1).write.parquet(aside)
            options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                self._context.rename(self._path(aside), self._path(f"{self.folder}/manifest/v-{version:08d}"), options)
                return version
            except Py4JJavaError as failure:
                self._files.delete(self._path(aside), True)
                if "AlreadyExists" not in failure.java_exception.getClass().getName():
                    raise

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival as small shards; the new version. An empty arrival makes a version without new shards."""
        return self._commit(self._written(arrival))

    def _tiers(self) -> DataFrame:
        """The shards that are still small and their tiers."""
        size = F.greatest("bytes", F.lit(self.floor)) / self.floor
        tier = F.floor(F.log(size) / F.log(F.lit(float(self.fanout))) + 1e-9)
        return self.manifest().where(F.col("bytes") * 2 < self.target).withColumn("tier", tier)

    def compact(self, expire: bool = True) -> int:
        """Merges tiers until none has ``fanout`` small shards; the version then.

        Only names and sizes of the small shards of one tier come to the driver. With ``expire``, shards that a
        merge replaced are deleted once its version is committed; readers of older versions need it off.
        """
        while True:
            small = self._tiers()
            due = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if due is None:
                return self.version()
            members = small.where(F.col("tier") == due.tier)
            names = [r.shard for r in members.select("shard").toLocalIterator()]
            schema = self.spark.read.parquet(names[0]).schema
            runs = self.spark.read.schema(schema).parquet(*names)
            merged = self.spark.createDataFrame([(n,) for n in names], "shard string")
            self._commit(self._written(runs.coalesce(-(-due.bytes // self.target))), merged)
            for name in names if expire else ():
                self._files.delete(self._path(name), False)

    def placed(self, columns: list[str], version: int | None = None) -> DataFrame:
        """All rows as a struct ``doc`` of ``columns``, with ``shard``, its ``shard_rows`` and ``shard_bytes``, and the ``version`` that is read."""
        version = self.version() if version is None else version
        shards = self.manifest(version)
        names = [r.shard for r in shards.select("shard").toLocalIterator()]
        if not names:
            raise ValueError(f"no shards in version {version}")
        rows = self.spark.read.parquet(*names)
        rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col("_metadata.file_path").alias("path"))
        sizes = shards.select(F.col("shard").alias("path"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(version).alias("version"))
        return rows.join(sizes, "path").withColumn("shard", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).drop("path")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows with all columns and those of ``placed``; a table with a column of such a name is for ``placed`` alone."""
        columns = self.columns(version)
        if clash := {"shard", "shard_rows", "shard_bytes", "version"} & set(columns):
            raise ValueError(f"columns {sorted(clash)} clash with the store's; use placed()")
        return self.placed(columns, version).select("doc.*", "shard", "shard_rows", "shard_bytes", "version")

    def columns(self, version: int | None = None) -> list[str]:
        """The columns of the stored table, from one of its shards."""
        first = self.manifest(version).select("shard").first()
        if first is None:
            raise ValueError(f"no shards in version {self.version() if version is None else version}")
        return self.spark.read.parquet(first.shard).columns


def arrivals(table: DataFrame, n: int, id_col: str = "doc_id") -> Iterator[DataFrame]:
    """Any table as ``n`` arrivals, by a hash of the id; what the table filters or projects stays so."""
    for k in range(n):
        yield table.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)) == k)


ARRIVALS = 6


def shard(table: DataFrame, id_col: str = "doc_id", target_bytes: int = 128 << 20, fanout: int = 4, floor_bytes: int = 1 << 20) -> DataFrame:
    """The rows of a table after ``ARRIVALS`` appends with compaction: ``id_col``, ``shard``, ``shard_rows``, ``shard_bytes``, ``version``.

    Every row, also a repeated one, lies in exactly one shard of the version. Rows with null ids, null or very long
    texts are stored like any other. An empty table gives an empty result. Shards hold all columns of the table
    under their own names, and ``placed`` keeps them apart from its own, so none can clash.
    """
    store = Store(table.sparkSession, f"{shared_folder(table.sparkSession)}/shards-{uuid.uuid4().hex}", target_bytes, fanout, floor_bytes)
    for arrival in arrivals(table, ARRIVALS, id_col):
        store.append(arrival)
        store.compact()
    if store.manifest().isEmpty():
        named = table.select(F.col(id_col), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).alias("version"))
        return named.where(F.lit(False))
    return store.placed([id_col]).select(F.col(f"doc.`{id_col}`").alias(id_col), "shard", "shard_rows", "shard_bytes", "version")
