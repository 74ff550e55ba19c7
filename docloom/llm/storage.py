"""Shared-folder helpers: every intermediate that must outlive an executor goes below ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share. A local session that names none gets one below /tmp; on a cluster
    that is an error, since executors do not see each other's local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/docloom-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, which cuts lineage and fixes its rows."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class Scratch:
    """Writes tables that only an operator's own steps read; ``drop`` removes them once its results are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []
        self.where: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.where[id(out)] = out, path
        return out

    def forget(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads. Spark deletes the shuffle files of finished steps when the driver's
        collector finds them unused, so it is asked to look."""
        for t in tables:
            _, path = self.where.pop(id(t))
            self.paths.remove(path)
            remove(self.spark, path)
        self.spark._jvm.System.gc()

    def bucketed(self, df: DataFrame, name: str, key: str, n: int) -> DataFrame:
        """A table in n buckets by ``key``: joins and aggregations by it need no shuffle of this side. Where ``df`` is dealt by
        ``key`` over a divisor of n partitions, as after an aggregation by it, each task writes buckets of its own."""
        path, table = new_folder(self.spark, name), f"docloom_{uuid.uuid4().hex}"
        self.paths.append(path)
        self.tables.append(table)
        df.write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.tables = []
        for p in self.paths:
            remove(self.spark, p)
        self.paths, self.where = [], {}
