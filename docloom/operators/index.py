"""Index lifecycle: catalogue, incremental sync, deletion, vector reuse, fingerprint, integrity, versioned storage.

Tables are Parquet in a versioned folder; a commit writes a new folder and then replaces a one-file pointer, so readers see
the old or the new index and nothing in between.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docloom.functions import text as T

BUCKET = "index_bucket"


def rollup(chunks: DataFrame, name: str = "filename") -> DataFrame:
    """Per document: chunks, characters, distinct nodes, sorted node types."""
    return chunks.groupBy(F.lower(name).alias("document")).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum("content_chars").alias("content_chars"), F.countDistinct("node_id").alias("node_count"), F.array_sort(F.collect_set("node_type")).alias("node_types")
    )


def sync_actions(current: DataFrame, incoming: DataFrame, remove_missing: bool = True) -> DataFrame:
    """Added, updated, skipped or removed by path (case folded) and content hash: path, action."""
    a = current.select(T.fold("source_path").alias("path"), F.col("sha256").alias("old"))
    b = incoming.select(T.fold("source_path").alias("path"), F.col("sha256").alias("new"))
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed" if remove_missing else "kept").when(F.col("old") == F.col("new"), "skipped").otherwise("updated")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def apply_sync(current: DataFrame, incoming: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows of unchanged documents from the index, of added and updated ones from the source."""
    stay = actions.where(F.col("action").isin("skipped", "kept")).select("path")
    new = actions.where(F.col("action").isin("added", "updated")).select("path")
    key = lambda df: df.withColumn("path", T.fold("source_path"))
    return key(current).join(stay, "path", "left_semi").drop("path").unionByName(key(incoming).join(new, "path", "left_semi").drop("path"), allowMissingColumns=True)


def append_new(current: DataFrame, incoming: DataFrame, name: str = "filename") -> DataFrame:
    """What may be appended: documents whose name the index does not have."""
    have = current.select(F.lower(name).alias("have")).distinct()
    return incoming.join(have, F.lower(name) == F.col("have"), "left_anti")


def delete_documents(table: DataFrame, names: DataFrame, name: str = "filename") -> DataFrame:
    return table.join(names.select(F.lower(name).alias("gone")).distinct(), F.lower(name) == F.col("gone"), "left_anti")


def reuse_vectors(old: DataFrame, new: DataFrame, key: str = "chunk_key", order: str = "pos") -> DataFrame:
    """``new`` with vec_id of the old row that has the same key, first come first served; null where one must be made."""
    w = Window.partitionBy(key).orderBy(order)
    o = old.withColumn("nth", F.row_number().over(w)).select(key, "nth", "vec_id")
    return new.withColumn("nth", F.row_number().over(w)).join(o, [key, "nth"], "left").drop("nth")


def fingerprint(docs: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """Hash of per-document hashes: the first level is distributed, the second sorts one digest a document."""
    each = docs.select(F.col(key).alias("k"), F.sha2(F.concat_ws("\x1f", *parts), 256).alias("h"))
    shard = each.withColumn("shard", F.floor(F.col("k") / 1000))
    level = shard.groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return level.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def integrity(nodes: DataFrame, parents: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of dangling references: code, key."""

    def missing(left: DataFrame, right: DataFrame, on: str, other: str, code: str, key: str) -> DataFrame:
        r = right.select(F.col(other).alias("ref")).distinct()
        return left.where(F.col(on).isNotNull()).join(r, F.col(on) == F.col("ref"), "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))

    out = missing(chunks, nodes, "node_id", "node_id", "chunk_node_missing", "id")
    out = out.unionByName(missing(chunks, documents, "document_id", "document_id", "chunk_document_missing", "id"))
    out = out.unionByName(missing(chunks, parents, "parent_id", "parent_id", "chunk_parent_missing", "id"))
    return out.unionByName(missing(parents, nodes, "content_node_id", "node_id", "parent_node_missing", "parent_id"))


def bucket_of(key: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class VersionedIndex:
    """Named tables below ``root``; ``commit`` and ``replace`` are atomic over all of them.

    ``commit`` writes whole tables. ``replace`` keeps rows in buckets of a key and writes the named buckets only; the new
    version's manifest says in which version's folder each bucket of each table lies.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def manifest(self, version: str | None = None) -> dict | None:
        """Buckets and schemas of a version (the current one); none for a version of whole tables."""
        version = version or self.version()
        path = f"{self.root}/{version}/MANIFEST"
        if version is None or not self._fs.exists(self._path(path)):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"{self.root} has no committed index")
        held = self.manifest(version)
        if held is None:
            return self.spark.read.parquet(f"{self.root}/{version}/{table}")
        schema, where = StructType.fromJson(held["tables"][table]["schema"]), held["tables"][table]["buckets"]
        paths = [f"{self.root}/{v}/{table}/{BUCKET}={b}" for b, v in where.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, tables: dict[str, DataFrame], key: str, n: int, buckets: list[int] | None = None) -> str:
        """Writes ``tables``, which hold all rows of ``buckets`` (of all ``n`` where none are named); other buckets stay as they are."""
        version = f"v-{uuid.uuid4().hex}"
        old = None if buckets is None else self.manifest()
        if buckets is not None and (old is None or old["n"] != n):
            raise ValueError("there is no index of as many buckets to replace some of")
        new = {"n": n, "tables": {}}
        for name, df in tables.items():
            folder = f"{self.root}/{version}/{name}"
            df.withColumn(BUCKET, bucket_of(key, n)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
            held = {b: v for b, v in old["tables"][name]["buckets"].items() if int(b) not in buckets} if old else {}
            names = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]
            held |= {d.split("=")[1]: version for d in names if d.startswith(f"{BUCKET}=")}
            new["tables"][name] = {"schema": df.schema.jsonValue(), "buckets": held}
        self._put(f"{self.root}/{version}/MANIFEST", json.dumps(new))
        self._publish(version)
        return version

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            writer = df.write
            if column := (partition_by or {}).get(name):
                writer = df.repartition(column).write.partitionBy(column)
            writer.parquet(f"{self.root}/{version}/{name}")
        self._publish(version)
        return version

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _publish(self, version: str) -> None:
        """One step: readers find the old pointer or the new one."""
        temporary = self._path(f"{self.root}/CURRENT-{version}")
        self._put(f"{self.root}/CURRENT-{version}", version)
        jvm = self.spark._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(temporary, self._path(f"{self.root}/CURRENT"), overwrite)

    def vacuum(self) -> int:
        """Removes versions that neither the pointer nor its manifest names; returns how many."""
        current, n = self.version(), 0
        if current is None:
            return 0  # without a pointer nothing tells which version is in use
        held = self.manifest(current) or {"tables": {}}
        used = {current}.union(*[t["buckets"].values() for t in held["tables"].values()])
        for f in self._fs.listStatus(self._path(self.root)):
            if f.getPath().getName().startswith("v-") and f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
                n += 1
        return n
