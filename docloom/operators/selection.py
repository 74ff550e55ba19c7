"""Filters, fallbacks and small projections around a search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T


def chunk_filter(chunks: DataFrame, source_paths: Iterable[str] = (), node_types: Iterable[str] = (), path: str = "source_path", name: str | None = "filename", node_type: str = "node_type") -> DataFrame:
    """Chunks of these sources and of these node types, without regard to case; an empty set does not filter. A chunk without
    a path goes by its file name."""
    own = T.fold(F.coalesce(F.col(path), F.col(name)) if name else F.col(path))
    folded = lambda values: [T.fold(F.lit(v)) for v in values]
    paths, types = folded(source_paths), folded(node_types)
    if paths:
        chunks = chunks.where(own.isin(*paths))
    if types:
        chunks = chunks.where(T.fold(node_type).isin(*types))
    return chunks


def for_user(table: DataFrame, user: int, column: str = "user_id") -> DataFrame:
    """Rows of one tenant; a row without an owner is nobody's."""
    return table.where(F.col(column) == F.lit(user))


def first_results(queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int, keys: list[str], query_id: str = "query_id") -> DataFrame:
    """``hits`` (query_id, keys, score, rank) and, for queries without any, the first k chunks with score 0."""
    few = chunks.select(*keys).orderBy(*keys).limit(k)
    few = few.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))  # k rows
    missing = queries.select(query_id).join(hits.select(query_id).distinct(), query_id, "left_anti")
    more = missing.crossJoin(F.broadcast(few)).select(query_id, *keys, F.lit(0.0).alias("score"), "rank")
    return hits.select(query_id, *keys, "score", "rank").unionByName(more)


def recent_chunks(chunks: DataFrame, k: int, created: str, keys: list[str], score: float = 0.3) -> DataFrame:
    """The k chunks of the newest documents, in order, with a fixed score."""
    return chunks.orderBy(F.col(created).desc(), *keys).limit(k).withColumn("score", F.lit(score))


def display_on_first(chunks: DataFrame, display: Column, position: str = "pos") -> DataFrame:
    """A node's display text stands at its first chunk only."""
    return chunks.withColumn("display_content", F.when(F.col(position) == 0, display))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def union_records(legacy: DataFrame, sharded: DataFrame) -> DataFrame:
    """Records of both stores; columns that one lacks are null."""
    return legacy.unionByName(sharded, allowMissingColumns=True)


def manifest_totals(shards: DataFrame, sets: list[str], sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Unions of the shards' sets, sorted, and sums."""
    out = [F.array_sort(F.collect_set(x)).alias(x) for x in sets] + [F.sum(x).alias(x) for x in sums]  # sets of a few versions or types
    return shards.groupBy(*(by or [])).agg(*out)


def iso_time(ts: Column | str) -> Column:
    """ISO 8601 with microseconds where there are any."""
    ts = T.col(ts)
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))


def mixed_sources(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Computed rows before document sources, numbered in one list for each query: both have query_id and rank."""
    a, b = rows.withColumn("kind", F.lit("row")), documents.withColumn("kind", F.lit("document"))
    w = Window.partitionBy("query_id").orderBy(F.col("kind").desc(), "rank")
    return a.unionByName(b, allowMissingColumns=True).withColumn("rank", F.row_number().over(w))


def folder_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder and their bytes, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
