"""Fusing, capping and enriching ranked hits. Hits are rows of query_id, keys, rank, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.postings import ranked

RRF = 10


def fuse_ranks(a: DataFrame, b: DataFrame, keys: list[str], k: int, query_id: str = "query_id", constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two rankings by a full outer join."""
    on = [query_id, *keys]
    x = a.select(*on, F.col("rank").alias("rank_a")).join(b.select(*on, F.col("rank").alias("rank_b")), on, "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return ranked(x.withColumn("score", F.round(part("rank_a") + part("rank_b"), 6)), k, keys, query_id)


def max_merge(a: DataFrame, b: DataFrame, keys: list[str], query_id: str = "query_id") -> DataFrame:
    """Union of two candidate sets, the higher score for each."""
    on = [query_id, *keys]
    return a.select(*on, "score").unionByName(b.select(*on, "score")).groupBy(*on).agg(F.max("score").alias("score"))


def diversify(hits: DataFrame, k: int, group: str, query_id: str = "query_id") -> DataFrame:
    """At most max(1, (3k + 4) // 5) rows of a group, then the rest in rank order, k rows in all."""
    cap = max(1, (3 * k + 4) // 5)
    inside = Window.partitionBy(query_id, F.lower(group)).orderBy("rank")
    x = hits.withColumn("over", F.row_number().over(inside) > cap)
    chosen = Window.partitionBy(query_id).orderBy("over", "rank")
    x = x.withColumn("new_rank", F.row_number().over(chosen)).where(F.col("new_rank") <= k)
    # capped rows come first, those over the cap follow, each in rank order
    return x.drop("rank", "over").withColumnRenamed("new_rank", "rank")


def at_least(hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Applied after the top-k, so fewer than k rows may be left."""
    return hits.where(F.col("score") >= threshold)


def neighbours(chunks: DataFrame, document: str = "document_id", index: str = "chunk_index", content: str = "content", radius: int = 4) -> DataFrame:
    """Each chunk with its neighbours' text, joined by newlines in order."""
    w = Window.partitionBy(document).orderBy(index).rangeBetween(-radius, radius)
    return chunks.withColumn("context", F.array_join(F.collect_list(content).over(w), "\n"))


def first_then_fill(chunks: DataFrame, k: int, document: str, order: list[str]) -> DataFrame:
    """The first chunk of each document, then the others in order, k rows in all."""
    own = Window.partitionBy(document).orderBy(*order)
    x = chunks.withColumn("later", F.row_number().over(own) > 1)
    return x.orderBy("later", *order).limit(k)


def summary_sources(chunks: DataFrame, document: str = "source_path", index: str = "chunk_index", per_document: int = 3) -> DataFrame:
    """Workbook summaries, else sheet summaries (three at most), else the first chunk of each document."""
    level = F.when(F.col("node_type") == "workbook_summary", 0).when(F.col("node_type") == "sheet_summary", 1).otherwise(2)
    x = chunks.withColumn("level", level)
    doc = Window.partitionBy(document)
    x = x.withColumn("best", F.min("level").over(doc)).where("level = best")
    x = x.withColumn("nth", F.row_number().over(doc.orderBy(index)))
    return x.where((F.col("nth") == 1) | ((F.col("level") < 2) & (F.col("nth") <= per_document))).drop("level", "best", "nth")
