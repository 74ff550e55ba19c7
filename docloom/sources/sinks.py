"""Sinks: query traces and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def traces(hits: DataFrame, answers: DataFrame, query_id: str = "query_id", preview: int = 220) -> DataFrame:
    """One nested row a query: its hits in rank order with previews, and its answer."""
    item = F.struct("rank", "score", T.preview("content", preview).alias("preview"))
    return hits.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("hits")).join(answers, query_id, "left")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
