"""Places for models: embedding, reranking, rewriting. None comes with the library; calls fail unless one is supplied."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docloom.functions.text import text_of
from docloom.operators.planner import needs_history
from docloom.operators.postings import ranked

BATCH = 32
Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]


class OfflineError(RuntimeError):
    pass


def _needed(model, what: str):
    if model is None:
        raise OfflineError(f"no {what} model was supplied")
    return model


def embed(df: DataFrame, model: Embedder | None, keys: list[str], text: str = "content", batch: int = BATCH) -> DataFrame:
    """keys and embedding; the model gets ``batch`` texts at a time, and all its vectors must have one length."""
    model = _needed(model, "embedding")
    src = df.select(*keys, text_of(text).alias("text"))
    schema = type(src.schema)(src.schema.fields[:-1]).add("embedding", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(len(keys)).to_pylist(), []
            for i in range(0, len(texts), batch):
                got = model(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]) or len({len(v) for v in got}) > 1:
                    raise ValueError("the embedding model gave vectors of several lengths, or not one a text")
                out += [[float(x) for x in v] for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "embedding"])

    return src.mapInArrow(run, schema)


def rerank(hits: DataFrame, model: Scorer | None, k: int, keys: list[str], query_id: str = "query_id", query: str = "query", text: str = "content") -> DataFrame:
    """Hits scored anew by a model over (question, text) pairs; the k best of each question."""
    model = _needed(model, "reranking")
    had = [query_id, *keys]
    src = hits.select(*had, text_of(query).alias("q"), text_of(text).alias("t"))
    schema = type(src.schema)(src.schema.fields[:-2]).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model(b.column("q").to_pylist(), b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(np.asarray(s, np.float64))], names=[*had, "score"])

    return ranked(src.mapInArrow(run, schema), k, keys, query_id)


def rewrite(queries: DataFrame, model: Callable[[list[str], list[str]], list[str]] | None = None, query: str = "query", history: str = "history") -> DataFrame:
    """Questions that lean on the history go through the model; without one, and for all others, they stay as they are."""
    if model is None:
        return queries

    @F.pandas_udf("string")
    def run(q, h):
        return type(q)(model(q.tolist(), h.tolist()))

    return queries.withColumn(query, F.when(needs_history(query), run(F.col(query), F.col(history))).otherwise(F.col(query)))


def answer_mode(intent: Column, n_sources: Column, clarify: Column, mixed: Column) -> Column:
    """How an answer came about, offline: structured, structured_clarify, mixed, empty or local_fallback."""
    return F.when(clarify.isNotNull(), "structured_clarify").when(mixed, "mixed").when(intent == "structured_computation", "structured").when(F.coalesce(n_sources, F.lit(0)) == 0, "empty").otherwise("local_fallback")
