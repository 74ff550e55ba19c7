"""Exact dense top-k. Query vectors go to the tasks in blocks of bounded size; each task keeps its k best of a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.postings import ranked

BLOCK = 2048
#: scores that a task holds at once
STRIP = 1 << 21


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as float64, and their places."""
    lists = col.to_pylist()
    good = [i for i, v in enumerate(lists) if v is not None and len(v) == dim and None not in v]
    return np.array([lists[i] for i in good], np.float64).reshape(len(good), dim), np.array(good, np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n == 0, 1, n)[:, None]


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", metric: str = "cosine", block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """query_id, id, score, rank. ``queries`` has query_id and the vector column; a zero vector has score 0.

    Vectors of another dimension than the query's, or with null parts, cannot be compared and are left out.
    """
    out: DataFrame | None = None
    rows: list = []
    it = queries.select(query_id, vector_col).where(F.col(vector_col).isNotNull()).toLocalIterator()

    def one(rows: list) -> DataFrame:
        dim = len(rows[0][1])
        ids = np.array([r[0] for r in rows if len(r[1]) == dim], np.int64)
        q = np.array([r[1] for r in rows if len(r[1]) == dim], np.float64)
        q = _unit(q) if metric == "cosine" else q

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for b in batches:
                m, at = _matrix(b.column(1), dim)
                if not len(m):
                    continue
                own = b.column(0).to_numpy()[at]
                m = _unit(m) if metric == "cosine" else m
                step = max(1, strip // len(ids))
                for i in range(0, len(m), step):
                    s = np.round(q @ m[i : i + step].T, 6) + 0.0
                    n = s.shape[1]
                    least = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(ids), -np.inf)
                    r, c = np.nonzero(s >= least[:, None])  # ties of the last place are settled by id
                    best.append(_prune([(ids[r], own[i + c], s[r, c])], k))
                    if len(best) > 8:
                        best = [_prune(best, k)]
            if best:
                a, c, s = _prune(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], names=["query_id", "id", "score"])

        return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(scan, "query_id long, id long, score double")

    groups: dict[int, list] = {}
    for r in it:
        groups.setdefault(len(r[1]), []).append(r)
        rows = groups[len(r[1])]
        if len(rows) >= block:
            out = one(rows) if out is None else out.unionByName(one(rows))
            groups[len(r[1])] = []
    for rows in groups.values():
        if rows:
            out = one(rows) if out is None else out.unionByName(one(rows))
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, id long, score double")
    return ranked(out, k, ["id"], "query_id")


def _prune(best: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, c, s = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((c, -s, a))
    a, c, s = a[order], c[order], s[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k
    return a[keep], c[keep], s[keep]
