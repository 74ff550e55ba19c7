"""Retrieval and answer quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import text as T

COVERAGE = 0.7


#: bytes of a passage that are looked up; a passage that has fewer is searched for by itself
ANCHOR = 8
#: bytes of text in which places are looked up at once
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(windows: np.ndarray) -> np.ndarray:
    return (windows * _MIX) >> np.uint64(48)


class Passages:
    """Texts to be found in other texts, by the first bytes of each."""

    def __init__(self, passages: list[str]):
        self.passages, raw = passages, [p.encode() for p in passages]
        self.short = [i for i, p in enumerate(raw) if len(p) < ANCHOR]
        self.of: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            if len(p) >= ANCHOR:
                self.of.setdefault(int.from_bytes(p[:ANCHOR], "little"), []).append(i)
        self.anchors = np.array(sorted(self.of), np.uint64)
        self.slot = np.zeros(1 << 16, bool)
        self.slot[_slots(self.anchors)] = True

    def within(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """Number of the text and of the passage that it holds, each pair once."""
        for i, t in enumerate(texts):
            for p in self.short:
                if t is not None and self.passages[p] in t:
                    yield i, p
        raw = [b"" if t is None else t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        whole = np.frombuffer(b"".join(raw) + bytes(ANCHOR), np.uint8)
        seen: set[tuple[int, int]] = set()
        for start in range(0, len(whole) - ANCHOR, BLOCK):
            part = whole[start : start + BLOCK + ANCHOR - 1]
            n = len(part) - ANCHOR + 1
            windows = np.ndarray((n,), "<u8", np.ascontiguousarray(part), strides=(1,))  # at every byte
            at = np.flatnonzero(self.slot[_slots(windows)])
            at = at[np.isin(windows[at], self.anchors)]
            for i, anchor in zip(np.searchsorted(ends, at + start, side="right").tolist(), windows[at].tolist(), strict=True):
                seen.update((i, p) for p in self.of[anchor])
        for i, p in sorted(seen):
            if i < len(texts) and texts[i] is not None and self.passages[p] in texts[i]:
                yield i, p


def containing(docs: DataFrame, passages: DataFrame, query_id: str = "query_id", passage: str = "passage", key: str = "doc_id", content: str = "text") -> DataFrame:
    """query_id, key: documents that hold a whole passage. One pass looks for all passages at once; they go to the tasks, so
    they have to be few."""
    rows = passages.select(query_id, passage).where(F.col(passage).isNotNull()).collect()
    ids, found = [r[0] for r in rows], Passages([r[1] for r in rows])
    asked, own = passages.schema[query_id].dataType, docs.schema[key].dataType
    kind = to_arrow_type(asked)
    out = ty.StructType([ty.StructField(query_id, asked), ty.StructField(key, own)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                pairs = list(found.within(part.column(1).to_pylist()))
                if pairs:
                    hit = pa.array([ids[p] for _, p in pairs], kind)
                    yield pa.RecordBatch.from_arrays([hit, part.column(0).take(pa.array([d for d, _ in pairs]))], names=[query_id, key])

    return docs.select(key, content).mapInArrow(scan, out)


def retrieval_cases(hits: DataFrame, truth: DataFrame, query_id: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Per case: rank of the first right hit (null if there is none); cases without hits count. ``truth`` is read once."""
    first = hits.groupBy(query_id, key).agg(F.min("rank").alias("hit_rank"))
    return truth.select(query_id, key).join(first, [query_id, key], "left").groupBy(query_id).agg(F.min("hit_rank").alias("hit_rank"))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    hit = F.col("hit_rank").isNotNull().cast("double")
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg((F.coalesce("hit_rank", F.lit(0)) == 1).cast("double")), 6).alias("top1"), F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


def term_coverage(answer: Column, expected: Column) -> Column:
    """Share of expected terms found; a term is an array of alternatives."""
    text = T.normalise_for_match(answer)
    found = F.filter(expected, lambda alts: F.exists(alts, lambda a: F.contains(text, T.normalise_for_match(a))))
    return F.when(F.size(expected) > 0, F.size(found) / F.size(expected)).otherwise(1.0)


def answer_cases(cases: DataFrame, least: float = COVERAGE) -> DataFrame:
    """``cases`` has answer, expected_terms, n_sources, chunk_hit. Adds coverage, citation checks and a failure class."""
    cited = T.citations("answer")
    x = cases.withColumn("coverage", F.round(term_coverage(F.col("answer"), F.col("expected_terms")), 6)).withColumn("has_citation", F.size(cited) > 0)
    x = x.withColumn("citation_valid", F.col("has_citation") & F.forall(cited, lambda c: (c >= 1) & (c <= F.col("n_sources"))))
    fail = F.when(~F.col("chunk_hit"), "retrieval_miss").when(F.col("coverage") < least, "answer_incomplete").when(~F.col("citation_valid"), "citation_invalid").otherwise("pass")
    return x.withColumn("failure", fail)


def usage_totals(cases: DataFrame) -> DataFrame:
    """Token usage summed over a struct column ``usage``."""
    return cases.agg(*[F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
