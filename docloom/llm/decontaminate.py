"""Benchmark decontamination by winnowing.

Per sliding window of k-gram hashes the (rightmost) minimum is kept as fingerprint, on both sides by the same rule. With
k = 5 and 6 k-grams to a window, every shared run of 10 words shares a fingerprint. Document fingerprints are joined with
those of the benchmark and each hit is extended to the left and right word by word, so results are exact. Items of fewer
than 10 words are one window of their own length; their lengths are looked up at every position.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text, one pass over the documents for each block;
with one block (the usual case) the operator is a single map without a shuffle.

Defined results: null text has no words; empty tables give empty (or all-clean) results; repeated rows each get a row;
items with the same id count once; a null item id is written as "null"; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.storage import materialise
from docloom.llm.wordhash import chunks, kgrams, string_buffers, word_hashes, words_of
from docloom.llm.worker import lean

WINDOW, K = 10, 5
BLOCK_BYTES = 32 << 20
SCHEMA = "n_words long, hit_from array<int>, hit_to array<int>, items array<string>"


def winnow(g: np.ndarray, n_words: np.ndarray, first: np.ndarray, k: int, width: int) -> np.ndarray:
    """Positions of the selected k-grams. ``first`` has the texts' first words (n + 1); a text takes part from width + k - 1 words."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        nxt = g[j : j + n]
        take = nxt <= low
        low[take] = nxt[take]
        at[take] = np.flatnonzero(take) + j
    # windows that lie within one text
    edge = np.zeros(len(g) + k + 1, np.int64)
    ok = n_words >= width + k - 1
    np.add.at(edge, first[:-1][ok], 1)
    np.add.at(edge, first[:-1][ok] + n_words[ok] - (width + k - 1) + 1, -1)
    chosen = np.zeros(len(g), bool)
    chosen[at[np.cumsum(edge)[:n] > 0]] = True
    return np.flatnonzero(chosen)


def _positions(n_words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """All k-gram positions that lie within one text."""
    edge = np.zeros(int(first[-1]) + 2, np.int64)
    ok = n_words >= k
    np.add.at(edge, first[:-1][ok], 1)
    np.add.at(edge, first[:-1][ok] + n_words[ok] - k + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


class Fingerprints:
    """The benchmark block: texts by their words, with the ids that have them, and where each fingerprint stands."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        ids: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            if words := tuple(words_of(text)):
                ids[words].add(item)
        self.texts = list(ids)
        self.ids = [sorted(x) for x in ids.values()]
        self.where: dict[int, dict[int, list[tuple[int, int]]]] = {}  # length of the k-gram: hash: text, position
        long = [i for i, t in enumerate(self.texts) if len(t) >= window]
        self.where[0] = self._table(long, k, window - k + 1)
        for size in sorted({len(t) for t in self.texts if len(t) < window}):
            self.where[size] = self._table([i for i, t in enumerate(self.texts) if len(t) == size], size, 1)
        self.sorted = {k: np.sort(np.fromiter(t, np.uint64, len(t))) for k, t in self.where.items() if t}

    def _table(self, which: list[int], k: int, width: int) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        raw, off = string_buffers(pa.array([b" ".join(self.texts[i]).decode("utf-8", "surrogatepass") for i in which], pa.large_string()))
        h, first = word_hashes(raw, off)
        g, n = kgrams(h, k), np.diff(first)
        at = winnow(g, n, first, k, width) if width > 1 else _positions(n, first, k)
        for p, owner in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
            out[int(g[p])].append((which[owner], p - int(first[owner])))
        return dict(out)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per text with a fingerprint in common: table, word position, hash."""
        n = np.diff(first)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for size, table in self.sorted.items():
            k = size or self.k
            g = kgrams(h, k)
            at = _positions(n, first, k) if size else winnow(g, n, first, k, self.window - k + 1)
            own = g[at]
            hit = table[np.minimum(np.searchsorted(table, own), len(table) - 1)] == own
            at, own = at[hit], own[hit]
            for p, owner, x in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), own.tolist(), strict=True):
                found[owner].append((size, p - int(first[owner]), x))
        return found

    def extend(self, words: list[bytes], hits: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the document that are covered by a window of an item, and those items."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        done: dict[tuple[int, int], int] = {}
        for size, p, x in sorted(hits, key=lambda y: y[1]):
            for text, q in self.where[size][x]:
                if done.get((text, p - q), -1) > p:
                    continue
                own = self.texts[text]
                a, b, i, j = p, p, q, q
                while a > 0 and i > 0 and words[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(words) and j < len(own) and words[b] == own[j]:
                    b, j = b + 1, j + 1
                done[text, p - q] = max(b, p + 1)
                if b - a >= min(self.window, len(own)):
                    spans.append((a, b))
                    items.add(text)
        return spans, {x for t in items for x in self.ids[t]}


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(prints: Fingerprints, texts: pa.Array) -> list[tuple[int, list[int], list[int], list[str]]]:
    raw, off = string_buffers(texts)
    out = []
    for i, j in chunks(off):
        h, first = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        found = prints.candidates(h, first) if prints.sorted else {}
        for r, n in enumerate(np.diff(first).tolist()):
            spans, items = prints.extend(words_of(texts[i + r].as_py()), found[r]) if r in found else ([], set())
            spans = union(spans)
            out.append((n, [a for a, _ in spans], [b for _, b in spans], sorted(items)))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def _append(docs: DataFrame, fn, names: list[str], types: list[pa.DataType], schema: str, text_col: str) -> DataFrame:
    """All columns of ``docs`` and, after them, what ``fn`` gives for the text column."""
    spark = docs.sparkSession
    extra = spark.createDataFrame([], schema).schema
    out = type(docs.schema)([*docs.schema.fields, *extra.fields])
    had = docs.columns
    place = had.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = fn(b.column(place))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[] for _ in types], types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*had, *names])

    return docs.mapInArrow(lean(run), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES, tag: str = "bm") -> DataFrame:
    """``docs`` with columns ``{tag}_n_words``, ``{tag}_from``, ``{tag}_to`` (hit word ranges) and ``{tag}_items`` (sorted ids)."""
    names = [f"{tag}_n_words", f"{tag}_from", f"{tag}_to", f"{tag}_items"]
    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    schema = f"{names[0]} long, {names[1]} array<int>, {names[2]} array<int>, {names[3]} array<string>"
    sc = docs.sparkSession.sparkContext
    out, last = docs, None
    for n, block in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)):
        shared = sc.broadcast(Fingerprints(block, window, k))
        fn = lambda texts, shared=shared: _scan(shared.value, texts)
        if n == 0:
            out = _append(out, fn, names, types, schema, text_col)
            continue
        # further blocks: one more pass each, hits united with those so far
        more = [f"{x}__{n}" for x in names]
        last = _append(out, fn, more, types, f"{more[0]} long, {more[1]} array<int>, {more[2]} array<int>, {more[3]} array<string>", text_col)
        merged = F.aggregate(
            F.array_sort(F.concat(F.arrays_zip(F.col(names[1]).alias("a"), F.col(names[2]).alias("b")), F.arrays_zip(F.col(more[1]).alias("a"), F.col(more[2]).alias("b")))),
            F.array().cast("array<struct<a:int,b:int>>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
            ).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))),
        )
        last = last.withColumn("__m", merged)
        out = last.select(*docs.columns, names[0], F.col("__m.a").alias(names[1]), F.col("__m.b").alias(names[2]), F.array_sort(F.array_distinct(F.concat(names[3], more[3]))).alias(names[3]))
        out = materialise(out, "decontaminate")
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The digest of the contract: one row per document."""
    x = decontaminate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **kw)
    hit = F.aggregate(F.arrays_zip("bm_from", "bm_to"), F.lit(0).cast("long"), lambda acc, s: acc + (s["bm_to"] - s["bm_from"]))
    return x.select(
        "doc_id",
        F.col("bm_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bm_items", ","), 256).alias("items_sha256"),
        (F.size("bm_from") > 0).alias("contaminated"),
    )


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM i),
lengths AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d JOIN lengths ON len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp),
hit AS (SELECT rid, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
