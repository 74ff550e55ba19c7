"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles (a text of one to four words is one shingle). In each run a set chooses one of its
shingles, the smallest under the run's hash, and goes to that shingle's bucket: two sets of similarity s meet with
probability s. Buckets of up to ``small`` sets are compared by brute force. Larger ones are split again in the same way,
with fresh hashes, up to ``LEVELS`` times. A bucket that a split leaves together is a group of near copies: it is compared
in blocks, so that no task holds more than two blocks. At every level runs repeat until the chance to miss a pair at the
threshold is below 1 - ``recall`` over all levels together.

A pair is counted only on the path of the first runs in which its sets agree, so links are sums and no pair is written out.
Texts with equal sets form a class, compared once. Tasks emit sums for each class and the edges of a spanning forest.

Defined results: null or wordless text has no shingles, links to nothing and is a class of its own; repeated rows are
linked copies; null ids stay null and count like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.grouping import sorted_groups
from docloom.llm.storage import Scratch, materialise
from docloom.llm.wordhash import chunks, constants, kgrams, mix, string_buffers, word_hashes
from docloom.llm.worker import lean

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99998
SMALL = 1024
LEVELS = 4
#: share of a bucket that stays together in a split, from which on it counts as a group of near copies
DENSE = 0.25
COLUMNS, STRIP = 1024, 128


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Runs of a level: each level may miss its share of what is allowed in all."""
    return max(1, math.ceil(math.log((1 - recall) / levels) / math.log(1 - threshold)))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one part of the texts after another: sorted distinct shingle hashes, and where each text's begin (n + 1)."""
    raw, off = string_buffers(texts)
    for i, j in chunks(off):
        h, first = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        n = np.diff(first)
        g = kgrams(h, k)
        count = np.maximum(n - k + 1, 0)
        owner = np.repeat(np.arange(j - i), count)
        at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        value = g[at]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = np.array([kgrams(h[first[s] : first[s + 1]], int(n[s]))[0] ^ np.uint64(n[s]) for s in short], np.uint64)
            owner, value = np.append(owner, short), np.append(value, mix(own))
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        if len(owner):
            new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
            owner, value = owner[new], value[new]
        yield value, np.searchsorted(owner, np.arange(j - i + 1))


def signatures(texts: pa.Array, n_runs: int, k: int = SHINGLE, of_runs: int | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Set digest (16 bytes), set size, and the chosen shingle of each run as (texts, runs) 64-bit values.

    The digest depends on how many runs there are in all, ``of_runs``."""
    of_runs = n_runs if of_runs is None else of_runs
    salt = constants(of_runs + 2, seed=3)
    digests, sizes, sigs = [], [], []
    for value, at in shingle_sets(texts, k):
        n = np.diff(at)
        full = np.flatnonzero(n)
        sig = np.zeros((len(n), n_runs), np.uint64)
        dig = np.zeros((len(n), 2), np.uint64)
        if len(full):
            for r in range(n_runs):
                sig[full, r] = np.minimum.reduceat(mix(value ^ salt[r]), at[full])
            for r in range(2):
                dig[full, r] = np.add.reduceat(mix(value + salt[of_runs + r]), at[full])
        digests += [d.tobytes() for d in dig]
        sizes.append(n)
        sigs.append(sig)
    return digests, np.concatenate(sizes) if sizes else np.zeros(0, np.int64), np.concatenate(sigs) if sigs else np.zeros((0, n_runs), np.uint64)


def linked(sets: list[np.ndarray], t: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard similarity of t or more; with ``split`` only pairs across that index."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    u, code, n = np.unique(value, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(u), -1, np.int64)
    place[shared] = np.arange(len(shared))
    col = place[code]
    keep = col >= 0
    owner, col = owner[keep], col[keep]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    # rows against columns: the two sides of ``split``, or all against all
    rows, cols = (slice(0, m), slice(0, m)) if split is None else (slice(0, split), slice(split, m))
    common = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(col, [lo, lo + COLUMNS])
        part = np.zeros((m, min(COLUMNS, len(shared) - lo)), np.float32)
        part[owner[a:b], col[a:b] - lo] = 1
        common += part[rows] @ part[cols].T
    found_i, found_j = [], []
    for lo in range(0, len(common), STRIP):  # strips keep what is compared at once small; float32 counts are exact to 2**24
        c = common[lo : lo + STRIP].astype(np.float64)
        i, j = np.nonzero(c * (1 + t) >= t * (size[rows][lo : lo + STRIP, None] + size[cols][None, :]) - 1e-9)
        i, j = i + lo, j + cols.start
        found_i.append(i[i < j])
        found_j.append(j[i < j])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(i: np.ndarray, j: np.ndarray, m: int) -> list[tuple[int, int]]:
    root, out = list(range(m)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            out.append((a, b))
    return out


def _first_on_path(sig: np.ndarray, i: np.ndarray, j: np.ndarray, path: list[int], runs: int) -> np.ndarray:
    """Whether the runs of ``path`` are, level by level, the first ones in which the sets of each pair agree."""
    ok = np.ones(len(i), bool)
    for level, run in enumerate(path):
        lo = level * runs
        ok &= ~(sig[i, lo : lo + run] == sig[j, lo : lo + run]).any(axis=1)
    return ok


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, cid) and classes (cid, class_size, n_links, root); links count documents.

    ``text_hash`` is the 64-bit hash of the text by which a caller can find its rows again.
    """
    write = Scratch(docs.sparkSession)
    R = runs_for(recall, threshold)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    # one row stands for its class; copies of a text differ in this hash, so they spread when texts are joined by it
    src = src.withColumn("row", F.xxhash64("text_hash", "doc_id"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = [f"s{r}" for r in range(LEVELS * R)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dig, n, sig = signatures(b.column("text"), LEVELS * R, shingle)
            cols = [pa.array(np.ascontiguousarray(sig[:, r]).view(np.int64)) for r in range(LEVELS * R)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("row"), pa.array(dig, pa.binary()), pa.array(n.astype(np.int64)), *cols], names=["doc_id", "text_hash", "row", "cid", "n", *names])

    signed = materialise(src.mapInArrow(lean(sign), f"doc_id {kind}, text_hash long, row long, cid binary, n long, " + ", ".join(f"{s} long" for s in names)), "join-signatures")
    classes = write(
        signed.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("weight"), F.min("row").alias("row"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in names]), "join-classes"
    )

    # A node is a bucket of a path of (run, shingle) choices; rows stay thin until buckets with a single class are gone.
    nodes = classes.select(F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("path"), "cid")
    ready: list[DataFrame] = []
    for level in range(LEVELS):
        own = classes.select("cid", F.array(*names[level * R : (level + 1) * R]).alias("own"))
        split = nodes.join(own, "cid") if level else nodes.drop("own").join(own, "cid")
        split = split.select("parent", "size", "path", "cid", F.posexplode("own").alias("run", "token")).withColumn("bucket", F.xxhash64("parent", F.lit(level), "run", "token"))
        met = split.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("parent").alias("parent"), F.min("size").alias("size")).where("m > 1")
        met = write(met, f"join-buckets-{level}")
        if level:
            # a bucket whose sets stay together when it is split holds near copies: it is compared in blocks as it is
            dense = write(met.groupBy("parent").agg((F.max("m") >= DENSE * F.min("size")).alias("dense")), f"join-dense-{level}")
            judged = write(nodes.join(dense, "parent", "left"), f"join-judged-{level}")
            ready.append(judged.where("dense").select(F.col("parent").alias("bucket"), F.col("size").alias("m"), "path", "cid"))
            met = met.join(dense.where("dense"), "parent", "left_anti")
        members = split.select("bucket", "path", "run", "cid").join(met.select("bucket", "m"), "bucket").select("bucket", "m", F.concat("path", F.array("run")).alias("path"), "cid")
        members = write(members, f"join-members-{level}")
        last = level == LEVELS - 1
        ready.append(members if last else members.where(F.col("m") <= small))
        nodes = members.where(F.col("m") > small).select(F.col("bucket").alias("parent"), F.col("m").alias("size"), "path", "cid")
        if last or nodes.isEmpty():
            break
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    facts = classes.select("cid", "weight", "n", "row", F.array(*names).alias("sig"))
    rows = write(rows.join(facts, "cid"), "join-rows")

    # which members of a small bucket can have a partner there: another set of fitting size that first agrees on this path
    few = rows.where(F.col("m") <= small)

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sorted_groups(batches, "bucket"):
            n = table.column("n").to_numpy()
            sig = np.array(table.column("sig").combine_chunks().flatten()).reshape(len(n), -1)
            path = table.column("path")
            keep = np.zeros(len(n), bool)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                i, j = np.triu_indices(b - a, 1)
                size = n[a:b]
                fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
                i, j = a + i[fit], a + j[fit]
                ok = _first_on_path(sig, i, j, path[a].as_py(), R)
                keep[i[ok]] = keep[j[ok]] = True
            yield from table.filter(pa.array(keep)).to_batches()

    # a bucket's members meet in one task, in key order
    few = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(useful), rows.schema).withColumn("blocks", F.lit(1)).withColumn("mine", F.lit(0)).withColumn("other", F.lit(0))
    # still large: every block of members meets every block
    many = rows.where(F.col("m") > small).withColumn("blocks", F.ceil(F.col("m") / small).cast("int"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = write(few.unionByName(many).withColumn("pair", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))), "join-work")

    # the sets of classes that are needed, from one of their texts
    wanted = write(work.select("row", "cid").distinct(), "join-wanted")
    texts = src.select("row", "text").join(wanted.hint("shuffle_hash"), "row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [v[p:q].tobytes() for v, at in shingle_sets(b.column("text"), shingle) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            # two rows may share a 64-bit hash: a text counts for the class whose digest it has
            digests, _, _ = signatures(b.column("text"), 0, shingle, LEVELS * R)
            mine = pa.array([d == c for d, c in zip(digests, b.column("cid").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(out, pa.binary())], names=["cid", "shingles"]).filter(mine)

    # rows that repeat whole give a set more than once; the first is kept
    known = write(texts.mapInArrow(lean(sets), "cid binary, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles")), "join-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sorted_groups(batches, "pair"):
            cid, sets = table.column("cid").to_pylist(), table.column("shingles").to_pylist()
            weight, mine, other = table.column("weight").to_numpy(), table.column("mine").to_numpy(), table.column("other").to_numpy()
            path = table.column("path")
            sig = np.array(table.column("sig").combine_chunks().flatten()).reshape(len(weight), -1)
            links: dict[bytes, int] = {}
            edges: list[tuple[bytes, bytes]] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                order = np.argsort(mine[a:b], kind="stable") + a
                cross = None if mine[order[0]] == mine[order[-1]] else int(np.searchsorted(mine[order], mine[order[-1]]))
                if cross is None and (mine[a:b] != other[a:b]).any():
                    continue  # the other block is empty
                i, j = linked([np.frombuffer(sets[x], np.uint64) for x in order], threshold, cross)
                i, j = order[i], order[j]
                ok = _first_on_path(sig, i, j, path[a].as_py(), R)
                i, j = i[ok], j[ok]
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    links[cid[x]] = links.get(cid[x], 0) + int(weight[y])
                    links[cid[y]] = links.get(cid[y], 0) + int(weight[x])
                edges += [(cid[a + x], cid[a + y]) for x, y in _forest(i - a, j - a, b - a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*links, *[x for x, _ in edges]], pa.binary()), pa.array([*[None] * len(links), *[y for _, y in edges]], pa.binary()), pa.array([*links.values(), *[0] * len(edges)], pa.int64())], names=["a", "b", "links"]
            )

    # one row a member and task, the set beside it
    ready = work.select("pair", "path", "cid", "weight", "sig", "mine", "other").join(known, "cid").repartition("pair").sortWithinPartitions("pair")
    found = write(ready.mapInArrow(lean(compare), "a binary, b binary, links long"), "join-found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), write)
    out = classes.select("cid", "weight").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    out = materialise(
        out.select("cid", F.col("weight").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "join-classes-linked"
    )
    write.drop()
    return signed.select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("cid")).alias("cid")), out


def report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: its class (the smallest id of all documents linked to it, directly or by others) and links."""
    members, classes = jaccard_join(docs, **kw)
    joined = materialise(members.join(classes, "cid", "left").select("doc_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")), "join-documents")
    least = materialise(joined.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id")), "join-least")
    return joined.join(least, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; wordless documents all stay."""
    members, classes = jaccard_join(docs, id_col, text_col, **kw)
    joined = materialise(members.join(classes.select("cid", "root"), "cid").select("doc_id", "text_hash", "root"), "join-grouped")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    first = joined.groupBy("root").agg(best.alias("x")).select(F.col("x.doc_id").alias("jj_id"), F.col("x.text_hash").alias("jj_hash"))
    had = docs.columns
    keyed = docs.withColumn("jj_text", F.xxhash64(text_col))
    wordless = members.where("cid IS NULL").select(F.col("doc_id").alias("jj_id"), F.col("text_hash").alias("jj_hash")).distinct().withColumn("jj_empty", F.lit(True))
    chosen = materialise(first.withColumn("jj_empty", F.lit(False)).unionByName(wordless), "join-chosen")
    kept = keyed.join(chosen.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("jj_id")) & (F.col("jj_text") == F.col("jj_hash")))
    # rows repeated with id and text both equal: one of them stays
    once = kept.where("NOT jj_empty").dropDuplicates(["jj_id", "jj_text"])
    return once.select(had).unionByName(kept.where("jj_empty").select(had))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, len(w) || ' words: ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN k ON d.doc_id = k.a LEFT JOIN l ON d.doc_id = l.a
"""
