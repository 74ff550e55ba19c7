from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
from cases import documents, empty, rows  # noqa: E402
from oracle import connect, rows_of, rows_of_sql  # noqa: E402

from docloom.llm import mixing  # noqa: E402


def water(sizes: dict, weights=(3, 1, 2)) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, fixed, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(2 * sizes[s] for s in fixed)
        target = {s: 2.0 * sizes[s] if s in fixed else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        fixed |= over


def test_targets_and_taken(spark):
    got = mixing.report(documents(spark)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((x[0], size(x[1])) for x in rows())
    sizes: dict = defaultdict(int)
    for x in rows():
        sizes[x[3]] += size(x[1])
    want = water(dict(sizes))
    by_size = {}
    for x in rows():
        by_size.setdefault((x[0], size(x[1])), x[3])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = by_size[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.report(documents(spark).repartition(5)).collect()), key=repr)


def test_sql_and_empty(spark, sf_dir):
    from pyspark.sql import functions as F

    assert mixing.report(empty(spark)).count() == 0
    zero = documents(spark).withColumn("text", F.lit(None).cast("string"))
    assert all(r["size"] == 0 and r.taken == 0 and r.target == 0 for r in mixing.report(zero).collect())
    assert rows_of(mixing.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == rows_of_sql(connect(sf_dir), mixing.SQL)


def test_key_buckets_are_even(spark, monkeypatch):
    """Low weights do not pile up in a source's last buckets."""
    from pyspark.sql import functions as F

    n, quality = 60_000, F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.5 + F.col("doc_id") % 7 / 20)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("mix_size")).withColumn("mix_quality", quality)
    docs = docs.withColumn("mix_key", -F.log(mixing.uniform_of(F.col("doc_id"))) / F.col("mix_quality"))
    monkeypatch.setattr(mixing, "BUCKETS", 100)
    plan_rows = mixing.targets(mixing.counted(docs, "source")).first()
    below = sum(r.n * (1 - F.exp(-r.rate * F.col("mix_key"))) for r in plan_rows.mix_rates) / plan_rows.mix_rows
    place = F.least(F.lit(plan_rows.mix_buckets - 1), F.floor(below * plan_rows.mix_buckets))
    seen = {r.b: r["count"] for r in docs.groupBy(place.alias("b")).count().collect()}
    assert max(seen.values()) < 2 * n / plan_rows.mix_buckets and len(seen) == plan_rows.mix_buckets


def test_documents_without_a_text_shuffle(spark):
    d = documents(spark).dropDuplicates(["doc_id", "text"])
    got = Counter((r.doc_id, r.text, r.mix_copies) for r in mixing.mix_documents(d).select("doc_id", "text", "mix_copies").collect())
    assert got == Counter((r.doc_id, r.text, r.mix_copies) for r in mixing.mix(mixing.sized(d)).select("doc_id", "text", "mix_copies").collect())
    assert mixing.mix_documents(empty(spark)).count() == 0
    assert mixing.mix_documents(documents(spark)).columns[: len(d.columns)] == d.columns
