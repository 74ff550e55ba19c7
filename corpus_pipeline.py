"""The corpus pipeline: quality classifier, near-duplicate removal, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last writes the token store and returns what it reads back from it.

Defined results: null texts are scored by their metadata, link to nothing, are never contaminated, cost the mix nothing and
have only an end id; null ids are ids like any other. Of rows that repeat whole one stays, and so does the one of the
smallest id of each group of near copies; wordless rows all stay. Documents without words come into the mix once an epoch,
and with the sample while it has room. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import cotrain, decontaminate, jaccard_join, mixing, token_store
from docloom.llm.storage import materialise


#: columns that stages read; all others are carried under other names, so that none clashes with a stage's own
USED = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs`` with its other columns renamed; the result has the columns of ``docs``, in their order."""
    safe = {c: c if c in USED else f"carried_{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in safe.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects, as of low quality or toxic, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _guarded(docs, lambda d: cotrain.classify(d, labels).where("ct_kept"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _guarded(docs, jaccard_join.keep_one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _guarded(docs, lambda d: decontaminate.decontaminate(d, benchmark).where(F.size("bm_items") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice."""

    def mixed(d: DataFrame) -> DataFrame:
        taken = mixing.mix_documents(d).where("mix_copies > 0")
        return taken.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))))

    return _guarded(docs, mixed)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: trained models and a tokenizer can't be written in SQL; tests/llm/test_pipeline_brute.py holds the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower().replace("/", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
