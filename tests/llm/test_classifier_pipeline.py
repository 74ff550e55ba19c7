from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent.parent))
import corpus_pipeline  # noqa: E402
from cases import documents, empty  # noqa: E402

from docloom.llm import cotrain, jaccard_join, token_store  # noqa: E402


def test_held_out_accuracy(spark):
    """Fit on the labels of the middle size; documents outside the fitting sample are the test."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    x = cotrain.report(d, half).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = x[(x.quality == 1) & (x.toxic == 0)]
    assert clean.kept.mean() > 0.98
    assert ((x.quality_score > 0.5) == (x.quality == 1)).mean() > 0.97 and ((x.toxic_score > 0.5) == (x.toxic == 1)).mean() > 0.95


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(10, 1, 0), (None, 0, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    d = documents(spark)
    got = cotrain.report(d, labels)
    assert got.count() == d.count() and got.where("NOT kept").count() == 0
    assert cotrain.report(empty(spark), labels.limit(0)).count() == 0
    assert cotrain.classify(d.withColumnRenamed("n_chars", "other"), labels.limit(0)).count() == d.count()


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_stages_on_edge_rows(spark, folder):
    from docloom.llm.storage import materialise

    for docs in (documents(spark), empty(spark)):
        docs = materialise(docs.withColumn("mix_size", docs["size"]).withColumn("bm_items", docs["size"]), "test")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            docs = materialise(out, "test")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    one = corpus_pipeline.keep_one_of_near_copies(spark, q, sf_dir)
    classes = {r.class_id for r in jaccard_join.report(q).collect()}
    assert {r.doc_id for r in one.collect()} == classes  # the smallest id of each group
    clean = corpus_pipeline.drop_contaminated(spark, one, sf_dir)
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    want = token_store.store_and_read(mixed)
    key = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    got = corpus_pipeline.run(spark, sf_dir)
    assert key(got) == key(want) and sum(key(got).values()) == mixed.count()
