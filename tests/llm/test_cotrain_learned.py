"""What the co-trained classifier learns: toxic texts, both directions of the exchange, rare classes, odd rows."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, rows  # noqa: E402

from docloom.llm import cotrain  # noqa: E402

WORDS = ("river", "stone", "lamp", "garden", "window", "paper", "road", "winter")


def test_toxic_recall(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = cotrain.report(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (x.toxic_score[x.toxic == 1] > 0.5).mean() > 0.6
    assert (x.quality_score[x.quality == 0] < 0.5).mean() > 0.75


def two_sided(spark):
    """Labelled rows show their class by a word and by the source. Unlabelled ones show it by one of the two only, and have
    beside it a mark of the other view that no labelled row has."""
    out, labels = [], []
    for i in range(6000):
        bad = i % 2 == 0
        plain = [WORDS[(i * 7 + j * j) % 8] for j in range(6)]
        told, source = ("awful" if bad else "lovely"), ("low" if bad else "high")
        if i < 1000:
            labels.append((i, int(not bad), 0))
            out.append((i, " ".join([*plain, told]), source))
        elif i % 4 < 2:
            out.append((i, " ".join([*plain, told]), "newlow" if bad else "newhigh"))
        else:
            out.append((i, " ".join([*plain, "murk" if bad else "shine"]), source))
    return spark.createDataFrame(out, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_both_views_teach(spark):
    docs, labels = two_sided(spark)
    model = cotrain.fit(docs, labels)
    text, meta = model.quality.exchanged
    assert text > 500 and meta > 500 and (model.quality.both[:2] >= 0).all()
    odd = spark.createDataFrame([(1, "river murk", "none"), (2, "river shine", "none"), (3, "river", "newlow"), (4, "river", "newhigh")], docs.schema)
    s = {r.doc_id: r.ct_quality for r in cotrain.score(odd, model).collect()}
    assert s[1] < s[2] and s[3] < s[4]


def test_fitted_model_on_odd_rows_and_reruns(spark):
    base, labels = two_sided(spark)
    odd = documents(spark).selectExpr("doc_id + 100000 AS doc_id", "text", "source")
    docs = base.unionByName(odd).repartition(5)
    a = cotrain.report(docs, labels.unionByName(labels)).toPandas().sort_values(["doc_id", "quality_score"])
    b = cotrain.report(docs.repartition(3), labels).toPandas().sort_values(["doc_id", "quality_score"])
    assert len(a) == 6000 + len(rows()) and a.quality_score.between(0, 1).all() and a.toxic_score.eq(0).all()
    assert np.allclose(a.quality_score, b.quality_score, atol=1e-3)  # label rows that repeat count once


@pytest.mark.parametrize("many", [400, 40_000])
def test_rare_class_is_drawn(spark, many):
    """20 toxic labels in a large table are all fitted on, whatever the bound."""
    labels = spark.range(many).selectExpr("id AS ct_id", "double(1) AS ct_q", f"double(id % {many // 20} = 0) AS ct_t")
    drawn = cotrain._sampled(labels, 300)
    got = drawn.toPandas()
    assert (got.ct_t == 1).sum() == 20 and len(got) < 400 and abs(got.ct_w.sum() / many - 1) < 0.25
