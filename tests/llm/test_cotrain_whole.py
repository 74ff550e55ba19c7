"""Co-training takes its pseudo-labels from all unlabelled documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docloom.llm import cotrain

WORDS = ("river", "stone", "lamp", "garden", "window", "paper", "road", "winter")


def corpus(spark, rare: int):
    """9,000 documents, 1,000 of them labelled: bad ones are known by their source; ``rare`` unlabelled bad ones have a word of their own."""
    rows = []
    for i in range(9000):
        bad = i % 2 == 0 if i < 1000 else i % 10 == 0
        word = " zyxword" if bad and i >= 1000 and i // 10 % (800 // rare) == 0 else ""
        rows.append((i, " ".join(WORDS[(i * 7 + j * j) % 8] for j in range(6)) + word, "bad" if bad else "good"))
    labels = [(i, int(i % 2), 0) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rare_pattern_gets_weight(spark):
    docs, labels = corpus(spark, 16)
    n = docs.where("text LIKE '%zyxword%'").count()
    assert 10 <= n <= 16  # half of them would be below LEAST_ROWS
    model = cotrain.fit(docs, labels)
    text = model.quality.text
    assert text.w[cotrain.text_features(pa.array(["zyxword"])).idx[0]] < 0
    assert model.quality.exchanged[0] >= 800 and model.toxic.constant == 0


def test_distributed_loss_equals_one_pass(spark):
    """The text model does not depend on how rows are dealt out."""
    docs, labels = corpus(spark, 16)
    a, b = (cotrain.fit(docs.repartition(n, "doc_id"), labels).quality for n in (1, 7))
    assert a.exchanged == b.exchanged and np.allclose(a.text.w, b.text.w, atol=1e-4)


def test_features_pack():
    x = cotrain.text_features(pa.array(["One two two.\nOne", "", None, "x"]))
    y = cotrain.unpacked(cotrain.packed(x).to_pylist(), True)
    assert (x.at == y.at).all() and all(sorted(x.take(np.array([i])).idx) == sorted(y.take(np.array([i])).idx) for i in range(4))
