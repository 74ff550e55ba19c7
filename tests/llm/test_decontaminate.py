from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, rows  # noqa: E402

from docloom.llm import decontaminate  # noqa: E402
from docloom.llm.wordhash import words_of  # noqa: E402


def brute(docs, items):
    out = []
    wins = [(i, {tuple(w[j : j + min(10, len(w))]) for j in range(max(1, len(w) - 9))}) for i, t in items if (w := words_of(t))]
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for i, ws in wins:
            for x in ws:
                for j in range(len(w) - len(x) + 1):
                    if tuple(w[j : j + len(x)]) == x:
                        hit.update(range(j, j + len(x)))
                        found.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), len(found), decontaminate.item_digest(list(found)), bool(hit)))
    return Counter(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(25)] + [(25, None), (26, "w1, W2"), (27, "w3"), (3, "w4 w5 w6 w7 w8 w9 w10 w11 w0 w1 w2"), (None, "épsilon next of the")]
    docs = [(i, None if i == 0 else " ".join([*rng.choices(words, k=rng.randint(0, 60)), *(items[rng.randrange(25)][1] or "").split(), *rng.choices(words, k=5)])) for i in range(60)]
    docs += [(x[0], x[1]) for x in rows() if len(x[1] or "") < 5000]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (decontaminate.BLOCK_BYTES, 400):  # one pass, and one pass a block
        assert Counter(map(tuple, decontaminate.report(d, b, block_bytes=size).collect())) == want


def test_empty_and_clean(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty(spark), b).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(documents(spark), b).collect())
