from __future__ import annotations

import itertools
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty  # noqa: E402

from docloom.llm import jaccard_join  # noqa: E402
from docloom.llm.components import components  # noqa: E402
from docloom.llm.wordhash import words_of  # noqa: E402


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets, n, root = [shingles(t) for _, t in docs], Counter(), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            n[a] += 1
            n[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return Counter((docs[i][0], docs[find(i)][0], n[i]) for i in range(len(docs)))


@pytest.mark.parametrize("small", [1024, 6])
def test_against_brute_force(spark, small):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base, line = [rng.choices(words, k=60) for _ in range(3)], rng.choices(words, k=12)
    docs = [(0, None), (1, ""), (2, "one"), (3, "one two"), (4, "One!")]
    for i in range(5, 85):
        b = list(base[i % 3]) if i < 55 else rng.choices(words, k=rng.randint(5, 40))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice(words)
        docs.append((i, " ".join((line if i % 3 == 0 else []) + b)))
    docs += [(100 + i, docs[10 + i][1]) for i in range(4)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard_join.report(d, small=small).collect())) == brute(docs)


def test_edge_rows(spark):
    d = documents(spark)
    assert jaccard_join.report(d).count() == d.count() and jaccard_join.report(empty(spark)).count() == 0
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[12] == 1 and ids[50] == 0 and ids[51] == 0 and ids[15] == 1 and ids[None] == 1 and ids[0] == ids[1] == ids[8] == 1
    assert jaccard_join.keep_one(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = list(range(140))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_recall_on_many_near_copies(spark):
    """1,000 groups of near copies around the threshold: links and classes equal those of all pairs of a group."""
    rng = random.Random(11)
    docs, groups = [], []
    for g in range(1000):
        base = [f"w{rng.randint(0, 30_000)}" for _ in range(rng.randint(12, 90))]
        group = [base]
        for _ in range(2):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 30_000)}"
            group.append(w)
        groups.append(range(len(docs), len(docs) + 3))
        docs += group
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in docs]
    links, want = [0] * len(docs), 0
    for ids in groups:
        for i in ids:
            for j in ids:
                if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    links[i] += 1
                    want += 1
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_links for r in jaccard_join.report(d).collect()}
    assert want > 2000 and all(got[i] <= links[i] for i in got)
    assert sum(got.values()) / want > 0.999
