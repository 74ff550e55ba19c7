from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, rows  # noqa: E402

from docloom.llm import deep_shallow, suffix_dedup  # noqa: E402


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raws, strict=True):
        gone, end = bytearray(len(r)), 0
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[max(i, end) : i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_sort():
    rng = random.Random(1)
    for _ in range(100):
        s = list({bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 40))})
        assert [s[i] for i in deep_shallow.deep_shallow_order(s, 0, 3)] == sorted(s)
        m = deep_shallow.common_prefixes([*s, s[0]])
        assert all(m[i, j] == deep_shallow.lcp(a, b) for i, a in enumerate([*s, s[0]]) for j, b in enumerate([*s, s[0]]))


@pytest.mark.parametrize(("length", "gram", "most"), [(40, 10, 512), (40, 10, 3)])
def test_against_brute_force(spark, length, gram, most):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    parts = [text(rng.randint(20, 90)) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "x" * 150), (3, "ab" * 60)] + [(i, text(rng.randint(0, 80)) + rng.choice(parts)[rng.randint(0, 9) :] + text(30) + rng.choice(parts)) for i in range(4, 90)]
    docs += docs[5:9]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(d, length=length, gram=gram, most=most).collect())) == brute(docs, length)


def test_production_length(spark):
    docs = [(x[0], x[1]) for x in rows() if len(x[1] or "") < 5000]
    d = documents(spark).where("coalesce(length(text), 0) < 5000")
    assert Counter(map(tuple, suffix_dedup.remove_repeats(d).collect())) == brute(docs, 400)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def covered(docs, length):
    """Bytes and runs of each text in strings of ``length`` bytes that stand elsewhere too."""
    return {d: (gone, runs) for d, _, gone, runs, _ in brute(docs, length)}


@pytest.mark.parametrize("most", [512, 3])
def test_passages(spark, most):
    """The shorter length is judged from the same order; the removal stays as it is."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    parts = [text(rng.randint(22, 60)) for _ in range(8)]
    docs = [(i, text(rng.randint(0, 50)) + rng.choice(parts) + text(rng.randint(1, 9)) + rng.choice(parts)[3:]) for i in range(70)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(d, length=40, gram=8, most=most, passage=24).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(docs, 40)
    assert {r.doc_id: (r.n_passage_bytes, r.n_passages) for r in got} == covered(docs, 24)


def test_long_text_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = random.Random(4)
    raw = np.frombuffer("".join(rng.choices("abcd", k=900)).encode() + b"z" * 300, np.uint8)
    whole = [tuple(x.tolist()) for x in suffix_dedup.anchors_of(raw, np.array([0, len(raw)]), 24, 8, 40)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 37)
    parts = list(zip(*suffix_dedup.text_anchors(raw, np.array([0, len(raw)]), 24, 8, 40), strict=True))
    assert [tuple(np.concatenate(x).tolist()) for x in parts] == whole


def test_copies_cost_nothing(spark, monkeypatch):
    """Places and ranges of a text do not grow with its copies."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh", k=3000))
    near = text[:1500] + "#" + text[1501:]
    sizes = []
    for copies in (10, 200):
        docs = [(i, text) for i in range(copies)] + [(1000, near)]
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        written = {}
        keep = suffix_dedup.Scratch.__call__

        def counted(self, df, name, written=written, keep=keep):
            out = keep(self, df, name)
            written[name] = out.count()
            return out

        monkeypatch.setattr(suffix_dedup.Scratch, "__call__", counted)
        assert Counter(map(tuple, suffix_dedup.remove_repeats(d).collect())) == brute(docs, 400)
        monkeypatch.setattr(suffix_dedup.Scratch, "__call__", keep)
        sizes.append(written)
    assert sizes[0] == sizes[1]


def test_sorted_rows_of_prefixes():
    rng = random.Random(6)
    s = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(50)]
    p = deep_shallow.Prefixes(s)
    assert all(p.row(i).tolist() == [deep_shallow.lcp(a, b) for b in s] for i, a in enumerate(s))
