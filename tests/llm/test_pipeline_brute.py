"""The pipeline's rows against brute force: the classifier's verdicts are given, all after them is plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from test_mixing import water  # noqa: E402

from docloom.llm import cotrain  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def one_of_near_copies(docs):
    sets = {}
    for d, t, _ in docs:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [x for x in docs if find(x[0]) == x[0]]


def clean(docs, items):
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[i : i + n]))
    return [x for x in docs if not any(tuple(w[i : i + n]) in own for w in [words(x[1])] for n, own in windows.items() for i in range(len(w) - n + 1))]


def mixed(docs):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    total = defaultdict(int)
    for d, _, s in docs:
        total[s] += size[d]
    target, out = water(dict(total)), []
    for s in total:
        own = []
        for d, t, source in docs:
            if source == s:
                q = max(0.1, 1 - 5 * len(re.findall(r"[#*$%&|<>!]", t or "")) / max(len(t or ""), 1)) * (1.0 if size[d] >= 20 else 0.5)
                u = (int(hashlib.sha256(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / q, d, t))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        for _, d, t in sorted(own, key=lambda x: x[:2]):
            out += [(d, t)] * (epochs + (before + size[d] / 2 <= rest))
            before += size[d]
    return out


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in cotrain.report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    rows = mixed(clean(one_of_near_copies(rows), [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]))
    tokenizer, want, start, starts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), 0, []
    for d, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        starts.append(start)
        start += len(ids)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and len(rows) > 50
    assert sorted(r.start for r in got) == starts
