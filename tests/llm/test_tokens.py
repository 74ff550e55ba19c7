from __future__ import annotations

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, rows, texts  # noqa: E402

from docloom.llm import encode, token_count, token_store  # noqa: E402
from docloom.llm.perfect_hash import PerfectHash  # noqa: E402


def test_encoder_equals_library():
    e = encode.CachedEncoder(words=50)
    rng = random.Random(3)
    many = texts() + ["".join(rng.choice(" \n\t,.'ab é中1a  's “") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(many, e.encode(pa.array(many, pa.string())), strict=True):
        assert ids.tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        h = PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys))) and h.n == len(keys)
        assert (PerfectHash.load(h.arrays()).slots(keys) == h.slots(keys)).all()


def expected():
    e = encode.encoder()
    order = sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0))
    out, start = [], 0
    for x in order:
        ids = [*e.whole.encode(x[1] or "", add_special_tokens=False).ids, 2]
        out.append((x[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store(spark):
    got = token_store.store_and_read(documents(spark)).collect()
    want = expected()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((a, c, d) for a, _, c, d in want)
    assert sorted(r.start for r in got) == sorted(b for _, b, _, _ in want)
    unique = Counter(x[0] for x in rows())
    assert {(r.doc_id, r.start) for r in got if unique[r.doc_id] == 1} == {(a, b) for a, b, _, _ in want if unique[a] == 1}
    assert token_store.store_and_read(empty(spark)).count() == 0


def test_lookup(spark):
    shards = token_store.write_store(documents(spark)).collect()
    e = encode.encoder()
    found = {k: [ids for s in shards for ids in token_store.Shard(s.path, s.dtype).get(k)] for k in (10, 15, None, 999_999)}
    whole = lambda k: sorted(e.whole.encode(x[1] or "", add_special_tokens=False).ids for x in rows() if x[0] == k)
    assert all(sorted(found[k]) == whole(k) for k in found) and len(found[15]) == 2 and found[999_999] == []


def test_counts(spark):
    e = encode.encoder(specials_as_text=True)
    got = Counter((r.doc_id, r.n_tokens, r.closed) for r in token_count.count_tokens(documents(spark)).collect())
    assert got == Counter((x[0], len(e.whole.encode(x[1] or "", add_special_tokens=False).ids), True) for x in rows())
    assert token_count.count_tokens(empty(spark)).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 8, 8], "<u2")
    ids.tofile(tmp_path / "f.ids")
    f = spark.createDataFrame([(f"file://{tmp_path}/f.ids", "<u2", len(ids))], "file string, dtype string, n_ids long")
    for block in (1, 2, 3, 5, 100):
        got = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in token_count.scan_separators(f, separator=9, block_ids=block).collect())
        assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 7, True), (3, 11, 2, False)]


def test_long_texts_with_odd_spacing():
    """Such texts go to the library in parts; the ids are those of the whole."""
    rng = random.Random(5)
    many = [" ".join(rng.choice(["word", "x1", "Été", "don't", "a  b", "end.\n\n", "\tz"]) for _ in range(40_000)), "a\t" + "b" * 200_000, "x  y" + "é" * 100_000 + " a b"]
    e = encode.CachedEncoder()
    for t, ids in zip(many, e.encode(pa.array(many)), strict=True):
        assert ids.tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_cache_is_bounded():
    e = encode.CachedEncoder(words=2000)
    for i in range(40):
        t = " ".join(f"w{i}x{j}" for j in range(1000))
        assert e.encode(pa.array([t]))[0].tolist() == e.whole.encode(t, add_special_tokens=False).ids
        assert len(e.young) <= 2000 and len(e.old) <= 2000 and len(e.fresh) <= 1000


def test_lookup_opens_only_fitting_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 3, f"text {i} " * 20) for i in range(900)], "doc_id long, text string")
    shards = token_store.write_store(docs, shard_bytes=20_000)
    assert shards.count() > 4
    from docloom.llm import token_read

    opened = []

    class Counted(token_read.Shard):
        def __init__(self, path, dtype):
            opened.append(path)
            super().__init__(path, dtype)

    monkeypatch.setattr(token_read, "Shard", Counted)
    e = encode.encoder()
    for k in (0, 17, 299):
        opened.clear()
        got = token_store.lookup(shards, k)
        assert sorted(got) == sorted(e.whole.encode(f"text {i} " * 20, add_special_tokens=False).ids for i in range(3 * k, 3 * k + 3)) and len(opened) <= 2
    assert token_store.lookup(shards, 300) == [] and token_store.lookup(shards, None) == []


def test_one_key_in_many_shards(spark):
    """A key with all rows, of equal texts too, is spread over shards and found whole."""
    docs = spark.createDataFrame([(7, "same words again and again " * 10)] * 400, "doc_id long, text string").repartition(4)
    shards = token_store.write_store(docs, shard_bytes=20_000)
    assert shards.count() > 1 and len(token_store.lookup(shards, 7)) == 400


def test_foreign_fingerprint_is_refused(spark):
    """A key whose hash meets another's slot and fingerprint gets nothing."""
    s = token_store.write_store(spark.createDataFrame([(1, "one")], "doc_id long, text string")).first()
    shard = token_store.Shard(s.path, s.dtype)
    shard.fp[:] = token_store.fingerprints(token_store.key_hashes(pa.array([2])))
    assert shard.get(2) == []
