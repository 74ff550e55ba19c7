"""Reading a token store. Needs neither the tokenizer nor the encoder, which keeps reading workers small."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.perfect_hash import PerfectHash, unpack
from docloom.llm.storage import open_fs
from docloom.llm.wordhash import mix, segment_hashes, string_buffers
from docloom.llm.worker import lean

READ_IDS = 1 << 18


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each key's text; a null key is hashed as one byte that no UTF-8 text holds."""
    text = keys.cast(pa.string())
    raw, off = string_buffers(text)
    h = segment_hashes(raw, off[:-1], np.diff(off))
    h[np.asarray(pc.is_null(text))] = segment_hashes(np.array([255], np.uint8), np.array([0]), np.array([1]))[0]
    return h


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard's index, and access to its payload."""

    def __init__(self, path: str, dtype: str):
        self.files, at = open_fs(path)
        self.payload, self.dtype = f"{at}.ids", np.dtype(dtype)
        with self.files.open_input_file(f"{at}.idx") as f:
            a = unpack(f.read())
        self.mph = PerfectHash.load(a)
        self.fp, self.first, self.count, self.offsets = a["fp"], a["first"], a["count"], a["offsets"]
        self.keys = pa.ipc.open_stream(pa.py_buffer(a["keys"].tobytes())).read_all().column("key").combine_chunks()

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 where the store has no such key."""
        h = key_hashes(keys)
        slot = self.mph.slots(h)
        ok = slot >= 0
        ok[ok] = self.fp[slot[ok]] == fingerprints(h[ok])
        first, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        first[ok], count[ok] = self.first[slot[ok]], self.count[slot[ok]]
        # a fingerprint has 32 bits: the stored key has the last word
        hit = np.flatnonzero(first >= 0)
        stored, asked = self.keys.take(pa.array(first[hit])), keys.take(pa.array(hit))
        same = np.asarray(pc.fill_null(pc.equal(stored, asked), False)) | (np.asarray(pc.is_null(stored)) & np.asarray(pc.is_null(asked)))
        first[hit[~same]], count[hit[~same]] = -1, 0
        return first, count

    def ids(self, file, a: int, b: int) -> np.ndarray:
        """Ids from token a to token b of the shard."""
        file.seek(a * self.dtype.itemsize)
        return np.frombuffer(file.read((b - a) * self.dtype.itemsize), self.dtype)

    def get(self, key) -> list[list[int]]:
        """The id arrays of all records of a key, without their end ids."""
        first, count = self.find(pa.array([key], self.keys.type))
        with self.files.open_input_file(self.payload) as f:
            return [self.ids(f, int(self.offsets[r]), int(self.offsets[r + 1]) - 1).tolist() for r in range(int(first[0]), int(first[0] + count[0]))]


def lookup(shards: DataFrame, key) -> list[list[int]]:
    """The id arrays of all records of ``key``. Opens only shards whose key range has it."""
    if key is None:
        at = shards.where("first_key IS NULL")
    else:
        at = shards.where((F.col("first_key").isNull() | (F.col("first_key") <= F.lit(key))) & (F.col("last_key") >= F.lit(key)))
    return [ids for s in at.select("path", "dtype", "part").orderBy("part").toLocalIterator() for ids in Shard(s.path, s.dtype).get(key)]


def read_store(spark: SparkSession, shards: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Every document of the store, read back through the index: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, dtype, start in zip(b.column("path").to_pylist(), b.column("dtype").to_pylist(), b.column("start").to_pylist(), strict=True):
                yield from records(Shard(path, dtype), start)

    def records(s: Shard, start: int) -> Iterator[pa.RecordBatch]:
        h = key_hashes(s.keys)
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        first, count = s.find(s.keys.take(pa.array(head)))
        if (first < 0).any() or int(count.sum()) != len(s.keys):
            raise ValueError(f"{s.payload}: the index does not match its records")
        order = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        with s.files.open_input_file(s.payload) as f:
            i = 0
            while i < len(order):
                j = max(i + 1, int(np.searchsorted(s.offsets, s.offsets[order[i]] + READ_IDS, side="right")) - 1)
                j = min(j, len(order))
                lo, hi = int(s.offsets[order[i]]), int(s.offsets[order[j - 1] + 1])
                ids = s.ids(f, lo, hi).astype("<u4")
                a, z = s.offsets[order[i:j]], s.offsets[order[i:j] + 1]
                crc = [zlib.crc32(ids[p - lo : q - lo]) for p, q in zip(a.tolist(), z.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([s.keys.take(pa.array(order[i:j])), pa.array(a + start), pa.array(z - a), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                i = j

    spread = shards.select("part", "path", "dtype", "start").repartitionByRange(n, "part")
    return spread.mapInArrow(lean(run), f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")
