"""Token-ID output: raw id payloads with a minimal perfect hash index for constant-time access by key.

Documents are ordered by key over range partitions; each task writes one shard: ``*.ids``, the flat little-endian ids
(16 bits where the vocabulary allows, else 32), and ``*.idx``, which has the token offsets, the keys, and a minimal perfect
hash from key to (fingerprint, first record, number of records). The table of shards has each shard's first and last key, so
a lookup opens the shards that can hold the key and no other; it lists only files of tasks that succeeded, so repeated or
speculative attempts leave no trace in results. The number of shards follows from bytes and rows.

Defined results: null text counts as empty (its end id is still written); a null key sorts first and is looked up as None;
rows that share a key are neighbours, ordered by a hash of their text; where they are too many for a shard they go on in the
next one, and a lookup finds all; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import encode
from docloom.llm.perfect_hash import PerfectHash, pack
from docloom.llm.storage import materialise, new_folder, open_fs
from docloom.llm.token_read import Shard, fingerprints, key_hashes, lookup, read_store
from docloom.llm.worker import lean

__all__ = ["Shard", "lookup", "read_store", "store_and_read", "write_store"]

END_ID = 2
#: text bytes and rows of a shard
SHARD_BYTES, SHARD_ROWS = 48 << 20, 500_000


def _index(keys: pa.Array, sizes: np.ndarray) -> bytes:
    h = key_hashes(keys)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    mph = PerfectHash.build(h[head])
    slot = mph.slots(h[head])
    fp, first, count = np.zeros(mph.n, np.uint32), np.zeros(mph.n, np.int64), np.zeros(mph.n, np.int64)
    fp[slot], first[slot], count[slot] = fingerprints(h[head]), head, np.diff(np.append(head, len(h)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    return pack(mph.arrays() | {"fp": fp, "first": first, "count": count, "offsets": offsets, "keys": np.frombuffer(sink.getvalue(), np.uint8)})


def write_store(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", tokenizer: str = encode.DEFAULT, end_id: int = END_ID, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and returns their table: part, path, dtype, n_docs, n_tokens, first_key, last_key, and start, the ids in
    shards before."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    dtype = encode.id_dtype(tokenizer)
    src = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    size = src.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_shards = max(1, math.ceil(size.bytes / shard_bytes), math.ceil(size.rows / SHARD_ROWS))
    # rows of one key may be many: the hash of the text, and for equal texts the place they come from, spread them
    src = src.withColumn("h", F.xxhash64("text")).withColumn("p", F.spark_partition_id()).repartitionByRange(n_shards, "key", "h", "p").sortWithinPartitions("key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = open_fs(folder)
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        keys, sizes, out = [], [], None
        end = np.array([end_id], dtype)
        with encode.task_encoder(tokenizer, dtype=dtype) as enc:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}.ids")
                for ids in enc.parts(b.column(1)):
                    out.write(np.concatenate([x for d in ids for x in (d, end)]).tobytes())
                    sizes.append(np.fromiter((len(d) + 1 for d in ids), np.int64, len(ids)))
                keys.append(b.column(0).take(pa.array(np.arange(b.num_rows))))  # a copy: a column holds its whole batch, texts and all
        if out is None:
            return
        out.close()
        n, keys = np.concatenate(sizes), pa.chunked_array(keys).combine_chunks()
        with files.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(_index(keys, n))
        one = [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([dtype]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), keys.slice(0, 1), keys.slice(len(keys) - 1)]
        yield pa.RecordBatch.from_arrays(one, names=["part", "path", "dtype", "n_docs", "n_tokens", "first_key", "last_key"])

    schema = f"part int, path string, dtype string, n_docs long, n_tokens long, first_key {kind}, last_key {kind}"
    shards = materialise(src.select("key", "text").mapInArrow(lean(run), schema), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def store_and_read(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    shards = materialise(write_store(docs, key_col, text_col, **kw), "token-index")
    return read_store(docs.sparkSession, shards, docs.schema[key_col].dataType.simpleString())
