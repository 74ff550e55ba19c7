"""Token counts by separator scan over flat, unindexed token files.

A file is a run of ids with an end-of-document id after each document and nothing else. Blocks of every file are searched
for that id in parallel; a prefix scan over block summaries (separators so far, place of the last one) then stitches
documents that run over block edges.

Defined results: an empty document has 0 tokens; ids after a file's last separator form an open document (``closed`` is
false); null text counts as empty; an empty file or table gives no rows; repeated rows are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import encode
from docloom.llm.storage import materialise, new_folder, open_fs, remove
from docloom.llm.worker import lean

SEPARATOR = 50256
BLOCK_IDS = 1 << 20


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = encode.DEFAULT, separator: int = SEPARATOR, folder: str | None = None) -> DataFrame:
    """One flat file per task. Returns file, dtype, ordinal and doc_id for each document, and a row of ordinal -1 with the file's length."""
    folder = folder or new_folder(docs.sparkSession, "flat")
    dtype = encode.id_dtype(tokenizer)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(folder)
        path, out, done, total = f"{uuid.uuid4().hex}.ids", None, 0, 0
        end = np.array([separator], dtype)
        with encode.task_encoder(tokenizer, specials_as_text=True, dtype=dtype) as enc:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{path}")
                for part in enc.parts(b.column(1)):
                    ids = np.concatenate([x for d in part for x in (d, end)])
                    out.write(ids.tobytes())
                    total += len(ids)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"] * n), pa.array([dtype] * n), pa.array(np.arange(done, done + n)), b.column(0), pa.array([0] * n, pa.int64())], names=["file", "dtype", "ordinal", "doc_id", "n_ids"])
                done += n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([dtype]), pa.array([-1], pa.int64()), pa.nulls(1, b.column(0).type), pa.array([total], pa.int64())], names=["file", "dtype", "ordinal", "doc_id", "n_ids"])

    return materialise(src.mapInArrow(lean(run), f"file string, dtype string, ordinal long, doc_id {kind}, n_ids long"), "flat-documents")


def scan_separators(files: DataFrame, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``files`` has file, dtype and n_ids. Returns file, ordinal, start, n_tokens, closed for each document."""
    blocks = (
        files.where("n_ids > 0")
        .select("file", "dtype", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block_ids))).alias("block"))
        .repartition("file", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, dtype, n, block in zip(*(b.column(c).to_pylist() for c in ("file", "dtype", "n_ids", "block")), strict=True):
                source, path = open_fs(file)
                with source.open_input_file(path) as f:
                    size = np.dtype(dtype).itemsize
                    f.seek(block * block_ids * size)
                    ids = np.frombuffer(f.read(min(block_ids, n - block * block_ids) * size), dtype)
                found = np.flatnonzero(ids == separator) + block * block_ids
                # one row a separator, and before them the block's summary: how many, and where the last one is
                i = np.arange(-1, len(found))
                end = np.append(found[-1:] if len(found) else [-1], found).astype(np.int64)
                prior = np.concatenate([[len(found)], [-1] * min(1, len(found)), found[:-1]]).astype(np.int64)
                k = len(i)
                cols = [pa.array([file] * k), pa.array(np.full(k, block, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(i), pa.array(end), pa.array(prior)]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "block", "n_ids", "i", "end", "prior"])

    seen = materialise(blocks.mapInArrow(lean(run), "file string, block long, n_ids long, i long, end long, prior long"), "separators")
    # prefix scan over summaries of a few bytes a block
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = seen.where("i < 0").select("file", "block", "n_ids", F.col("prior").alias("n"), F.col("end").alias("last"))
    carry = sums.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("done"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carried"))
    closed = (
        seen.where("i >= 0")
        .join(carry, ["file", "block"])
        .select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.when(F.col("i") == 0, F.col("carried")).otherwise(F.col("prior")) + 1).alias("start"), "end")
        .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    ends = sums.groupBy("file").agg(F.max("n_ids").alias("n_ids"), F.sum("n").alias("ordinal"), F.max("last").alias("last"))
    tail = ends.where("last + 1 < n_ids").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n_ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = encode.DEFAULT) -> DataFrame:
    """Writes the documents flat, scans the files, and gives each document its count: doc_id, n_tokens, closed."""
    folder = new_folder(docs.sparkSession, "flat")
    written = write_flat(docs, id_col, text_col, tokenizer, folder=folder)
    counted = scan_separators(written.where("ordinal < 0"))
    remove(docs.sparkSession, folder)  # the scan is done and written
    return written.where("ordinal >= 0").select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "closed")
