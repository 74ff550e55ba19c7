"""Directory scans. Files come as rows of path, bytes, size, time and digest; formats split by suffix.

Text and CSV stay in built-in expressions; workbooks go through one Arrow function, a file a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.chunking import text_nodes

SUFFIXES = (".md", ".txt", ".pdf", ".csv", ".xlsx")


def scan_directory(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Supported files below ``path``: source_path (relative to ``root``), suffix, content, source_size, modified, sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + (root or path).split(":", 1)[-1].strip("/") + "/"
    out = files.withColumn("source_path", T.source_path(F.when(F.startswith(name, F.lit(base)), F.substring(name, len(base) + 1, 1 << 20)).otherwise(F.element_at(F.split(name, "/"), -1))))
    out = out.withColumn("suffix", T.suffix_of(F.col("source_path"))).where(F.col("suffix").isin(*SUFFIXES))
    return out.select("source_path", "suffix", "content", F.col("length").alias("source_size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def decode_text(content: Column) -> Column:
    """UTF-8 with invalid bytes dropped and no byte order mark."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", ""), "^﻿", "")


def text_file_nodes(files: DataFrame) -> DataFrame:
    """Nodes of text and Markdown files."""
    x = files.where(F.col("suffix").isin(".md", ".txt")).withColumn("text", decode_text(F.col("content")))
    return x.select(T.document_id("source_path").alias("document_id"), "source_path", F.posexplode(text_nodes("text")).alias("sequence", "content"), F.lit("text").alias("node_type"))


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a schema; strict reading fails on a corrupt line, else it lands in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def unsupported(files: DataFrame) -> DataFrame:
    """PDF bytes cannot be parsed here; positioned lines (operators.layout) take their place."""
    return files.where(F.col("suffix") == ".pdf").select("source_path", F.lit("no PDF reader; supply positioned lines").alias("reason"))
