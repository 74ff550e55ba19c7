"""CSV files to rows: encoding, delimiter, structure check. Fields may be quoted, of any length, and hold line breaks.

Spark's own decoder has no GB18030, so a file's bytes are decoded and read in one task, which gives its records a few at a
time; the checks are built-in expressions.
"""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.tables import normalise_headers

SAMPLE = 8192
DELIMITERS = (",", ";", "\t", "|")


RECORDS = "source_path string, row_number int, values array<string>, decoded boolean"


def decode(data: bytes | None, encoding: str | None = None) -> str | None:
    """UTF-8 (with or without mark), else GB18030, both strict; None if neither decodes. A named encoding is the only one tried."""
    for name in [codecs.lookup(encoding).name] if encoding else ["utf-8-sig", "gb18030"]:
        try:
            return bytes(data).decode(name)
        except (UnicodeDecodeError, TypeError):
            continue
    return None


def sniff(text: str) -> str:
    """The delimiter that is in the first line most often; comma on ties and where there is none."""
    head = (text[:SAMPLE].splitlines() or [""])[0]
    return max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))


def records(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """RECORDS of each file: a record's number is that of its first line; blank lines are no records. A file that does not
    decode gives one row with ``decoded`` false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        schema = pa.schema([("source_path", pa.string()), ("row_number", pa.int32()), ("values", pa.list_(pa.string())), ("decoded", pa.bool_())])
        for b in batches:
            for i in range(b.num_rows):
                path, text = b.column(0)[i].as_py(), decode(b.column(1)[i].as_py(), encoding)
                if text is None:
                    yield pa.RecordBatch.from_pylist([{"source_path": path, "decoded": False}], schema)
                    continue
                reader, held, line = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text)), [], 0
                for values in reader:
                    if values:
                        held.append({"source_path": path, "row_number": line + 1, "values": values, "decoded": True})
                    line = reader.line_num
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("source_path", "content").mapInArrow(run, RECORDS)


def csv_rows(files: DataFrame, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (source_path, columns, row_number from 2, values) and rejects (source_path, code, row_number, expected, actual).

    A file with a row of another width than its header is rejected as a whole, and reported with its first such row.
    """
    x = records(files.where(F.col("suffix") == ".csv"), encoding)
    rows = x.where("decoded").select("source_path", "row_number", "values")
    heads = rows.where("row_number = 1").select("source_path", normalise_headers(F.col("values")).alias("columns"))
    rows = rows.where("row_number > 1").join(heads, "source_path")
    bad = rows.where(F.size("values") != F.size("columns")).groupBy("source_path").agg(F.min(F.struct("row_number", F.size("columns").alias("expected"), F.size("values").alias("actual"))).alias("b"))
    rejects = bad.select("source_path", F.lit("structure").alias("code"), "b.row_number", "b.expected", "b.actual")
    unread = x.where("NOT decoded").select("source_path", F.lit("encoding").alias("code"), F.lit(None).cast("int").alias("row_number"), F.lit(None).cast("int").alias("expected"), F.lit(None).cast("int").alias("actual"))
    return rows.join(bad.select("source_path"), "source_path", "left_anti").select("source_path", "columns", "row_number", "values"), rejects.unionByName(unread)


def cells_of(rows: DataFrame) -> DataFrame:
    """One row a record with a map from column to text, as the computations take them."""
    name = F.element_at(F.split("source_path", "/"), -1)
    return rows.select("source_path", name.alias("filename"), name.alias("sheet"), "row_number", F.map_from_arrays("columns", F.transform("values", T.strip)).alias("cells"))
