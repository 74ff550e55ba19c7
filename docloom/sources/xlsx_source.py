"""XLSX workbooks by the standard library: one Arrow function turns a file's bytes into cell rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.tables import normalise_headers

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: built-in number formats of the file format that are dates or times, percentages, or have two decimals
DATES, TIMES, MOMENTS = {14, 15, 16, 17}, {18, 19, 20, 21, 45, 46, 47}, {22}
PERCENT = {9: "0%", 10: "0.00%"}
FIXED = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00"}
SCHEMA = "source_path string, sheet string, sheet_no int, row_number int, values array<string>, kinds array<string>, formulas array<string>, merged array<string>"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def kind_of(code: str) -> str:
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    if "%" in plain:
        return "percentage"
    if re.search(r"[¥￥$€£]", code):
        return "currency"
    date, time = bool(re.search(r"[yd]", plain)), bool(re.search(r"[hs]", plain))
    return "datetime" if date and time else "date" if date else "time" if time else "number"


def decimals(code: str) -> int | None:
    """Decimal places of a format's first section, optional ones included."""
    first = code.split(";")[0]
    m = re.search(r"\.([0#]+)", first)
    return len(m[1]) if m else (0 if "0" in first else None)


def rendered(value: float, code: str) -> tuple[str, str]:
    """Text and kind of a number under its format."""
    kind = kind_of(code) if code else "number"
    if kind in ("date", "datetime", "time"):
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(value * 86400))
        return {"date": moment.date().isoformat(), "datetime": moment.isoformat(sep=" "), "time": moment.time().isoformat()}[kind], kind
    places = decimals(code) if code and code.lower() != "general" else None
    if kind == "percentage":
        return f"{value * 100:.{places or 0}f}%", kind
    if places:
        return f"{value:.{places}f}", kind
    return (str(int(value)) if value == int(value) else f"{value:.15g}"), kind


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in root.iter(f"{MAIN}si")]


def _formats(z: zipfile.ZipFile) -> list[str]:
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    builtin = PERCENT | FIXED | dict.fromkeys(DATES, "yyyy-mm-dd") | dict.fromkeys(TIMES, "hh:mm:ss") | dict.fromkeys(MOMENTS, "yyyy-mm-dd hh:mm")
    styles = root.find(f"{MAIN}cellXfs")
    return [own.get(i, builtin.get(i, "")) for i in (int(x.get("numFmtId", 0)) for x in (styles if styles is not None else []))]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[s.get(f"{REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _cell(c, shared: list[str], formats: list[str]) -> tuple[str, str, str | None]:
    """Text, kind and formula of a cell."""
    kind, v, f = c.get("t", "n"), c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
    formula = f"={f.text}" if f is not None and f.text else None
    raw = v.text if v is not None and v.text is not None else ""
    if kind == "inlineStr":
        text, sort = "".join(t.text or "" for t in c.iter(f"{MAIN}t")), "text"
    elif not raw:
        text, sort = "", "blank"
    elif kind == "s":
        text, sort = shared[int(raw)], "text"
    elif kind == "b":
        text, sort = ("TRUE" if raw == "1" else "FALSE"), "boolean"
    elif kind in ("str", "e", "d"):
        text, sort = raw, "text"
    else:
        style = int(c.get("s", 0))
        text, sort = rendered(float(raw), formats[style] if style < len(formats) else "")
    if formula:
        return (f"{text}（公式 {formula}）" if raw else f"[公式无缓存值: {formula}]"), "formula", formula
    return text, sort, None


def workbook_rows(data: bytes, source_path: str) -> Iterator[tuple]:
    """Rows of all sheets that hold anything; sheets stream through the XML parser."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared, formats = _shared(z), _formats(z)
        for number, (name, part) in enumerate(_sheets(z)):
            merged = re.findall(rb'<mergeCell\s[^>]*ref="([^"]+)"', z.read(part))
            merged = [m.decode() for m in merged]
            with z.open(part) as f:
                n = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{MAIN}row":
                        continue
                    n = int(row.get("r", n + 1))
                    cells: dict[int, tuple[str, str, str | None]] = {}
                    for c in row.iter(f"{MAIN}c"):
                        at = column_number(c.get("r")) if c.get("r") else len(cells) + 1
                        cells[at] = _cell(c, shared, formats)
                    row.clear()
                    if not any(x[0] for x in cells.values()):
                        continue
                    width = max(cells)
                    got = [cells.get(i, ("", "blank", None)) for i in range(1, width + 1)]
                    yield source_path, name, number, n, [x[0] for x in got], [x[1] for x in got], [x[2] for x in got if x[2]], merged


def read_workbooks(files: DataFrame) -> DataFrame:
    """``files`` has source_path, suffix and content. One row a non-blank sheet row; the first of a sheet is its header."""
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.string())] * 4]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("source_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows: list[tuple] = []
                for r in workbook_rows(data, path):
                    rows.append(r)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.where(F.col("suffix") == ".xlsx").select("source_path", "content").mapInArrow(run, SCHEMA)


def sheet_rows(rows: DataFrame) -> DataFrame:
    """Rows below each sheet's header: source_path, filename, sheet, row_number, columns, cells."""
    first = rows.groupBy("source_path", "sheet").agg(F.min("row_number").alias("head_row"), F.min_by("values", "row_number").alias("head"))
    x = rows.join(first, ["source_path", "sheet"]).where("row_number > head_row").withColumn("columns", normalise_headers(F.col("head")))
    padded = F.concat("values", F.array_repeat(F.lit(""), F.greatest(F.size("columns") - F.size("values"), F.lit(0))))
    return x.select("source_path", F.element_at(F.split("source_path", "/"), -1).alias("filename"), "sheet", "row_number", "columns", F.map_from_arrays("columns", F.slice(padded, 1, F.size("columns"))).alias("cells"))


def workbook_summary(rows: DataFrame) -> DataFrame:
    """One row a workbook: sheets, their rows and columns."""
    s = rows.groupBy("source_path", "sheet", "sheet_no").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("values")).alias("n_columns"), F.max(F.size("formulas") > 0).alias("has_formulas"), F.first("merged").alias("merged"))
    return s.groupBy("source_path").agg(F.count(F.lit(1)).alias("sheet_count"), F.array_sort(F.collect_list(F.struct("sheet_no", "sheet", "n_rows", "n_columns", "has_formulas", "merged"))).alias("sheets"))
