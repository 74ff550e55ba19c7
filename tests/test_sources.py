"""File sources on files written by the test."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from docloom.sources import csv_source, files, sinks, xlsx_source
from docloom.streaming import incremental

BOOK = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="预算明细" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>部门</t></si><si><t>研发部</t></si></sst>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="165" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="2"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>日期</t></is></c><c r="C1" t="str"><v>完成率</v></c><c r="D1" t="str"><v>预算</v></c><c r="E1" t="str"><v>翻倍</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>46236</v></c><c r="C2" s="2"><v>0.125</v></c><c r="D2" s="3"><v>1234.5</v></c><c r="E2" s="3"><f>D2*2</f><v>2469</v></c></row>'
    '<row r="3"><c r="A3"/></row><row r="4"><c r="A4" t="b"><v>1</v></c><c r="E4"><f>D4*2</f></c></row>'
    '</sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>',
}


def make(tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        for name, data in BOOK.items():
            z.writestr(name, data)
    (tmp_path / "a.csv").write_bytes("﻿部门;预算\n研发部;\"1;0\"\n".encode())
    (tmp_path / "b.csv").write_bytes("部门\t预算\n销售部\t20\n".encode("gb18030"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "latin.csv").write_bytes(b"a,b\n\xe9\xff\xfe,2\n")
    (tmp_path / "n.md").write_bytes(b"\xef\xbb\xbf# Title\nx\xff y\n")
    (tmp_path / "skip.bin").write_text("no")
    return str(tmp_path)


def test_scan_text_csv(spark, tmp_path):
    f = files.scan_directory(spark, make(tmp_path))
    assert {r.source_path for r in f.collect()} == {"book.xlsx", "a.csv", "b.csv", "bad.csv", "latin.csv", "n.md"}
    assert [r.content for r in files.text_file_nodes(f).collect()] == ["# Title\nx y"]
    rows, rejects = csv_source.csv_rows(f)
    got = {r.source_path: r.cells for r in csv_source.cells_of(rows).collect()}
    assert got == {"a.csv": {"部门": "研发部", "预算": "1;0"}, "b.csv": {"部门": "销售部", "预算": "20"}}
    bad = {r.source_path: (r.code, r.row_number, r.expected, r.actual) for r in rejects.collect()}
    assert bad == {"bad.csv": ("structure", 3, 2, 1), "latin.csv": ("encoding", None, None, None)}


def test_workbook(spark, tmp_path):
    f = files.scan_directory(spark, make(tmp_path))
    rows = xlsx_source.read_workbooks(f)
    got = {r.row_number: r for r in rows.collect()}
    assert sorted(got) == [1, 2, 4] and got[2]["values"] == ["研发部", "2026-08-02", "12.5%", "1234.50", "2469.00（公式 =D2*2）"]
    assert got[4]["values"] == ["TRUE", "", "", "", "[公式无缓存值: =D4*2]"] and got[2].merged == ["A3:B3"] and got[2].kinds[1:4] == ["date", "percentage", "number"]
    assert xlsx_source.sheet_rows(rows).where("row_number = 2").first()["cells"]["预算"] == "1234.50"
    assert xlsx_source.workbook_summary(rows).first()["sheet_count"] == 1


def test_records_and_traces(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{bad\n')
    assert sum(r._corrupt_record is not None for r in files.read_records(spark, str(tmp_path / "r.jsonl"), "a int", strict=False).collect()) == 1
    hits = spark.createDataFrame([(1, 1, 0.5, "x  y")], "query_id int, rank int, score double, content string")
    ans = spark.createDataFrame([(1, "ok")], "query_id int, answer string")
    sinks.write_json(sinks.traces(hits, ans), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first()["hits"][0]["preview"] == "x y"


def test_streams(spark, tmp_path, sf_dir):
    src = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).write.parquet(str(tmp_path / "in/c"))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = incremental.conversation_state(s).writeStream.format("memory").queryName("conv").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = spark.read.parquet(src).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("conv").join(want, "conv_id").where("message_count <> n").count() == 0 and spark.table("conv").count() == want.count()
    d = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], "source_path string, text string, seen int")
    d.write.parquet(str(tmp_path / "in2/x"))
    t = spark.readStream.schema(d.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in2"))
    incremental.upsert_documents(t, str(tmp_path / "ix"), str(tmp_path / "ck2")).awaitTermination(60)
    from docloom.operators.index import VersionedIndex

    assert {(r.source_path, r.text) for r in VersionedIndex(spark, str(tmp_path / "ix")).read("documents").collect()} == {("a", "2"), ("b", "1")}


def test_csv_long_fields_and_line_breaks(spark, tmp_path):
    long = "x" * 1_500_000
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n\n2,"two\nlines, ""quoted"""\n3,\x01\n')
    rows, rejects = csv_source.csv_rows(files.scan_directory(spark, str(tmp_path)))
    got = {r.row_number: r["values"] for r in rows.collect()}
    assert got == {2: ["1", long], 4: ["2", 'two\nlines, "quoted"'], 6: ["3", "\x01"]} and rejects.count() == 0


def test_optional_decimals():
    assert xlsx_source.rendered(1.25, "0.0#") == ("1.25", "number") and xlsx_source.rendered(1.256, "0.##") == ("1.26", "number")
    assert xlsx_source.decimals("0;0.000") == 0
