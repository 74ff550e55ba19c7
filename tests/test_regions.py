"""Regions of a page on small fixtures; the registered queries are held against SQL in test_bindings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import layout, regions

LINE = "doc long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, is_math boolean, page_height double, page_width double"


def lines(spark, rows, width=60.0):
    """Rows of (line_no, text, x0, y0[, is_math]) on page 1 of document 1."""
    full = [(1, 1, r[0], r[1], r[2], r[3], None if r[2] is None else r[2] + width, None if r[3] is None else r[3] + 12.0, 11.0, False, bool(r[4]) if len(r) > 4 else False, 800.0, 600.0) for r in rows]
    return spark.createDataFrame(full, LINE)


def test_text_layer(spark):
    d = spark.createDataFrame([(1, 1, "ab 12"), (1, 2, "--- c"), (2, 1, "资料正文"), (3, 1, None)], "doc long, page int, text string")
    assert sorted(map(tuple, regions.text_layer(d).collect())) == [(1, 5, 2, False), (2, 4, 1, True), (3, 0, 1, False)]


def test_lines_from_spans(spark):
    rows = [
        (1, 1, 0, 1, " world", 12.0, "Arial-Bold", False, 1.0, 2.0, 9.0, 8.0), (1, 1, 0, 0, "Hello", 10.0, "Arial", False, 1.0, 2.0, 9.0, 8.0), (1, 1, 1, 0, "  ", 10.0, None, None, 1.0, 9.0, 9.0, 12.0),
        (1, 1, 2, 0, "x y", 10.0, "CambriaMath", False, 1.0, 14.0, 9.0, 18.0), (1, 1, 3, 0, "% ", None, "CambriaMath", None, 1.0, 20.0, 9.0, 25.0),
    ]
    s = spark.createDataFrame(rows, "doc long, page int, line_no int, span_no int, text string, size double, font string, bold boolean, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.line_no, r.text, r.font_size, r.bold, r.is_math) for r in regions.lines_from_spans(s).collect())
    assert got == [(0, "Hello world", 12.0, True, False), (2, "x y", 10.0, False, True), (3, "%", 0.0, False, False)]


def test_rules_bound_a_table(spark):
    d = [(1, 1, "l", 50.0, y, 400.0, y + 1, 600.0) for y in (100.0, 101.5, 130.0, 220.0)] + [(1, 1, "l", 450.0, y, 590.0, y, 600.0) for y in (100.0, 150.0)] + [(1, 1, "l", 50.0, 60.0, 90.0, 60.0, 600.0), (1, 2, "re", 50.0, 60.0, 400.0, 90.0, 600.0)]
    draw = spark.createDataFrame(d, "doc long, page int, kind string, x0 double, y0 double, x1 double, y1 double, page_width double")
    found = regions.rule_regions(regions.horizontal_rules(draw))
    (r,) = found.collect()
    assert (r.page, r.x0, r.x1, r.rule_ys) == (1, 50.0, 400.0, [101.25, 130.5, 220.5])
    x = lines(spark, [(0, "Sample", 60.0, 108.0), (1, "Mass", 200.0, 109.0), (2, "a", 62.0, 140.0), (3, "1.5", 203.0, 141.0), (4, "b", 61.0, 170.0), (5, "outside", 60.0, 300.0), (6, None, None, None)])
    (t,) = regions.ruled_tables(x, found).collect()
    assert t.cells == [["Sample", "Mass"], ["a", "1.5"], ["b", ""]]
    pages = {r.page: r for r in regions.table_pages(x, found).collect()}
    assert pages[1].probe and pages[1].has_rules and not pages[1].has_caption


def test_running_mean_clusters(spark):
    """The mean of a cluster follows its members: 0, 5, 10 are two clusters at a gap of 6, not one chain."""
    df = spark.createDataFrame([([0.0, 5.0, 10.0, 30.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(regions.cluster_ids(F.col("v"), 6.0)).collect()] == [[1, 1, 2, 3], []]


def test_caption_table_ends(spark):
    top = [(0, "Table 1 Results", 50.0, 50.0), (1, "Name", 50.0, 80.0), (2, "Rp", 200.0, 81.0), (3, "Rc", 350.0, 80.0), (4, "m1", 50.0, 100.0), (5, "0.9", 200.0, 100.0), (6, "0.8", 350.0, 100.0)]
    (t,) = regions.caption_tables(lines(spark, [*top, (7, "2.1 Next section", 50.0, 120.0), (8, "later", 50.0, 140.0)])).collect()
    assert (t.caption, t.cells, t.y1) == ("Table 1 Results", [["Name", "Rp", "Rc"], ["m1", "0.9", "0.8"]], 112.0)
    (t,) = regions.caption_tables(lines(spark, [*top, (7, "m2", 50.0, 120.0), (8, "far below", 50.0, 160.0)])).collect()
    assert t.cells[2:] == [["m2", "", ""]]
    known = spark.createDataFrame([(1, 1, 90.0)], "doc long, page int, y0 double")
    assert regions.caption_tables(lines(spark, top), known).collect() == []
    assert regions.caption_tables(lines(spark, top[:3])).collect() == []


def test_wrapped_rows(spark):
    one = lambda rows: spark.createDataFrame([(rows,)], "x array<array<string>>").select(regions.merge_wrapped_rows(F.col("x"))).first()[0]
    assert one([["样品名称", "a"], ["相对标准偏", ""], ["率（%）", "1.2"], ["b", "c"]]) == [["样品名称", "a"], ["相对标准偏率（%）", "1.2"], ["b", "c"]]
    assert one([["短", ""], ["率", "1"]]) == [["短", ""], ["率", "1"]]
    assert one([["最后一行标签", ""]]) == [["最后一行标签", ""]] and one([]) == []


def test_continued_tables_become_one(spark):
    rows = [
        (1, 1, 50.0, 400.0, 400.0, 700.0, 800.0, 2, None, ["A", "B"], 0.0, 1, [["A", "B"], ["1", "2"]]), (1, 2, 50.0, 60.0, 410.0, 700.0, 800.0, 2, "", ["A", "B"], 0.0, 1, [["A", "B"], ["3", "4"]]),
        (1, 3, 50.0, 60.0, 400.0, 200.0, 800.0, 2, None, ["5", "6"], 1.0, 0, [["5", "6"]]), (1, 4, 50.0, 60.0, 400.0, 200.0, 800.0, 2, None, [], 0.0, 0, [["7", "8"]]),
        (2, 1, 50.0, 400.0, 400.0, 700.0, 800.0, 2, None, ["A", "B"], 0.0, 1, [["A", "B"]]), (2, 2, 50.0, 60.0, 400.0, 200.0, 800.0, 2, "Table 2", ["A", "B"], 0.0, 1, [["A", "B"]]),
    ]
    t = spark.createDataFrame(rows, "doc long, page int, x0 double, y0 double, x1 double, y1 double, page_height double, n_columns int, caption string, headers array<string>, numeric_ratio double, n_header_rows int, cells array<array<string>>")
    got = {(r.doc, r.page_start): (r.page_end, r.cells) for r in regions.merged_tables(layout.continued_tables(t)).collect()}
    assert got == {(1, 1): (3, [["A", "B"], ["1", "2"], ["3", "4"], ["5", "6"]]), (1, 4): (4, [["7", "8"]]), (2, 1): (1, [["A", "B"]]), (2, 2): (2, [["A", "B"]])}


def test_figures(spark):
    x = lines(spark, [(0, "text above", 50.0, 100.0), (1, "图1 结构", 50.0, 300.0), (2, "Fig. 1 Structure", 50.0, 320.0), (3, "图2为示意", 50.0, 340.0), (4, "after", 50.0, 360.0), (5, "Figure 2 Flow", 50.0, 600.0), (6, "x=1", 50.0, 612.0, True)])
    boxes = [(1, 1, "image", 50.0, 150.0, 300.0, 290.0), (1, 1, "drawing", 60.0, 140.0, 320.0, 280.0), (1, 1, "image", 50.0, 100.0, 90.0, 250.0), (1, 2, "image", 0.0, 500.0, 9.0, 590.0)]
    v = spark.createDataFrame(boxes, "doc long, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    a, b = regions.figures(x, v).orderBy("figure").collect()
    assert (a.captions, a.visual_kind, (a.x0, a.y0, a.x1, a.y1)) == (["图1 结构", "Fig. 1 Structure"], "mixed", (50.0, 100.0, 320.0, 312.0))
    assert a.nearby_text == ["text above", "after"]  # a line that starts like a caption is none
    assert (b.captions, b.visual_kind, b.nearby_text, b.y0) == (["Figure 2 Flow"], "caption_only", [], 600.0)


def test_formula_regions(spark):
    x = lines(spark, [(0, "R = 1 - sum(a)", 50.0, 100.0, True), (1, "/ sum(b)", 60.0, 115.0, True), (2, "y = kx", 50.0, 400.0, True), (3, "plain", 50.0, 116.0), (4, "z = a + b + 22", 400.0, 100.0, True)])
    got = sorted((r.line_no, r.text, r.n_lines) for r in regions.formula_regions(x).collect())
    assert got == [(0, "R = 1 - sum(a)\n/ sum(b)", 2), (4, "z = a + b + 22", 1)]


def test_a_line_between_joins_regions(spark):
    x = lines(spark, [(0, "a = 1 + 2", 0.0, 100.0, True), (1, "b = 3 + 4", 270.0, 100.0, True), (2, "c = 5 + 6", 140.0, 120.0, True)])
    assert [r.n_lines for r in regions.formula_regions(x).collect()] == [3]


@pytest.mark.parametrize("n", [2, 3, 4])
def test_headings_merge_in_pairs(spark, n):
    x = lines(spark, [(i, f"t{i}", 50.0, 100.0 + 20 * i) for i in range(n)]).withColumn("font_size", F.lit(16.0)).withColumn("body_size", F.lit(11.0))
    want = {2: ["t0 t1"], 3: ["t0 t1", "t2"], 4: ["t0 t1", "t2 t3"]}[n]
    assert sorted(r.text for r in regions.merge_headings(x).collect()) == want


def test_columns(spark):
    two = [(i, "w", 50.0 if i % 2 else 320.0, 100.0 + 30 * (i // 2)) for i in range(8)]
    r = regions.confident_columns(lines(spark, two)).first()
    assert (r.n_columns, r.confident) == (2, True)
    assert not regions.confident_columns(lines(spark, two, width=260.0)).first().confident
    assert not regions.confident_columns(lines(spark, two[:3])).first().confident


def test_nodes(spark):
    rows = [(1, 1, 0, "line", None, "a"), (1, 1, 1, "line", 1, "H"), (1, 1, 2, "line", None, "b"), (1, 1, 3, "table", None, "t"), (1, 1, 4, "formula", None, "f"), (1, 1, 5, "line", None, "c"), (1, 2, 0, "line", None, "d")]
    x = spark.createDataFrame(rows, "doc long, page int, reading int, kind string, level int, text string")
    for b in regions.BOX:
        x = x.withColumn(b, F.lit(1.0))
    got = [(r.page, r.node_type, r.content, r.heading) for r in regions.page_nodes(x).orderBy("sequence").collect()]
    assert got == [(1, "text", "a", None), (1, "text", "H\nb", "H"), (1, "table", "t", None), (1, "text", "f", None), (1, "text", "c", None), (2, "text", "d", None)]
    assert spark.range(1).select(regions.figure_content(F.array(F.lit("图1")), F.array(F.lit("x"), F.lit("y")))).first()[0] == "图1\n附近正文：x y"


def test_no_rows(spark):
    none = lines(spark, [])
    v = spark.createDataFrame([], "doc long, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    for got in (regions.text_layer(none), regions.table_pages(none), regions.caption_tables(none), regions.grid(none, regions.PAGE), regions.figures(none, v), regions.formula_regions(none), regions.confident_columns(none)):
        assert got.collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_grids_of_many_groups(seed):
    """Groups that are gridded together are those gridded one by one: uneven sizes, ties, null texts, uneven positions."""
    rng = np.random.default_rng(seed)
    groups = []
    for _ in range(60):
        n = int(rng.integers(1, 90))
        x0 = rng.integers(0, 9, n) * 30.0 + rng.integers(0, 4, n) * (7.5 if seed % 2 else 0.1)
        y0 = rng.integers(0, 12, n) * 10.0 + rng.integers(0, 3, n)
        text = [None if v < 0.1 else f"t{v:.3f}" for v in rng.random(n)]
        groups.append((y0.tolist(), x0.tolist(), rng.permutation(n).tolist(), text, (y0 + rng.integers(0, 3, n)).tolist()))
    ends = np.cumsum([len(g[0]) for g in groups])
    flat = [pa.array([v for g in groups for v in g[j]], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.float64()))]
    want = [(i, cells) for i, g in enumerate(groups) for (cells,) in regions._grid(*g, 6.0, 24.0)]
    at, (cells,) = regions._grids(ends, *flat, 6.0, 24.0)
    assert list(zip(at.tolist(), cells.to_pylist(), strict=True)) == want


def test_grids_that_are_walked():
    """Null or equal line numbers, endless positions and long groups are left to the walk."""
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.float64())
    base = ([0.0, 0.0, 20.0], [0.0, 50.0, 0.0], [1, 2, 3], ["a", "b", "c"], [6.0, 6.0, 26.0])
    made = lambda cols, n=3: regions._grids(np.array([n]), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], 6.0, 24.0)
    assert made(base)[1][0].to_pylist() == [[["a", "b"], ["c", ""]]]
    assert made((*base[:2], [1, None, 3], *base[3:])) is None
    assert made((base[0], [0.0, float("inf"), 0.0], *base[2:])) is None
    assert made(([0.0, 0.0, 20.0, 0.0], [0.0, 50.0, 0.0, 0.0], [1, 2, 3, 1], ["b", "x", "c", "a"], [6.0, 6.0, 26.0, 6.0]), 4) is None
    many = regions.TOGETHER + 1
    assert made(tuple(c * many for c in base), 3 * many) is None
