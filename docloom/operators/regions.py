"""Tables, figures, formulas, columns and nodes of a page, from positioned lines and drawn rules.

Lines are those of ``layout`` with ``is_math``. Sequential rules are folds over the arrays of one page, whose size a page
bounds; everything else is windows, aggregates and range joins inside a page. Rows with a null document, page or position take
no part in geometry; an empty table gives an empty table; equal positions are ordered by line_no.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import markers as M
from docloom.functions import text as T
from docloom.operators.layout import looks_like_formula

MEANINGFUL = r"[\p{L}\p{N}]"
BOX = ("x0", "y0", "x1", "y1")
PAGE = ("doc", "page")


# --- lines ---


def text_layer(lines: DataFrame, per_page: int = 4) -> DataFrame:
    """Per document its letters and digits, its pages, and whether they are enough to index it without recognition."""
    g = lines.groupBy("doc").agg(F.sum(F.regexp_count(T.text_of("text"), F.lit(MEANINGFUL))).cast("long").alias("chars"), F.max("page").cast("long").alias("pages"))
    return g.withColumn("has_text", F.col("chars") >= F.greatest(F.lit(per_page), per_page * F.col("pages")))


def looks_like_math(c: Column, math_font: Column) -> Column:
    s = T.squeeze(c)
    styled = F.rlike(s, F.lit(r"[\x{1d400}-\x{1d7ff}]")) | (math_font & (F.length(s) <= 30))
    return ~F.rlike(s, F.lit(M.DOI)) & ~F.rlike(s, F.lit(r"^[℃°%％]+$")) & (looks_like_formula(s) | styled)


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc, page, line_no, span_no, text, size, font, bold and the line's box) as lines; blank lines go."""
    font = F.lower(T.text_of("font"))
    ordered = F.array_sort(F.collect_list(F.struct("span_no", T.text_of("text").alias("text"))))
    g = spans.groupBy(*PAGE, "line_no").agg(
        T.squeeze(F.array_join(F.transform(ordered, lambda s: s["text"]), "")).alias("text"), F.max(F.coalesce("size", F.lit(0.0))).alias("font_size"),
        F.bool_or(F.coalesce("bold", F.lit(False)) | F.contains(font, F.lit("bold"))).alias("bold"), F.bool_or(F.contains(font, F.lit("math")) | (font == "symbolmt")).alias("math_font"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return g.where(F.length("text") > 0).withColumn("is_math", looks_like_math(F.col("text"), F.col("math_font"))).drop("math_font")


def merge_headings(lines: DataFrame, body: str = "body_size") -> DataFrame:
    """Title lines in two parts become one line. In a run of lines that fit, the first takes the second, the third the fourth.

    ``title`` says which lines may be titles beside their size; without it, every line that is no formula.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    title = ~F.col("is_math") & (F.col("font_size") >= F.col(body) * 1.35) & (F.col("title") if "title" in lines.columns else F.lit(True))
    x = lines.withColumn("t", title).withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    gap = F.lead("y0").over(w) - F.col("y1")
    fits = F.col("t") & F.lead("t").over(w) & (F.abs(F.lead("centre").over(w) - F.col("centre")) <= 35) & gap.between(0, 24)
    x = x.withColumn("fits", F.coalesce(fits, F.lit(False)))
    x = x.withColumn("run", F.sum((~F.coalesce(F.lag("fits").over(w), F.lit(False))).cast("int")).over(w))
    x = x.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("line_no")) - 1) / 2))
    part = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return x.groupBy(*PAGE, "run", "pair").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(part, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), F.bool_or("bold").alias("bold"), F.bool_or("is_math").alias("is_math"),
    ).drop("run", "pair")


# --- clusters of positions ---


def cluster_ids(values: Column, gap: Column | float) -> Column:
    """Per value, in the order given, the number (from 1) of its cluster: a value over ``gap`` from the last mean opens one."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, v: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(v - a["s"] / F.greatest(a["n"], F.lit(1.0))) <= gap)
        k = F.when(near, a["k"]).otherwise(a["k"] + 1)
        s, n = F.when(near, a["s"] + v).otherwise(v), F.when(near, a["n"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(s.alias("s"), n.alias("n"), k.alias("k"), F.concat(a["ids"], F.array(k)).alias("ids"))

    return F.aggregate(values, start, step, lambda a: a["ids"])


def clustered(df: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...], gap: Column | float, name: str, kept: tuple[str, ...]) -> DataFrame:
    """Rows of ``df`` (order and kept columns) with the number of their cluster. Each group's array is folded once."""
    fields = (*order, *[k for k in (value, *kept) if k not in order])
    wide = [F.max(gap).alias("gap")] if isinstance(gap, Column) else [F.lit(float(gap)).alias("gap")]
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys(fields)))).alias("seq"), *wide)
    ids = cluster_ids(F.transform("seq", lambda t: t[value]), F.col("gap"))
    return g.select(*keys, F.explode(F.zip_with("seq", ids, lambda t, k: F.struct(t.alias("t"), k.alias(name)))).alias("z")).select(*keys, "z.t.*", f"z.{name}")


def walked(df: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], walk: Callable[..., Iterator[tuple]], out: str, types: tuple[pa.DataType, ...], together: Callable | None = None) -> DataFrame:
    """Rows (keys and ``out``) that ``walk`` makes from the lists of a group's fields. Folds over a page's lines are walked in
    Python: as expressions they are interpreted node by node.

    ``together`` (ends of the groups, a flat array a field) does the same for many groups at once: the groups that give a row,
    and the columns of ``out``; or None where it can't, and the groups are walked.
    """
    df = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [part.split()[0] for part in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = 256 if together is None else 1024
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                ends = np.cumsum(pc.list_value_length(b.column("seq")).to_numpy(zero_copy_only=False))
                flat = pc.list_flatten(b.column("seq"))
                arrays = [pc.struct_field(flat, f) for f in fields]
                made = None if together is None else together(ends, *arrays)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(made[0], pa.int64())) for k in keys], *made[1]], names=[*keys, *names])
                    continue
                lists = [a.to_pylist() for a in arrays]
                at, found, begin = [], [], 0
                for g, end in enumerate(ends.tolist()):
                    for row in walk(*[v[begin:end] for v in lists]):
                        at.append(g)
                        found.append(row)
                    begin = end
                values = [pa.array([r[j] for r in found], t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in keys], *values], names=[*keys, *names])

    return df.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("seq")).mapInArrow(run, f"{kinds}, {out}")


CELLS = pa.list_(pa.list_(pa.string()))


def _low(v) -> tuple:
    """Sort key with nulls first."""
    return (v is not None, v)


def _clusters(values: list[float], gap: float) -> list[int]:
    """As ``cluster_ids``."""
    s, n, k, ids = 0.0, 0, 0, []
    for v in values:
        if n and abs(v - s / n) <= gap:
            s, n = s + v, n + 1
        else:
            s, n, k = v, 1, k + 1
        ids.append(k)
    return ids


def _filled(row: list[int], x: list[float | None], line_no: list, text: list[str | None], anchors: list[float]) -> list[list[str]]:
    """Lines in rows (from 1) as rows of cells, each in its nearest column; texts of one cell from left to right."""
    cells: dict[tuple[int, int], list] = {}
    near: dict[float, int] = {}
    for r, v, i, t in zip(row, x, line_no, text, strict=True):
        if v is None:
            continue
        if v not in near:
            apart = [abs(a - v) for a in anchors]
            near[v] = apart.index(min(apart))
        cells.setdefault((r, near[v]), []).append((v, _low(i), t))
    joined = {at: " ".join(t for *_, t in (sorted(c, key=lambda p: (p[0], p[1], _low(p[2]))) if len(c) > 1 else c) if t is not None) for at, c in cells.items()}
    return [[joined.get((r, k), "") for k in range(len(anchors))] for r in range(1, max(row) + 1)]


def _grid(y0: list, x0: list, line_no: list, text: list, centre: list, row_gap: float, column_gap: float) -> Iterator[tuple]:
    """The grid of one group."""
    order = sorted(range(len(x0)), key=lambda i: (y0[i], x0[i], _low(line_no[i]), centre[i], _low(text[i])))
    row = _clusters([centre[i] for i in order], row_gap)
    across = sorted(x0)
    column = _clusters(across, column_gap)
    if row[-1] < 2 or column[-1] < 2:
        return
    sums: dict[int, list[float]] = {}
    for k, v in zip(column, across, strict=True):
        sums.setdefault(k, []).append(v)
    anchors = [sum(v) / len(v) for v in sums.values()]
    yield (_filled(row, [x0[i] for i in order], [line_no[i] for i in order], [text[i] for i in order], anchors),)


def _clusters_of_all(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gap: float) -> np.ndarray:
    """As ``_clusters`` for many lists that lie one after the other, all lists one value further at a time."""
    longest_first = np.argsort(-sizes, kind="stable")
    at = starts[longest_first]
    s, n, k, ids = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), np.int64), np.empty(len(values), np.int64)
    alive = len(sizes) - np.cumsum(np.bincount(sizes, minlength=1))
    for i, m in enumerate(alive[:-1].tolist()):
        place = at[:m] + i
        v, sm, nm = values[place], s[:m], n[:m]
        near = (nm > 0) & (np.abs(v - sm / np.maximum(nm, 1)) <= gap)
        s[:m] = np.where(near, sm, 0) + v
        n[:m] = np.where(near, nm, 0) + 1
        k[:m] += ~near
        ids[place] = k[:m]
    return ids


def _nearest(values: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The first of the nearest anchors between ``low`` and ``high``, which ascend; the search begins at ``own``."""
    k = own
    while True:
        down = np.maximum(k - 1, low)
        moved = np.where(np.abs(anchors[down] - values) <= np.abs(anchors[k] - values), down, k)
        if (moved == k).all():
            break
        k = moved
    while True:
        up = np.minimum(k + 1, high)
        moved = np.where(np.abs(anchors[up] - values) < np.abs(anchors[k] - values), up, k)
        if (moved == k).all():
            return k
        k = moved


def _nested(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


#: lines of a group up to which groups are gridded together
TOGETHER = 4096


def _grids(ends: np.ndarray, y0: pa.Array, x0: pa.Array, line_no: pa.Array, text: pa.Array, centre: pa.Array, row_gap: float, column_gap: float) -> tuple[np.ndarray, list[pa.Array]] | None:
    """The grids of many groups; None for long groups, odd numbers or lines that only their text puts in order."""
    sizes = np.diff(ends, prepend=0)
    if line_no.null_count or not pa.types.is_integer(line_no.type) or not all(pa.types.is_float64(a.type) for a in (y0, x0, centre)) or sizes.max(initial=0) > TOGETHER or sizes.min(initial=1) < 1:
        return None
    y, x, c, number = (a.to_numpy(zero_copy_only=False) for a in (y0, x0, centre, line_no))
    if not (np.isfinite(y).all() and np.isfinite(x).all() and np.isfinite(c).all()):
        return None
    starts, group = ends - sizes, np.repeat(np.arange(len(ends)), sizes)
    down, across = np.lexsort((c, number, x, y, group)), np.lexsort((x, group))
    row, column = _clusters_of_all(c[down], starts, sizes, row_gap), _clusters_of_all(x[across], starts, sizes, column_gap)
    n_rows, n_columns = row[ends - 1], column[ends - 1]
    first = np.cumsum(n_columns) - n_columns
    own = first[group] + column - 1
    anchors = np.bincount(own, x[across]) / np.bincount(own)
    near = _nearest(x[across], own, first[group], (first + n_columns - 1)[group], anchors) - first[group]
    r, k = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    r[down], k[across] = row - 1, near
    table = (n_rows >= 2) & (n_columns >= 2)
    n_cells = np.where(table, n_rows * n_columns, 0)
    w = np.flatnonzero(table[group] & text.is_valid().to_numpy(zero_copy_only=False))
    g = group[w]
    cell = (np.cumsum(n_cells) - n_cells)[g] + r[w] * n_columns[g] + k[w]
    order = np.lexsort((number[w], x[w], cell))
    if (~(np.diff(cell[order]) | np.diff(number[w][order])).astype(bool) & (np.diff(x[w][order]) == 0)).any():
        return None
    texts = pc.binary_join(_nested(text.take(pa.array(w[order])), np.bincount(cell, minlength=n_cells.sum())), " ")
    return np.flatnonzero(table), [_nested(_nested(texts, np.repeat(n_columns[table], n_rows[table])), n_rows[table])]


def grid(lines: DataFrame, keys: tuple[str, ...], row_gap: float = 6.0, column_gap: float = 24.0) -> DataFrame:
    """Lines of one table each (by ``keys``) as an array of rows of cells; under two rows or two columns there is no table."""
    x = lines.where("x0 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL").select(*keys, "y0", "x0", "line_no", "text", ((F.col("y0") + F.col("y1")) / 2).alias("centre"))
    one, many = (partial(f, row_gap=row_gap, column_gap=column_gap) for f in (_grid, _grids))
    return walked(x, keys, ("y0", "x0", "line_no", "text", "centre"), one, "cells array<array<string>>", (CELLS,), many)


# --- tables ---


def aligned_pairs(lines: DataFrame) -> DataFrame:
    """Per page the pairs of rows of three or more short lines that share three left edges (14 points)."""
    short = lines.where((F.length("text") <= 48) & ~F.col("is_math"))
    rows = short.groupBy(*PAGE, F.bround(F.col("y0") / 4).alias("row")).agg(F.min("line_no").alias("first"), F.collect_list("x0").alias("xs")).where(F.size("xs") >= 3)
    g = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("first", "xs")).alias("rows"))
    shared = lambda a, b: F.size(F.filter(a["xs"], lambda p: F.exists(b["xs"], lambda q: F.abs(p - q) <= 14)))
    pairs = F.aggregate("rows", F.lit(0), lambda n, a: n + F.size(F.filter("rows", lambda b: (b["first"] > a["first"]) & (shared(a, b) >= 3))))
    return g.select(*PAGE, pairs.alias("pairs"))


def table_pages(lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Per page whether tables are worth looking for: a caption, a region between rules, or two pairs of aligned rows."""
    caption = F.bool_or(F.rlike(T.strip("text"), F.lit(M.TABLE_CAPTION))).alias("has_caption")
    x = lines.groupBy(*PAGE).agg(caption).join(aligned_pairs(lines), list(PAGE), "left")
    ruled = F.lit(False) if regions is None else F.coalesce("ruled", F.lit(False))
    if regions is not None:
        x = x.join(regions.select(*PAGE).distinct().withColumn("ruled", F.lit(True)), list(PAGE), "left")
    pairs = F.coalesce("pairs", F.lit(0))
    return x.select(*PAGE, "has_caption", ruled.alias("has_rules"), pairs.alias("pairs"), (F.col("has_caption") | ruled | (pairs >= 2)).alias("probe"))


def horizontal_rules(drawings: DataFrame) -> DataFrame:
    """Drawings (doc, page, kind ``l`` line or ``re`` box, box, page_width) as level rules of a table's width: x0, x1, y."""
    lo, hi, width = F.least("x0", "x1"), F.greatest("x0", "x1"), F.greatest(F.lit(100.0), F.col("page_width") * 0.3)
    level = (F.col("kind") == "l") & (F.abs(F.col("y0") - F.col("y1")) <= 2)
    ys = F.when(level, F.array((F.col("y0") + F.col("y1")) / 2)).when(F.col("kind") == "re", F.array("y0", "y1"))
    return drawings.where(hi - lo >= width).select(*PAGE, lo.alias("x0"), hi.alias("x1"), F.explode(ys).alias("y"))


def rule_regions(rules: DataFrame) -> DataFrame:
    """Three or more rules above each other (80% shared width; within 2.5 points they are one) bound a region of a page."""
    seg = F.array_sort(F.collect_list(F.struct("x0", "x1", "y")))
    kind = "array<struct<s0:double,s1:double,n:double,k:int>>"
    start = F.struct(F.array().cast(kind).alias("groups"), F.array().cast("array<int>").alias("ids"))

    def place(a: Column, s: Column) -> Column:
        def fits(g: Column) -> Column:
            g0, g1 = g["s0"] / g["n"], g["s1"] / g["n"]
            shared = F.greatest(F.lit(0.0), F.least(s["x1"], g1) - F.greatest(s["x0"], g0))
            return shared / F.greatest(F.least(s["x1"] - s["x0"], g1 - g0), F.lit(1.0)) >= 0.8

        hit = F.array_position(F.transform(a["groups"], fits), True).cast("int")
        k = F.when(hit > 0, hit).otherwise(F.size(a["groups"]) + 1)
        grown = F.transform(a["groups"], lambda g: F.when(g["k"] == k, F.struct((g["s0"] + s["x0"]).alias("s0"), (g["s1"] + s["x1"]).alias("s1"), (g["n"] + 1.0).alias("n"), g["k"].alias("k"))).otherwise(g))
        new = F.when(hit > 0, F.array().cast(kind)).otherwise(F.array(F.struct(s["x0"].alias("s0"), s["x1"].alias("s1"), F.lit(1.0).alias("n"), k.alias("k"))))
        return F.struct(F.concat(grown, new).alias("groups"), F.concat(a["ids"], F.array(k)).alias("ids"))

    g = rules.groupBy(*PAGE).agg(seg.alias("seg")).withColumn("ids", F.aggregate("seg", start, place, lambda a: a["ids"]))
    placed = g.select(*PAGE, F.explode(F.zip_with("seg", "ids", lambda s, k: F.struct(k.alias("k"), s["y"].alias("y"), s["x0"].alias("x0"), s["x1"].alias("x1")))).alias("s")).select(*PAGE, "s.*")
    rule = "array<double>"

    def melt(a: Column, y: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        return F.when((F.size(a) > 0) & (F.abs(y - last) <= 2.5), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array((last + y) / 2))).otherwise(F.concat(a, F.array(y)))

    h = placed.groupBy(*PAGE, "k").agg(F.array_sort(F.collect_list("y")).alias("ys"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    h = h.withColumn("ys", F.aggregate("ys", F.array().cast(rule), melt)).where(F.size("ys") >= 3)
    return h.select(*PAGE, F.col("k").alias("region"), "x0", F.array_min("ys").alias("y0"), "x1", F.array_max("ys").alias("y1"), F.col("ys").alias("rule_ys"))


def ruled_tables(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of the lines whose centres lie in a region between rules; captions are none of them."""
    r = regions.select(*PAGE, "region", *[F.col(c).alias(f"r_{c}") for c in BOX])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("r_x0") - 3, F.col("r_x1") + 3) & cy.between(F.col("r_y0") - 2, F.col("r_y1") + 2) & ~F.rlike(T.strip("text"), F.lit(M.TABLE_CAPTION))
    return grid(lines.join(r, list(PAGE)).where(inside), (*PAGE, "region"))


def section_like(c: Column) -> Column:
    return F.rlike(c, F.lit(M.NUMBERED_HEADING)) | F.rlike(c, F.lit(M.CHINESE_HEADING)) | F.rlike(c, F.lit(M.CHAPTER))


def _tenths(v: float) -> float:
    return float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def caption_tables(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Tables below a caption: lines go on until a heading, a long line or a wide gap; the first two rows give the columns."""
    x = lines.select(*PAGE, "line_no", "text", *BOX, F.col("page_height") * 0.92, F.rlike(T.strip("text"), F.lit(M.TABLE_CAPTION)), section_like(T.strip("text")) | (F.length("text") > 60)).toDF(*PAGE, "line_no", "text", *BOX, "foot", "cap", "ends")
    if existing is not None:
        e = existing.select(F.col("doc").alias("e_doc"), F.col("page").alias("e_page"), F.col("y0").alias("e_y0"))
        below = (F.col("doc") == F.col("e_doc")) & (F.col("page") == F.col("e_page")) & (F.col("e_y0") >= F.col("y0")) & (F.col("e_y0") - F.col("y1") < 80)
        x = x.where("NOT coalesce(cap, false)").unionByName(x.where("cap").join(e, below, "left_anti")).unionByName(x.where("cap").join(e, below, "left_semi").withColumn("cap", F.lit(False)))

    def walk(line_no: list, text: list, x0: list, y0: list, x1: list, y1: list, foot: list, cap: list, ends: list) -> Iterator[tuple]:
        captions = [i for i in range(len(cap)) if cap[i] and y1[i] is not None]
        if not captions:
            return
        order = sorted((i for i in range(len(y0)) if y0[i] is not None and foot[i] is not None and y0[i] < foot[i]), key=lambda i: (y0[i], _low(x0[i]), _low(line_no[i])))
        for c in captions:
            kept: list[int] = []
            row: list[int] = []
            for i in order:
                if not y0[i] > y1[c] + 8:
                    continue
                gap = y0[i] - y0[kept[-1]] if kept else None
                if gap is not None and (ends[i] or (gap > 28 and row[-1] >= 2)):
                    break
                row.append(row[-1] + (gap > 8) if kept else 1)
                kept.append(i)
            anchors = sorted({_tenths(x0[i]) for i, r in zip(kept, row, strict=True) if r <= 2 and x0[i] is not None})
            if len(anchors) < 3 or row[-1] < 2:
                continue
            of = lambda v: [v[i] for i in kept]  # noqa: B023, E731
            box = [f((v for v in of(b) if v is not None), default=None) for f, b in ((min, x0), (min, y0), (max, x1), (max, y1))]
            yield (line_no[c], text[c], *box, _filled(row, of(x0), of(line_no), of(text), anchors))

    number = lines.schema["line_no"].dataType.simpleString()
    out = f"caption_no {number}, caption string, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>"
    types = ({"int": pa.int32(), "bigint": pa.int64()}[number], pa.string(), *[pa.float64()] * 4, CELLS)
    return walked(x, PAGE, ("line_no", "text", *BOX, "foot", "cap", "ends"), walk, out, types)


def merge_wrapped_rows(cells: Column) -> Column:
    """A row with a label alone (four characters or more) goes in front of the next row's label where that looks cut off."""
    clean = F.transform(cells, lambda r: F.transform(r, T.strip))
    rest = lambda r: F.exists(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda v: F.length(v) > 0)
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit("").alias("held"), F.lit(False).alias("skip"))

    def step(a: Column, r: Column, following: Column) -> Column:
        label, after = F.coalesce(F.get(r, 0), F.lit("")), F.coalesce(F.get(following, 0), F.lit(""))
        cut = F.rlike(after, F.lit(r"^(?:[度率量值数]|[\x{4e00}-\x{9fff}]{1,3}[（(])"))
        wraps = ~a["skip"] & following.isNotNull() & (F.length(label) >= 4) & ~rest(r) & F.coalesce(rest(following), F.lit(False)) & cut
        row = F.transform(r, lambda v, i: F.when(i == 0, F.concat(a["held"], v)).otherwise(v))
        return F.struct(F.when(wraps, a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"), F.when(wraps, label).otherwise(F.lit("")).alias("held"), wraps.alias("skip"))

    pairs = F.zip_with(clean, F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), lambda r, f: F.struct(r.alias("r"), f.alias("f")))
    return F.aggregate(pairs, start, lambda a, p: step(a, p["r"], p["f"]), lambda a: a["out"])


def merged_tables(tables: DataFrame) -> DataFrame:
    """Parts of ``layout.continued_tables`` as one table each: header rows repeated on a later page go, rows follow each other.

    ``tables`` has doc, table_group, page, y0, headers, n_header_rows, cells.
    """
    part = F.array_sort(F.collect_list(F.struct("page", "y0", "headers", "n_header_rows", "cells")))
    g = tables.groupBy("doc", "table_group").agg(part.alias("parts"))
    first = F.get("parts", 0)
    again = lambda p, i: (i > 0) & (F.size(p["headers"]) > 0) & (p["headers"] == first["headers"])
    rows = F.flatten(F.transform("parts", lambda p, i: F.when(again(p, i), F.slice(p["cells"], p["n_header_rows"] + 1, F.greatest(F.size(p["cells"]), F.lit(1)))).otherwise(p["cells"])))
    pages = F.transform("parts", lambda p: p["page"])
    return g.select("doc", "table_group", F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), first["headers"].alias("headers"), rows.alias("cells"), F.size("parts").alias("n_parts"))


# --- figures and formulas ---


def figure_captions(lines: DataFrame) -> DataFrame:
    """Caption lines by figure: one of the same number up to 70 points below is another wording of the same caption."""
    s = T.squeeze("text")
    verb = r"(?i)^(?:图|fig\.?|figure)\s*[\d一二三四五六七八九十]+\s*为"
    c = lines.where(F.rlike(s, F.lit(M.FIGURE_CAPTION)) & (F.length(s) <= 100) & ~F.rlike(s, F.lit(verb)))
    c = c.withColumn("number", F.regexp_extract(s, r"(?i)^(?:图|fig\.?|figure)\s*([\d一二三四五六七八九十]+)", 1))
    seq = F.array_sort(F.collect_list(F.struct("line_no", "number", "text", *BOX)))
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("number"), F.lit(0.0).alias("y1"), F.array().cast("array<int>").alias("ids"))

    def step(a: Column, t: Column) -> Column:
        same = (a["k"] > 0) & (a["number"] == t["number"]) & (t["y0"] - a["y1"]).between(-4, 70)
        k = F.when(same, a["k"]).otherwise(a["k"] + 1)
        kept = lambda f: F.when(same, a[f]).otherwise(t[f]).alias(f)
        return F.struct(k.alias("k"), kept("number"), kept("y1"), F.concat(a["ids"], F.array(k)).alias("ids"))

    g = c.groupBy(*PAGE).agg(seq.alias("seq")).withColumn("ids", F.aggregate("seq", start, step, lambda a: a["ids"]))
    x = g.select(*PAGE, F.explode(F.zip_with("seq", "ids", lambda t, k: F.struct(t.alias("t"), k.alias("figure")))).alias("z")).select(*PAGE, "z.figure", "z.t.*")
    x = x.withColumn("above", F.coalesce(F.lag("y1").over(Window.partitionBy(*PAGE).orderBy("line_no")), F.lit(0.0)))
    first = F.min_by(F.struct("line_no", "text", *BOX, "above"), "line_no")
    g = x.groupBy(*PAGE, "figure").agg(first.alias("c"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"]).alias("captions"))
    return g.select(*PAGE, "figure", "captions", *[F.col(f"c.{f}").alias(f) for f in ("line_no", *BOX, "above")])


def figures(lines: DataFrame, visuals: DataFrame) -> DataFrame:
    """Figures: a caption, the drawn boxes (kind and box) up to 280 points above it, and the three nearest lines within 96."""
    c = figure_captions(lines).select(*PAGE, "figure", "captions", F.col("line_no").alias("c_no"), *[F.col(f).alias(f"c_{f}") for f in BOX], "above")
    v = visuals.select(F.col("doc").alias("v_doc"), F.col("page").alias("v_page"), "kind", *[F.col(f).alias(f"v_{f}") for f in BOX])
    on = (F.col("doc") == F.col("v_doc")) & (F.col("page") == F.col("v_page")) & F.col("v_y1").between(F.greatest("above", F.col("c_y0") - 280), F.col("c_y0") + 2)
    key, own = [*PAGE, "figure"], ["captions", "c_no", *[f"c_{f}" for f in BOX]]
    box = [F.coalesce((F.min if f in ("x0", "y0") else F.max)(f"v_{f}"), F.first(f"c_{f}")).alias(f"v_{f}") for f in BOX]
    kind = F.when(F.count("kind") == 0, "caption_only").when(F.min("kind") != F.max("kind"), "mixed").otherwise(F.min("kind"))
    f = c.join(v, on, "left").groupBy(*key).agg(*[F.first(o).alias(o) for o in own], *box, kind.alias("visual_kind"))
    f = f.select(*key, *own, "visual_kind", *[(F.least if b in ("x0", "y0") else F.greatest)(f"v_{b}", f"c_{b}").alias(f"f_{b}") for b in BOX])
    s = T.strip("text")
    t = lines.where(~F.col("is_math") & ~F.rlike(s, F.lit(M.FIGURE_CAPTION)) & ~F.rlike(s, F.lit(M.TABLE_CAPTION))).select(*PAGE, "line_no", "text", "y0", "y1")
    apart = F.least(F.abs(F.col("y1") - F.col("f_y0")), F.abs(F.col("y0") - F.col("f_y1")))
    near = f.select(*key, "f_y0", "f_y1").join(t, list(PAGE)).withColumn("apart", apart).where("apart <= 96")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("apart", "line_no"))).where("nth <= 3")
    near = near.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda n: n["text"]).alias("nearby_text"))
    out = f.join(near, key, "left").withColumn("nearby_text", F.coalesce("nearby_text", F.array().cast("array<string>")))
    return out.select(*key, "captions", "visual_kind", "nearby_text", *[F.col(f"f_{b}").alias(b) for b in BOX])


def substantive(lines: Column) -> Column:
    """Whether the lines of a region make a formula: a relation, a function, or operators and a digit over two lines."""
    text = F.array_join(lines, "")
    flat = F.regexp_replace(text, r"\s+", "")
    sums = (F.size(lines) >= 2) & (F.regexp_count(flat, F.lit(r"[-+−*/×÷^_]")) >= 3) & F.rlike(flat, F.lit(r"\p{Nd}"))
    return (F.length(flat) >= 8) & (F.rlike(flat, F.lit("[=＝∑√∫≤≥]")) | F.rlike(text, F.lit(r"(?i)\b(?:sqrt|sum|log|ln|exp|mean|var)\s*\(")) | sums)


def _touching(page):
    """Numbers the regions of a page: a line joins all regions that it touches; they become the first of them."""
    page = page.sort_values(["y0", "x0", "line_no"], kind="stable")
    boxes: dict[int, list[float]] = {}
    of: list[int] = []
    for n, (x0, y0, x1, y1, size) in enumerate(page[["x0", "y0", "x1", "y1", "font_size"]].itertuples(index=False)):
        hit = [
            k for k, (a0, b0, a1, b1) in boxes.items()
            if max(b0 - y1, y0 - b1, 0.0) <= max(28.0, size * 2.5) and (min(x1, a1) > max(x0, a0) or abs((x0 + x1) - (a0 + a1)) / 2 <= 140)
        ]
        k = hit[0] if hit else n
        parts = [boxes.pop(h) for h in hit[1:]] + [boxes[h] for h in hit[:1]] + [[x0, y0, x1, y1]]
        boxes[k] = [min(p[0] for p in parts), min(p[1] for p in parts), max(p[2] for p in parts), max(p[3] for p in parts)]
        gone = set(hit[1:])
        of = [k if o in gone else o for o in of] + [k]
    return page.assign(region=of)[["doc", "page", "line_no", "region"]]


def formula_regions(lines: DataFrame) -> DataFrame:
    """Formula lines of a page that touch, as regions with text and box; regions that are no formula are left out.

    The order of joins matters, so the lines of one page are walked in Python; a page bounds the group.
    """
    m = lines.where("is_math AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").select(*PAGE, "line_no", "text", *BOX, F.coalesce("font_size", F.lit(0.0)).alias("font_size"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.schema if f.name in (*PAGE, "line_no"))
    ids = m.drop("text").groupBy(*PAGE).applyInPandas(_touching, f"{kinds}, region long")
    x = m.join(ids, [*PAGE, "line_no"])
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text")))
    g = x.groupBy(*PAGE, "region").agg(F.min("line_no").alias("line_no"), F.transform(ordered, lambda t: t["text"]).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.where(substantive(F.col("parts"))).select(*PAGE, "line_no", F.array_join("parts", "\n").alias("text"), *BOX, F.size("parts").alias("n_lines"))


# --- columns and nodes ---


def confident_columns(lines: DataFrame) -> DataFrame:
    """Per page whether its lines stand in two to four clear columns: two lines and 24 points each, gutters, 45% side by side."""
    tolerance = F.greatest(F.lit(24.0), F.col("page_width") * 0.06)
    x = clustered(lines.where(~F.col("is_math")), PAGE, "x0", ("x0", "line_no"), tolerance, "k", ("y0", "x1", "y1", "page_width"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("page_width").alias("page_width")]
    c = x.groupBy(*PAGE, "k").agg(F.count(F.lit(1)).alias("n"), *box)
    w = Window.partitionBy(*PAGE).orderBy("k")
    c = c.withColumn("n_x0", F.lead("x0").over(w)).withColumn("n_y0", F.lead("y0").over(w)).withColumn("n_y1", F.lead("y1").over(w))
    shared = F.greatest(F.lit(0.0), F.least("y1", "n_y1") - F.greatest("y0", "n_y0"))
    share = shared / F.greatest(F.least(F.col("y1") - F.col("y0"), F.col("n_y1") - F.col("n_y0")), F.lit(1.0))
    beside = F.col("n_x0").isNull() | ((F.col("n_x0") - F.col("x1") >= F.greatest(F.lit(18.0), F.col("page_width") * 0.035)) & (share >= 0.45))
    clear = F.bool_and((F.col("n") >= 2) & (F.col("y1") - F.col("y0") >= 24) & beside)
    columns = F.count(F.lit(1))
    return c.groupBy(*PAGE).agg(columns.cast("int").alias("n_columns"), (clear & (F.sum("n") >= 4) & columns.between(2, 4)).alias("confident"))


def page_nodes(items: DataFrame) -> DataFrame:
    """Items in reading order (doc, page, reading, kind, level, text, box) as nodes.

    Lines gather until a heading, a table, a figure, a formula or the page's end; each of the others is a node of its own.
    """
    w = Window.partitionBy("doc").orderBy("page", "reading")
    before = F.lag(F.struct("page", "kind")).over(w)
    line = F.col("kind") == "line"
    cut = ~line | F.col("level").isNotNull() | before.isNull() | (before["page"] != F.col("page")) | (before["kind"] != "line")
    x = items.withColumn("sequence", F.sum(cut.cast("int")).over(w) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("reading", "text")))
    kind = F.first(F.when(line | (F.col("kind") == "formula"), "text").otherwise(F.col("kind")))
    heading = F.min_by(F.when(F.col("level").isNotNull(), F.struct("text", "level")), "reading")
    return x.groupBy("doc", "page", "sequence").agg(
        kind.alias("node_type"), F.array_join(F.transform(ordered, lambda t: t["text"]), "\n").alias("content"), F.count(F.lit(1)).alias("line_count"), heading["text"].alias("heading"),
        heading["level"].alias("heading_level"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def figure_content(captions: Column, nearby: Column) -> Column:
    """Text of a figure's node: its captions, then the text nearby."""
    return F.concat(F.array_join(captions, "\n"), F.when(F.size(nearby) > 0, F.concat(F.lit("\n附近正文："), F.array_join(nearby, " "))).otherwise(F.lit("")))


def table_content(cells: Column) -> Column:
    """Text of a table's node: rows as lines, cells apart by tabs."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "\t")), "\n")
