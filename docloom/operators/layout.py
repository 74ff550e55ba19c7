"""Layout operators over positioned lines: doc, page, line_no, text, x0, y0, x1, y1, font_size, bold, page_height, page_width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import markers as M
from docloom.functions import text as T

MARGIN, BODY_SIZE = 0.12, 11.0


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The lowest value at which the weights so far reach half of all."""
    g = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("upto", F.sum("w").over(w.orderBy(value))).withColumn("all", F.sum("w").over(w))
    return g.where(F.col("upto") >= F.col("all") / 2.0).groupBy(*keys).agg(F.min(value).alias("median"))


def body_size(lines: DataFrame) -> DataFrame:
    return weighted_median(lines.where(F.length(T.strip("text")) > 0), ["doc"], "font_size", F.length(T.strip("text"))).withColumnRenamed("median", "body_size")


def in_margin() -> Column:
    return (F.col("y1") <= F.col("page_height") * MARGIN) | (F.col("y0") >= F.col("page_height") * (1 - MARGIN))


def margin_key(c: str = "text") -> Column:
    return F.regexp_replace(T.fold(T.squeeze(c)), r"\d+", "#")


def margin_noise(lines: DataFrame) -> DataFrame:
    """Adds noise: page numbers, and texts that return on max(2, half) of the document's pages, in the outer margins."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    keyed = lines.withColumn("key", F.when(in_margin(), margin_key()))
    again = keyed.where("key IS NOT NULL").groupBy("doc", "key").agg(F.countDistinct("page").alias("on_pages")).join(pages, "doc")
    again = again.where(F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2.0))).select("doc", "key", F.lit(True).alias("again"))
    x = keyed.join(again, ["doc", "key"], "left")
    number = F.rlike(T.strip("text"), F.lit(M.LAYOUT_PAGE_NUMBER))
    return x.withColumn("noise", F.col("key").isNotNull() & (number | F.coalesce("again", F.lit(False)))).drop("key", "again")


def looks_like_sentence(c: Column) -> Column:
    flat = F.regexp_replace(c, r"\s+", "")
    return (F.length(flat) > 48) | ((F.length(flat) > 28) & F.rlike(c, F.lit("[。！？；，,.;!?]"))) | (F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z]+(?:[-'][A-Za-z]+)?"), F.lit(0))) > 10)


def looks_like_formula(c: Column) -> Column:
    flat = F.regexp_replace(c, r"\s+", "")
    count = lambda p: F.regexp_count(flat, F.lit(p))
    mixed = (F.length(flat) <= 80) & (count(r"[\x{4e00}-\x{9fff}]") == 0) & (count(r"[-+−*/×÷^_]") >= 2) & (count(r"\p{L}") >= 1) & (count(r"\d") >= 1) & F.rlike(flat, F.lit(r"[()/^_]"))
    return F.rlike(flat, F.lit("[=＝∑√∫≈≤≥]")) | F.rlike(c, F.lit(r"(?i)\b(?:sqrt|sum|log|ln|exp|min|max|mean|var)\s*\(")) | mixed


def is_no_heading(c: Column, is_math: Column) -> Column:
    flat = F.regexp_replace(c, r"\s+", "")
    digits = F.regexp_count(flat, F.lit(r"\d")) / F.greatest(F.length(flat), F.lit(1))
    out = is_math | looks_like_formula(c) | F.rlike(c, F.lit(M.FIGURE_CAPTION)) | F.rlike(c, F.lit(M.TABLE_CAPTION)) | F.rlike(c, F.lit(M.DOI))
    out = out | T.has_any(T.fold(flat), ("doi:", "abstract", "关键词", "作者简介", "通信作者"))
    return out | F.rlike(flat, F.lit(r"^[-+±\d.·:：/％%()（）\[\]]+$")) | (digits > 0.65) | looks_like_sentence(c)


def heading_level(text: Column, font_size: Column, bold: Column, body: Column, is_math: Column | None = None) -> Column:
    """1 to 4, or null for a line that is no heading."""
    s = T.strip(text)
    ratio = font_size / F.greatest(body, F.lit(1.0))
    number = F.regexp_extract(s, M.NUMBERED_HEADING, 1)
    depth = F.least(F.lit(4), F.length(number) - F.length(F.replace(number, F.lit("."))) + 1)
    level = (
        F.when(F.rlike(s, F.lit(M.CHAPTER)), 1).when(F.length(number) > 0, depth).when(F.rlike(s, F.lit(M.CHINESE_HEADING)), 2)
        .when(ratio >= 1.45, 1).when(ratio >= 1.22, 2).when(bold & (ratio >= 1.05), 3)
    )
    return F.when((F.length(s) > 0) & (F.length(s) <= 48) & ~is_no_heading(s, F.lit(False) if is_math is None else is_math), level)


def section_paths(lines: DataFrame, level: str = "level") -> DataFrame:
    """Per line its path of headings: a heading ends all headings of its level or below. Folded in order for each document."""
    seq = F.array_sort(F.collect_list(F.struct("page", "line_no", F.col(level).alias("level"), "text")))
    none = F.array().cast("array<struct<level:int,text:string>>")
    start = F.struct(none.alias("stack"), F.array().cast("array<struct<page:int,line_no:int,path:array<string>>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["stack"], lambda h: h["level"] < x["level"])
        stack = F.when(x["level"].isNull(), acc["stack"]).otherwise(F.concat(kept, F.array(F.struct(x["level"].cast("int").alias("level"), x["text"].alias("text")))))
        row = F.struct(x["page"].cast("int").alias("page"), x["line_no"].cast("int").alias("line_no"), F.transform(stack, lambda h: h["text"]).alias("path"))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(row)).alias("out"))

    g = lines.groupBy("doc").agg(seq.alias("seq"))
    return g.select("doc", F.explode(F.aggregate("seq", start, step, lambda a: a["out"])).alias("r")).select("doc", "r.page", "r.line_no", F.col("r.path").alias("section_path"))


def combine_headers(rows: Column) -> Column:
    """Header rows joined by column with dots; parents are filled to the right except in the last row; equal parts once."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, T.strip), F.array_repeat(F.lit(""), width - F.size(r))))
    fill = lambda r: F.aggregate(r, F.array().cast("array<string>"), lambda a, v: F.concat(a, F.array(F.when((F.length(v) == 0) & (F.size(a) > 0), F.element_at(a, -1)).otherwise(v))))
    filled = F.transform(padded, lambda r, i: F.when(i < F.size(rows) - 1, fill(r)).otherwise(r))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.array_join(F.array_distinct(F.filter(F.transform(filled, lambda r: F.get(r, c)), lambda v: F.length(v) > 0)), "."))


def reading_order(lines: DataFrame, full_width: float = 0.62, gutter: float = 18.0, baseline: float = 3.0) -> DataFrame:
    """Adds reading: full-width lines cut a page into bands; in a band columns go left to right, lines top to bottom."""
    page = Window.partitionBy("doc", "page")
    wide = (F.col("x1") - F.col("x0")) >= full_width * F.col("page_width")
    x = lines.withColumn("wide", wide.cast("int"))
    x = x.withColumn("cuts", F.coalesce(F.sum("wide").over(page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("band", 2 * F.col("cuts") + F.col("wide"))
    by_x = Window.partitionBy("doc", "page", "band").orderBy("x0", "y0")
    x = x.withColumn("reach", F.max("x1").over(by_x.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("column", F.sum((F.coalesce(F.col("x0") - F.col("reach"), F.lit(0.0)) >= gutter).cast("int")).over(by_x))
    x = x.withColumn("row", F.round(F.col("y0") / baseline))
    order = page.orderBy("band", "column", "row", "x0")
    return x.withColumn("reading", F.row_number().over(order)).drop("wide", "cuts", "band", "reach", "column", "row")


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area of two boxes (x0, y0, x1, y1) by the smaller one's."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    small = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(small > 0, w * h / small).otherwise(0.0)


def continued_tables(tables: DataFrame) -> DataFrame:
    """Adds table_group: a table that starts at the top of the next page goes on with the one that ended at the bottom.

    ``tables`` has doc, page, x0, y0, x1, y1, page_height, n_columns, caption, headers (array), numeric_ratio. A table with a
    caption of its own never goes on. ``data_only`` says that the part has rows but no headers: numbers in its first row, or
    fewer than two headers of the table before.
    """
    w = Window.partitionBy("doc").orderBy("page", "y0")
    prev = lambda c: F.lag(c).over(w)
    names = lambda h: F.transform(h, lambda v: F.regexp_replace(T.fold(v), r"\s+", ""))
    shared = F.size(F.filter(F.array_intersect(names(F.col("headers")), names(prev("headers"))), lambda v: F.length(v) > 0))
    width = F.abs((F.col("x1") - F.col("x0")) - (prev("x1") - prev("x0")))
    joins = (
        (F.col("page") == prev("page") + 1) & (prev("y1") >= 0.72 * prev("page_height")) & (F.length(T.strip("caption")) == 0) & (F.col("y0") <= 0.22 * F.col("page_height"))
        & (F.col("n_columns") == prev("n_columns")) & (width < F.greatest(F.lit(30.0), 0.15 * (prev("x1") - prev("x0"))))
    )
    data_only = (F.coalesce("numeric_ratio", F.lit(0.0)) >= 0.45) | (F.coalesce(shared, F.lit(0)) < 2)
    x = tables.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("data_only", F.col("joins") & data_only)
    return x.withColumn("table_group", F.sum((~F.col("joins")).cast("int")).over(w)).drop("joins")


def nearest_caption(items: DataFrame, lines: DataFrame, pattern: str = M.TABLE_CAPTION, reach: float = 90.0) -> DataFrame:
    """Adds caption: the lowest caption line within ``reach`` above the item on its page."""
    caps = lines.where(F.rlike(T.strip("text"), F.lit(pattern))).select(F.col("doc").alias("c_doc"), F.col("page").alias("c_page"), F.col("text").alias("c_text"), F.col("y1").alias("c_y1"))
    on = (F.col("doc") == F.col("c_doc")) & (F.col("page") == F.col("c_page")) & (F.col("c_y1") <= F.col("y0")) & (F.col("c_y1") >= F.col("y0") - reach)
    best = items.join(caps, on).groupBy("item_id").agg(F.max_by("c_text", "c_y1").alias("caption"))
    return items.join(best, "item_id", "left")
