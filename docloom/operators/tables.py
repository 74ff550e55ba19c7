"""Tables inside documents: headers, column profiles, row groups, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.numbers import NUMBER
from docloom.functions.text import strip, text_of

GROUP_ROWS, PROFILE_ROWS, KEY_RATIO = 50, 50, 0.6


def normalise_headers(c: Column) -> Column:
    """Blank names become column_i; a repeated name gets the number of its occurrence."""
    base = F.transform(c, lambda v, i: F.coalesce(F.nullif(strip(v), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    nth = lambda v, i: F.size(F.filter(F.slice(base, 1, i + 1), lambda w: w == v))
    return F.transform(base, lambda v, i: F.when(nth(v, i) == 1, v).otherwise(F.concat(v, F.lit("_"), nth(v, i).cast("string"))))


def cell_kind(c: Column) -> Column:
    s = strip(c)
    bare = F.replace(s, F.lit(","))
    return (
        F.when(F.length(s) == 0, "blank").when(F.rlike(bare, F.lit(NUMBER)), "number").when(F.rlike(bare, F.lit(r"^[+-]?[\d.]+[%％]$")), "percentage").when(F.rlike(s, F.lit(r"^[¥￥$€£]\s*[\d.,]+$")), "currency")
        .when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}$")), "date").when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}")), "datetime").when(F.rlike(s, F.lit(r"(?i)^(true|false)$")), "boolean").otherwise("text")
    )


def profile_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` has keys, position, column, row_number and value; the first rows decide.

    Returns the dominant kind (most frequent; on ties the name last in order), and whether the column is a metric or the
    table's key column (its first text column with enough distinct values).
    """
    x = cells.where(F.col("row_number") <= PROFILE_ROWS).withColumn("kind", cell_kind(F.col("value")))
    kinds = x.where("kind != 'blank'").groupBy(*keys, "position", "column", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.groupBy(*keys, "position", "column").agg(F.max(F.struct("n", "kind")).alias("k"))
    every = x.groupBy(*keys, "position", "column").agg(F.countDistinct(F.when(F.col("kind") != "blank", F.col("value"))).alias("distinct"), F.sum((F.col("kind") != "blank").cast("long")).alias("filled"))
    out = every.join(top, [*keys, "position", "column"], "left").withColumn("kind", F.coalesce("k.kind", F.lit("blank")))
    out = out.withColumn("candidate", (F.col("kind") == "text") & (F.col("distinct") >= KEY_RATIO * F.col("filled")))
    first = Window.partitionBy(*keys)
    return out.select(
        *keys, "position", "column", "kind", F.col("kind").isin("number", "percentage", "currency").alias("is_metric"),
        (F.col("candidate") & (F.col("position") == F.min(F.when(F.col("candidate"), F.col("position"))).over(first))).alias("is_key"),
    )


def row_groups(rows: DataFrame, keys: list[str], header: Column, cells: Column, first_row: int = 2, size: int = GROUP_ROWS) -> DataFrame:
    """Rows (row_number from ``first_row``) gathered into text blocks: a header line and a tabbed line a row."""
    x = rows.select(*keys, "row_number", header.alias("header"), F.array_join(cells, "\t").alias("line"), F.floor((F.col("row_number") - first_row) / size).cast("int").alias("row_group"))
    g = x.groupBy(*keys, "row_group").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("rows"))
    return g.select(*keys, "row_group", F.concat_ws("\n", F.array_join("header", "\t"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("content"), F.transform("rows", lambda r: r["row_number"]).alias("row_numbers"))


def explode_rows(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Back from text blocks to rows: row_number and cells, a map from header to stripped text."""
    x = groups.withColumn("lines", F.split("content", "\n")).withColumn("head", F.transform(F.split(F.element_at("lines", 1), "\t"), strip))
    x = x.select(*keys, "row_numbers", "head", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line"))
    x = x.where(F.length(strip("line")) > 0).withColumn("row_number", F.get("row_numbers", F.col("pos"))).where("row_number IS NOT NULL")
    values = F.transform(F.split("line", "\t"), strip)
    n = F.least(F.size("head"), F.size(values))
    return x.select(*keys, "row_number", F.map_from_arrays(F.slice("head", 1, n), F.slice(values, 1, n)).alias("cells"))


def markdown(rows: Column) -> Column:
    """An array of rows as a Markdown table; short rows are padded, bars escaped, line breaks become spaces."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    clean = lambda v: F.regexp_replace(F.replace(text_of(v), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(rows))), "\n")).otherwise("")
