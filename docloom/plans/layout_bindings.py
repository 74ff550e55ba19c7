"""Layout operators over positioned lines made from the documents' lines: thirty lines a page, in two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markers as M
from docloom.operators import layout
from docloom.plans import sql as S
from docloom.plans.bindings import _literal, binding, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    page, at = F.floor(F.col("i") / 30).cast("int") + 1, F.col("i") % 30
    x = F.when(at % 2 == 0, 50.0).otherwise(320.0)
    size = F.when(F.length("text") < 30, 16.0).otherwise(F.when(F.col("i") % 3 == 0, 10.0).otherwise(11.0))
    y = (at * 25).cast("double")
    return d.select(F.col("doc_id").alias("doc"), page.alias("page"), F.col("i").alias("line_no"), "text", x.alias("x0"), y.alias("y0"), (x + 220).alias("x1"), (y + 12).alias("y1"), size.alias("font_size"), (F.col("i") % 7 == 0).alias("bold"), F.lit(800.0).alias("page_height"), F.lit(600.0).alias("page_width"))


_LINES = """l AS (SELECT doc_id AS doc, (i - 1) // 30 + 1 AS page, (i - 1)::INT AS line_no, s AS text, ((i - 1) % 30 * 25)::DOUBLE AS y0, ((i - 1) % 30 * 25 + 12)::DOUBLE AS y1,
  CASE WHEN length(s) < 30 THEN 16.0::DOUBLE WHEN (i - 1) % 3 = 0 THEN 10.0::DOUBLE ELSE 11.0::DOUBLE END AS font_size, (i - 1) % 7 = 0 AS bold
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@binding(f"""WITH {_LINES}, w AS (SELECT doc, font_size, sum(length(trim(text, ' \t\n\r'))) AS w FROM l WHERE length(trim(text, ' \t\n\r')) > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc ORDER BY font_size) AS upto, sum(w) OVER (PARTITION BY doc) AS total FROM w)
SELECT doc, min(font_size) AS body_size FROM c WHERE upto >= total / 2.0 GROUP BY doc""")
def weighted_median(spark, sf_dir):
    return layout.body_size(lines(spark, sf_dir))


_KEY = rf"CASE WHEN y1 <= 96 OR y0 >= 704 THEN regexp_replace({S.fold(S.squeeze('text'))}, '\d+', '#', 'g') END"


@binding(f"""WITH {_LINES}, k AS (SELECT *, {_KEY} AS key FROM l), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc),
a AS (SELECT doc, key, any_value(pages) AS pages FROM k JOIN p USING (doc) WHERE key IS NOT NULL GROUP BY doc, key HAVING count(DISTINCT page) >= greatest(2, ceil(any_value(pages) / 2.0)))
SELECT k.doc, k.page::INT AS page, k.line_no, k.key IS NOT NULL AND (regexp_matches({S.strip('k.text')}, {S.lit(M.LAYOUT_PAGE_NUMBER)}) OR a.key IS NOT NULL) AS noise FROM k LEFT JOIN a USING (doc, key)""")
def margin_noise(spark, sf_dir):
    return layout.margin_noise(lines(spark, sf_dir)).select("doc", "page", "line_no", "noise")


def _no_heading_sql(s: str) -> str:
    flat, n = f"regexp_replace({s}, '\\s+', '', 'g')", lambda x, p: f"len(regexp_extract_all({x}, {S.lit(p)}))"
    hit = lambda x, p: f"regexp_matches({x}, {S.lit(p)})"
    mixed = f"(length({flat}) <= 80 AND {n(flat, '[\\x{4e00}-\\x{9fff}]')} = 0 AND {n(flat, '[-+−*/×÷^_]')} >= 2 AND {n(flat, '\\p{L}')} >= 1 AND {n(flat, '[0-9]')} >= 1 AND {hit(flat, '[()/^_]')})"
    formula = f"({hit(flat, '[=＝∑√∫≈≤≥]')} OR {hit(s, r'(?i)\b(?:sqrt|sum|log|ln|exp|min|max|mean|var)\s*\(')} OR {mixed})"
    sentence = f"(length({flat}) > 48 OR (length({flat}) > 28 AND {hit(s, '[。！？；，,.;!?]')}) OR {n(s, '[A-Za-z]+(?:[-' + chr(39) + '][A-Za-z]+)?')} > 10)"
    words = S.has_any(S.fold(flat), ("doi:", "abstract", "关键词", "作者简介", "通信作者"))
    marks = f"{hit(flat, r'^[-+±0-9.·:：/％%()（）\[\]]+$')} OR {n(flat, '[0-9]')}::DOUBLE / greatest(length({flat}), 1) > 0.65"
    return f"({formula} OR {hit(s, M.FIGURE_CAPTION)} OR {hit(s, M.TABLE_CAPTION)} OR {hit(s, M.DOI)} OR {words} OR {marks} OR {sentence})"


_NUMBERED = M.NUMBERED_HEADING.replace("(?=", "(?:")  # this dialect has no lookahead; what follows is not captured


@binding(f"""WITH {_LINES}, w AS (SELECT doc, font_size, sum(length({S.strip('text')})) AS w FROM l WHERE length({S.strip('text')}) > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc ORDER BY font_size) AS upto, sum(w) OVER (PARTITION BY doc) AS total FROM w), b AS (SELECT doc, min(font_size) AS body FROM c WHERE upto >= total / 2.0 GROUP BY doc),
s AS (SELECT doc, line_no, bold, {S.strip('text')} AS s, font_size / greatest(body, 1.0) AS ratio, regexp_extract({S.strip('text')}, {S.lit(_NUMBERED)}, 1) AS number FROM l JOIN b USING (doc))
SELECT doc, line_no, CASE WHEN length(s) = 0 OR length(s) > 48 OR {_no_heading_sql('s')} THEN NULL WHEN regexp_matches(s, {S.lit(M.CHAPTER)}) THEN 1
  WHEN length(number) > 0 THEN least(4, length(number) - length(replace(number, '.', '')) + 1) WHEN regexp_matches(s, {S.lit(M.CHINESE_HEADING)}) THEN 2
  WHEN ratio >= 1.45 THEN 1 WHEN ratio >= 1.22 THEN 2 WHEN bold AND ratio >= 1.05 THEN 3 END::INT AS level FROM s""")
def heading_level(spark, sf_dir):
    x = lines(spark, sf_dir)
    x = x.join(layout.body_size(x), "doc")
    return x.select("doc", "line_no", layout.heading_level(F.col("text"), F.col("font_size"), F.col("bold"), F.col("body_size")).alias("level"))


@binding(f"WITH {_LINES} SELECT doc, page::INT AS page, line_no, row_number() OVER (PARTITION BY doc, page ORDER BY line_no % 2, line_no)::INT AS reading FROM l")
def reading_order(spark, sf_dir):
    return layout.reading_order(lines(spark, sf_dir)).select("doc", "page", "line_no", "reading")


@binding(f"""WITH {_LINES}, v AS (SELECT *, CASE WHEN font_size > 12 THEN line_no % 2 + 1 END AS lv FROM l),
h AS (SELECT doc, page, line_no, max(CASE WHEN lv = 1 THEN line_no END) OVER w AS i, max(CASE WHEN lv = 2 THEN line_no END) OVER w AS j,
  last_value(CASE WHEN lv = 1 THEN text END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN lv = 2 THEN text END IGNORE NULLS) OVER w AS b FROM v WINDOW w AS (PARTITION BY doc ORDER BY page, line_no))
SELECT doc, page::INT AS page, line_no, CASE WHEN i IS NULL THEN [] ELSE [a] END || CASE WHEN j IS NULL OR j < coalesce(i, -1) THEN [] ELSE [b] END AS section_path FROM h""")
def section_paths(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("level", F.when(F.col("font_size") > 12, F.when(F.col("line_no") % 2 == 0, 1).otherwise(2)))
    return layout.section_paths(x)


@binding()
def header_fill(spark, sf_dir):
    rows = [(1, [["Sample", "Training", "", "Prediction", ""], ["", "Rc", "RMSEC", "Rp", "RMSEP"]]), (2, [["a", "b"]])]
    return _literal(spark, rows, "id int, rows array<array<string>>").select("id", layout.combine_headers(F.col("rows")).alias("header"))
