"""Regions of pages made from the documents' words (four columns, thirty rows a page) and from their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markers as M
from docloom.operators import layout, regions
from docloom.plans import sql as S
from docloom.plans.bindings import binding, table
from docloom.plans.stored import pieces
from docloom.plans.layout_bindings import _LINES, _NUMBERED, lines


def words(spark: SparkSession, sf_dir: str, spelling: bool = False) -> DataFrame:
    """Each word of a document as a positioned line; every second page starts with a table's caption. ``spelling`` adds the word itself.

    Documents are dealt out whole, before they become many rows: whatever goes by document and page is then done in place.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    d = d.repartition(pieces(spark, f"{sf_dir}/documents.parquet"), "doc")
    d = d.select("doc", F.posexplode(F.split("text", " ")).alias("i", "word"))
    page, at, n = (F.floor(F.col("i") / 120) + 1).cast("int"), F.col("i") % 120, F.length("word")
    x0 = 40.0 + 130 * (at % 4) + 4 * (n % 5)
    y0 = 30.0 + 22 * F.floor(at / 4) + F.col("i") % 3
    text = F.when(F.col("i") % 240 == 120, F.concat(F.lit("Table "), page.cast("string"))).otherwise(F.col("word"))
    return d.select(
        "doc", page.alias("page"), F.col("i").alias("line_no"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 12).alias("y1"),
        F.when(n > 9, 16.0).otherwise(11.0).alias("font_size"), F.lit(False).alias("bold"), (F.col("i") % 17 == 0).alias("is_math"), F.lit(700.0).alias("page_height"), F.lit(600.0).alias("page_width"), *(["word"] if spelling else []),
    )


_WORDS = """s AS (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
p AS (SELECT doc, i, word, (i // 120 + 1)::INT AS page, (40 + 130 * (i % 120 % 4) + 4 * (length(word) % 5))::DOUBLE AS x0, (30 + 22 * (i % 120 // 4) + i % 3)::DOUBLE AS y0 FROM s),
c AS (SELECT doc, page, i::INT AS line_no, CASE WHEN i % 240 = 120 THEN 'Table ' || page ELSE word END AS text, x0, y0, x0 + 60 AS x1, y0 + 12 AS y1, i % 17 = 0 AS is_math, CASE WHEN length(word) > 9 THEN 16.0 ELSE 11.0 END::DOUBLE AS font_size FROM p)"""


def _ids(values: str, gap: str) -> str:
    near = f"a.n > 0 AND abs(v - a.s / a.n) <= {gap}"
    step = f"CASE WHEN {near} THEN {{'s': a.s + v, 'n': a.n + 1, 'k': a.k, 'ids': a.ids || [a.k]}} ELSE {{'s': v, 'n': 1::DOUBLE, 'k': a.k + 1, 'ids': a.ids || [a.k + 1]}} END"
    return f"list_reduce({values}, lambda a, v: {step}, {{'s': 0::DOUBLE, 'n': 0::DOUBLE, 'k': 0::INT, 'ids': []::INT[]}}).ids"


def _section(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {S.lit(p)})" for p in (_NUMBERED, M.CHINESE_HEADING, M.CHAPTER)) + ")"


@binding(f"WITH {_LINES}, g AS (SELECT doc, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')))::BIGINT AS chars, max(page)::BIGINT AS pages FROM l GROUP BY doc) SELECT *, chars >= greatest(4, 4 * pages) AS has_text FROM g")
def text_layer(spark, sf_dir):
    return regions.text_layer(lines(spark, sf_dir))


@binding(f"""WITH {_WORDS}, r AS (SELECT doc, page, round_even(y0 / 4, 0) AS r, min(line_no) AS first, list(x0) AS xs FROM c WHERE length(text) <= 48 AND NOT is_math GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT a.doc, a.page, count(*) AS n FROM r a JOIN r b ON a.doc = b.doc AND a.page = b.page AND b.first > a.first WHERE len(list_filter(a.xs, lambda u: len(list_filter(b.xs, lambda v: abs(u - v) <= 14)) > 0)) >= 3 GROUP BY ALL),
g AS (SELECT doc, page, bool_or(regexp_matches({S.strip('text')}, {S.lit(M.TABLE_CAPTION)})) AS has_caption FROM c GROUP BY ALL)
SELECT g.doc, g.page, has_caption, coalesce(n, 0)::INT AS pairs, has_caption OR coalesce(n, 0) >= 2 AS probe FROM g LEFT JOIN q ON g.doc = q.doc AND g.page = q.page""")
def table_gate(spark, sf_dir):
    return regions.table_pages(words(spark, sf_dir)).drop("has_rules")


@binding(f"""WITH {_WORDS}, h AS (SELECT doc, page, line_no AS caption_no, y1 AS c_y1 FROM c WHERE regexp_matches({S.strip('text')}, {S.lit(M.TABLE_CAPTION)})),
k AS (SELECT c.*, h.caption_no, c.y0 - lag(c.y0) OVER w AS gap FROM c JOIN h ON c.doc = h.doc AND c.page = h.page AND c.y0 > c_y1 + 8 AND c.y0 < 644 WINDOW w AS (PARTITION BY c.doc, c.page, h.caption_no ORDER BY c.y0, c.x0, c.line_no)),
n AS (SELECT *, 1 + sum((coalesce(gap, 0) > 8)::INT) OVER (PARTITION BY doc, page, caption_no ORDER BY y0, x0, line_no) AS r FROM k),
t AS (SELECT *, (gap IS NOT NULL AND ({_section(S.strip('text'))} OR length(text) > 60 OR (gap > 28 AND lag(r) OVER (PARTITION BY doc, page, caption_no ORDER BY y0, x0, line_no) >= 2)))::INT AS stop FROM n),
m AS (SELECT * FROM (SELECT *, sum(stop) OVER (PARTITION BY doc, page, caption_no ORDER BY y0, x0, line_no) AS stops FROM t) WHERE stops = 0),
a AS (SELECT doc, page, caption_no, max(r) AS n_rows, list_sort(list(DISTINCT round(x0, 1)) FILTER (r <= 2)) AS xs FROM m GROUP BY ALL HAVING max(r) >= 2 AND len(list(DISTINCT round(x0, 1)) FILTER (r <= 2)) >= 3),
z AS (SELECT m.doc, m.page, m.caption_no, r, list_position(list_transform(xs, lambda v: abs(v - x0)), list_min(list_transform(xs, lambda v: abs(v - x0)))) AS k, string_agg(text, ' ' ORDER BY x0, line_no) AS v FROM m JOIN a ON m.doc = a.doc AND m.page = a.page AND m.caption_no = a.caption_no GROUP BY ALL),
f AS (SELECT doc, page, caption_no, n_rows, r, unnest(generate_series(1, len(xs))) AS k FROM (SELECT *, unnest(generate_series(1, n_rows::BIGINT)) AS r FROM a)),
y AS (SELECT f.doc, f.page, f.caption_no, f.r, f.n_rows, string_agg(coalesce(v, ''), chr(9) ORDER BY f.k) AS line FROM f LEFT JOIN z ON f.doc = z.doc AND f.page = z.page AND f.caption_no = z.caption_no AND f.r = z.r AND f.k = z.k GROUP BY ALL)
SELECT doc, page, caption_no, n_rows::INT AS n_rows, sha256(string_agg(line, chr(10) ORDER BY r)) AS content_hash FROM y GROUP BY ALL""")
def caption_tables(spark, sf_dir):
    x = regions.caption_tables(words(spark, sf_dir))
    return x.select("doc", "page", "caption_no", F.size("cells").alias("n_rows"), F.sha2(regions.table_content(F.col("cells")), 256).alias("content_hash"))


@binding(f"""WITH {_WORDS}, o AS (SELECT doc, page, list({{'i': line_no, 'x': x0, 't': text, 'm': (y0 + y1) / 2}} ORDER BY y0, x0, line_no) AS seq, list(x0 ORDER BY x0) AS xs FROM c GROUP BY ALL),
i AS (SELECT doc, page, seq, xs, {_ids("list_transform(seq, lambda t: t.m)", "6")} AS rid, {_ids("xs", "24")} AS cid FROM o),
b AS (SELECT doc, page, seq, rid, list_transform(generate_series(1, list_max(cid)::BIGINT), lambda k: list_avg(list_filter(xs, lambda v, j: cid[j] = k))) AS anchors FROM i WHERE list_max(rid) >= 2 AND list_max(cid) >= 2),
u AS (SELECT doc, page, anchors, unnest(seq) AS t, unnest(rid) AS r FROM b),
z AS (SELECT doc, page, r, list_position(list_transform(anchors, lambda v: abs(v - t.x)), list_min(list_transform(anchors, lambda v: abs(v - t.x)))) AS k, string_agg(t.t, ' ' ORDER BY t.x, t.i) AS v FROM u GROUP BY ALL),
f AS (SELECT doc, page, r, unnest(generate_series(1, n)) AS k FROM (SELECT doc, page, len(anchors) AS n, unnest(generate_series(1, list_max(rid)::BIGINT)) AS r FROM b)),
y AS (SELECT f.doc, f.page, f.r, count(*) AS n, string_agg(coalesce(v, ''), chr(9) ORDER BY f.k) AS line FROM f LEFT JOIN z ON f.doc = z.doc AND f.page = z.page AND f.r = z.r AND f.k = z.k GROUP BY ALL)
SELECT doc, page, count(*)::INT AS n_rows, any_value(n)::INT AS n_columns, sha256(string_agg(line, chr(10) ORDER BY r)) AS content_hash FROM y GROUP BY ALL""")
def table_grid(spark, sf_dir):
    x = regions.grid(words(spark, sf_dir), ("doc", "page"))
    return x.select("doc", "page", F.size("cells").alias("n_rows"), F.size(F.get("cells", 0)).alias("n_columns"), F.sha2(regions.table_content(F.col("cells")), 256).alias("content_hash"))


@binding(f"""WITH {_WORDS}, q AS (SELECT doc, page, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, page % 2 = 0 AS captioned, string_agg(text, chr(9) ORDER BY line_no) AS t FROM c GROUP BY ALL),
j AS (SELECT *, coalesce(page = lag(page) OVER w + 1 AND lag(y1) OVER w >= 504 AND NOT captioned AND y0 <= 154 AND abs((x1 - x0) - (lag(x1) OVER w - lag(x0) OVER w)) < greatest(30, 0.15 * (lag(x1) OVER w - lag(x0) OVER w)), false) AS joins FROM q WINDOW w AS (PARTITION BY doc ORDER BY page)),
g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc ORDER BY page) AS table_group FROM j)
SELECT doc, table_group::BIGINT AS table_group, min(page) AS page_start, max(page) AS page_end, count(*)::INT AS n_parts, sha256(string_agg(t, chr(10) ORDER BY page)) AS content_hash FROM g GROUP BY doc, table_group""")
def merged_tables(spark, sf_dir):
    row = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda t: t["text"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("page_height").alias("page_height")]
    t = words(spark, sf_dir).groupBy("doc", "page").agg(F.array(row).alias("cells"), *box)
    none = F.array().cast("array<string>")
    t = t.select("*", F.when(F.col("page") % 2 == 0, "Table").alias("caption"), F.lit(4).alias("n_columns"), F.lit(0.0).alias("numeric_ratio"), none.alias("headers"), F.lit(0).alias("n_header_rows"))
    x = regions.merged_tables(layout.continued_tables(t))
    return x.select("doc", "table_group", "page_start", "page_end", "n_parts", F.sha2(regions.table_content(F.col("cells")), 256).alias("content_hash"))


@binding(f"""WITH {_WORDS}, o AS (SELECT doc, page, list(x0 ORDER BY x0, line_no) AS xs, list({{'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}} ORDER BY x0, line_no) AS seq FROM c WHERE NOT is_math GROUP BY ALL),
u AS (SELECT doc, page, unnest(seq) AS t, unnest({_ids("xs", "36")}) AS k FROM o),
b AS (SELECT doc, page, k, count(*) AS n, min(t.x0) AS x0, max(t.x1) AS x1, min(t.y0) AS y0, max(t.y1) AS y1 FROM u GROUP BY ALL),
e AS (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1 FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY k))
SELECT doc, page, count(*)::INT AS n_columns, sum(n) >= 4 AND count(*) BETWEEN 2 AND 4 AND bool_and(n >= 2 AND y1 - y0 >= 24 AND (nx0 IS NULL OR (nx0 - x1 >= 21 AND greatest(0, least(y1, ny1) - greatest(y0, ny0)) / greatest(least(y1 - y0, ny1 - ny0), 1) >= 0.45))) AS confident FROM e GROUP BY ALL""")
def column_confidence(spark, sf_dir):
    return regions.confident_columns(words(spark, sf_dir))


@binding(f"""WITH {_LINES}, x AS (SELECT doc, page, line_no, text, 50 + line_no % 3 * 20 AS x0, y0, y1, (font_size >= 11 * 1.35) AS t FROM l),
f AS (SELECT *, coalesce(t AND lead(t) OVER w AND abs(lead(x0) OVER w - x0) <= 35 AND lead(y0) OVER w - y1 BETWEEN 0 AND 24, false) AS fits FROM x WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
g AS (SELECT *, sum((NOT before)::INT) OVER (PARTITION BY doc, page ORDER BY line_no) AS run FROM (SELECT *, coalesce(lag(fits) OVER (PARTITION BY doc, page ORDER BY line_no), false) AS before FROM f)),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc, page, run ORDER BY line_no) - 1) // 2 AS pair FROM g)
SELECT doc, page::INT AS page, min(line_no) AS line_no, sha256(string_agg(text, ' ' ORDER BY line_no)) AS text_hash, count(*) > 1 AS merged FROM k GROUP BY doc, page, run, pair""")
def merge_headings(spark, sf_dir):
    x0 = 50.0 + F.col("line_no") % 3 * 20
    x = lines(spark, sf_dir).withColumn("x0", x0).withColumn("x1", x0 + 220).withColumn("is_math", F.lit(False)).withColumn("body_size", F.lit(11.0))
    return regions.merge_headings(x).select("doc", "page", "line_no", F.sha2("text", 256).alias("text_hash"), (F.col("y1") - F.col("y0") > 12).alias("merged"))


_KIND = "CASE WHEN line_no % 13 = 5 THEN 'table' WHEN line_no % 29 = 7 THEN 'formula' WHEN line_no % 31 = 9 THEN 'figure' ELSE 'line' END"


@binding(f"""WITH {_LINES}, k AS (SELECT *, {_KIND} AS kind FROM l), v AS (SELECT *, CASE WHEN kind = 'line' AND font_size > 12 THEN line_no % 2 + 1 END AS level FROM k),
b AS (SELECT *, kind <> 'line' OR level IS NOT NULL OR lag(kind) OVER w IS NULL OR lag(page) OVER w <> page OR lag(kind) OVER w <> 'line' AS cut FROM v WINDOW w AS (PARTITION BY doc ORDER BY page, line_no)),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc ORDER BY page, line_no) - 1 AS sequence FROM b)
SELECT doc, page::INT AS page, sequence::BIGINT AS sequence, CASE WHEN first(kind) IN ('line', 'formula') THEN 'text' ELSE first(kind) END AS node_type, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS content_hash, count(*) AS line_count,
  any_value(level)::INT AS heading_level FROM g GROUP BY doc, page, sequence""")
def page_nodes(spark, sf_dir):
    kind = F.when(F.col("line_no") % 13 == 5, "table").when(F.col("line_no") % 29 == 7, "formula").when(F.col("line_no") % 31 == 9, "figure").otherwise("line")
    x = lines(spark, sf_dir).withColumn("kind", kind).withColumn("reading", F.col("line_no"))
    x = x.withColumn("level", F.when((F.col("kind") == "line") & (F.col("font_size") > 12), F.col("line_no") % 2 + 1))
    return regions.page_nodes(x).select("doc", "page", "sequence", "node_type", F.sha2("content", 256).alias("content_hash"), "line_count", "heading_level")


@binding("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber::INT AS page, l_quantity::DOUBLE * 8 AS w, l_discount::DOUBLE * 40 AS dy, CASE WHEN l_linenumber % 2 = 0 THEN 're' ELSE 'l' END AS kind FROM lineitem)
SELECT doc, page, 10::DOUBLE AS x0, 10 + w AS x1, unnest(CASE WHEN kind = 're' THEN [50::DOUBLE, 50 + dy] ELSE [50 + dy / 2] END) AS y FROM r WHERE w >= 180 AND (kind = 're' OR dy <= 2)""")
def horizontal_rules(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    w, dy, page = F.col("l_quantity").cast("double") * 8, F.col("l_discount").cast("double") * 40, F.col("l_linenumber").cast("int")
    kind = F.when(page % 2 == 0, "re").otherwise("l")
    d = r.select(F.col("l_orderkey").alias("doc"), page.alias("page"), kind.alias("kind"), (w + 10).alias("x0"), F.lit(50.0).alias("y0"), F.lit(10.0).alias("x1"), (dy + 50).alias("y1"), F.lit(600.0).alias("page_width"))
    return regions.horizontal_rules(d)


_VERB = r"(?i)^(?:图|fig\.?|figure)\s*[\d一二三四五六七八九十]+\s*为"


@binding(f"""WITH {_LINES}, x AS (SELECT doc, page, line_no, CASE WHEN line_no % 11 = 3 THEN 'Figure ' || (line_no // 11) || ' plan' ELSE text END AS text, y0, y1 FROM l),
c AS (SELECT *, coalesce(lag(y1) OVER w, 0) AS above, row_number() OVER w AS figure FROM x WHERE regexp_matches({S.squeeze('text')}, {S.lit(M.FIGURE_CAPTION)}) AND length({S.squeeze('text')}) <= 100 AND NOT regexp_matches({S.squeeze('text')}, {S.lit(_VERB)}) WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
v AS (SELECT doc, page, y0, y1, CASE WHEN line_no % 2 = 0 THEN 'image' ELSE 'drawing' END AS kind FROM x WHERE line_no % 5 = 1),
f AS (SELECT c.doc, c.page, c.figure, CASE WHEN count(kind) = 0 THEN 'caption_only' WHEN min(kind) <> max(kind) THEN 'mixed' ELSE min(kind) END AS visual_kind, least(min(v.y0), min(c.y0)) AS y0, greatest(max(v.y1), max(c.y1)) AS y1
  FROM c LEFT JOIN v ON c.doc = v.doc AND c.page = v.page AND v.y1 BETWEEN greatest(c.above, c.y0 - 280) AND c.y0 + 2 GROUP BY ALL),
t AS (SELECT f.doc, f.page, f.figure, x.text, x.line_no, least(abs(x.y1 - f.y0), abs(x.y0 - f.y1)) AS apart FROM f JOIN x ON f.doc = x.doc AND f.page = x.page WHERE NOT regexp_matches({S.strip('x.text')}, {S.lit(M.FIGURE_CAPTION)}) AND NOT regexp_matches({S.strip('x.text')}, {S.lit(M.TABLE_CAPTION)})),
n AS (SELECT doc, page, figure, string_agg(text, chr(31) ORDER BY apart, line_no) AS near FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, figure ORDER BY apart, line_no) AS nth FROM t WHERE apart <= 96) WHERE nth <= 3 GROUP BY ALL)
SELECT f.doc, f.page::INT AS page, f.figure::INT AS figure, visual_kind, f.y0, f.y1, sha256(coalesce(near, '')) AS near_hash FROM f LEFT JOIN n ON f.doc = n.doc AND f.page = n.page AND f.figure = n.figure""")
def figures(spark, sf_dir):
    text = F.when(F.col("line_no") % 11 == 3, F.concat(F.lit("Figure "), F.floor(F.col("line_no") / 11).cast("string"), F.lit(" plan"))).otherwise(F.col("text"))
    x = lines(spark, sf_dir).withColumn("text", text).withColumn("is_math", F.lit(False))
    v = x.where("line_no % 5 = 1").select("doc", "page", F.when(F.col("line_no") % 2 == 0, "image").otherwise("drawing").alias("kind"), *regions.BOX)
    return regions.figures(x, v).select("doc", "page", "figure", "visual_kind", "y0", "y1", F.sha2(F.array_join("nearby_text", "\x1f"), 256).alias("near_hash"))


@binding(f"""WITH {_WORDS}, g AS (SELECT doc, page, line_no // 4 AS line, string_agg(word, '' ORDER BY line_no) AS text, max(font_size) AS font_size, bool_or(line_no % 7 = 0 OR contains(lower(word), 'bold')) AS bold, min(x0) AS x0, max(x1) AS x1
  FROM (SELECT c.*, p.word || ' ' AS word FROM c JOIN p ON c.doc = p.doc AND c.line_no = p.i) GROUP BY ALL)
SELECT doc, page, line::BIGINT AS line_no, sha256({S.squeeze('text')}) AS text_hash, font_size, bold, x0, x1 FROM g WHERE length({S.squeeze('text')}) > 0""")
def lines_from_spans(spark, sf_dir):
    s = words(spark, sf_dir, spelling=True).select("doc", "page", F.floor(F.col("line_no") / 4).alias("line_no"), F.col("line_no").alias("span_no"), F.concat("word", F.lit(" ")).alias("text"), F.col("font_size").alias("size"), F.col("word").alias("font"), (F.col("line_no") % 7 == 0).alias("bold"), *regions.BOX)
    return regions.lines_from_spans(s).select("doc", "page", "line_no", F.sha2("text", 256).alias("text_hash"), "font_size", "bold", "x0", "x1")
