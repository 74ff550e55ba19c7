"""SQL fragments of the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from docloom.functions import markers as M

SP = r"[ \t\n\x0B\f\r]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strs(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{SP}+', ' ', 'g')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def cjk(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')"


def grams(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) >= {n} THEN list_transform(generate_series(1, length({c}) - {n - 1}), lambda i: substr({c}, i, {n})) ELSE [] END)"


def tokens(x: str) -> str:
    f = fold(x)
    c = cjk(f)
    return rf"(regexp_extract_all({f}, '[a-z0-9]+(?:[._%/\-][a-z0-9]+)*%?') || {grams(c, 4)} || {grams(c, 3)} || {grams(c, 2)} || {grams(c, 1)})"


def lexical(x: str) -> str:
    c = cjk(f"lower({x})")
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}') || {grams(c, 1)} || {grams(c, 2)} || {grams(c, 3)} || {grams(c, 4)})"


def rerank_terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}') || {grams(cjk(f'lower({x})'), 1)})"


def has_any(x: str, words) -> str:
    return f"(len(list_filter({strs(words)}, lambda m: contains({x}, m))) > 0)"


def count_any(x: str, words) -> str:
    return f"len(list_filter({strs(words)}, lambda m: contains({x}, m)))"


def intent(q: str, t: str) -> str:
    q, t = fold(q), fold(t)
    times = f"len(regexp_extract_all({t}, {lit(M.TIME_VALUE)}))"
    return f"""(CASE WHEN length({q}) > 0 AND length({t}) > 0 THEN
      CASE WHEN {has_any(q, M.TIME_QUERY)} THEN (CASE WHEN {times} > 0 THEN least(0.8, 0.35 + 0.15 * ({times} - 1)) ELSE 0 END) + (CASE WHEN {has_any(t, M.DEADLINE_TEXT)} THEN 0.2 ELSE 0 END) ELSE 0 END
      + CASE WHEN {has_any(q, M.QUANTITY_QUERY)} AND regexp_matches({t}, {lit(M.NUMBER_VALUE)}) THEN 0.35 ELSE 0 END
      + CASE WHEN {has_any(q, M.PROCESS_QUERY)} THEN least(0.32, 0.08 * {count_any(t, M.PROCESS_TEXT)}) ELSE 0 END
      + CASE WHEN {has_any(q, M.SUMMARY_QUERY)} THEN least(0.36, 0.12 * {count_any(t, M.SUMMARY_SECTION)}) ELSE 0 END
    ELSE 0 END)::DOUBLE"""


def noise(text: str) -> str:
    t = strip(text)
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda s: {strip('s')}), lambda s: length(s) > 0)"
    pages = f"len(list_filter({lines}, lambda s: regexp_matches(s, {lit(M.PAGE_NUMBER_LINE)})))"
    share = f"(len(list_distinct({lines}))::DOUBLE / len({lines}))"
    letters = rf"length(regexp_replace({t}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return f"""(CASE WHEN length({t}) = 0 THEN 0.8::DOUBLE ELSE least(1.0::DOUBLE,
      0.5::DOUBLE * {pages} / len({lines})
      + CASE WHEN len({lines}) >= 4 AND {share} < 0.6 THEN (0.6 - {share}) * 0.75 ELSE 0 END
      + CASE WHEN {letters}::DOUBLE / length({t}) < 0.35 THEN 0.35 ELSE 0 END
      + CASE WHEN length({t}) < 160 AND (regexp_matches({t}, {lit(M.URL)}) OR regexp_matches({t}, {lit(M.EMAIL)})) THEN 0.15 ELSE 0 END) END)"""


CHUNKS = f"""chunks AS (
  SELECT doc_id, source, i::INT AS chunk_index, {strip('substr(text, (i * 780 + 1)::BIGINT, 900)')} AS content
  FROM (SELECT *, unnest(generate_series(0, ceil(greatest(length(text) - 900, 0) / 780.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0))"""

BM25 = f"""{CHUNKS},
tk AS (SELECT doc_id, chunk_index, {tokens('content')} AS t FROM chunks),
stat AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tk),
post AS (SELECT doc_id, chunk_index, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, chunk_index, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (
  SELECT DISTINCT query_id, term FROM (
    SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM (
      SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM (SELECT query_id, {tokens('query')} AS tt FROM q)) GROUP BY ALL))
  WHERE nth <= 96),
bm AS (
  SELECT query_id, doc_id, chunk_index,
         round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END)
                   * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) CROSS JOIN stat GROUP BY ALL)"""

LEXICAL = f"""{CHUNKS},
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
lt AS (SELECT doc_id, chunk_index, {lexical('content')} AS t FROM chunks),
lq AS (SELECT query_id, {lexical('query')} AS t FROM q),
shared AS (
  SELECT query_id, doc_id, chunk_index, n_query, n_text, count(*) AS shared
  FROM (SELECT query_id, len(t) AS n_query, unnest(t) AS term FROM lq) JOIN (SELECT doc_id, chunk_index, len(t) AS n_text, unnest(t) AS term FROM lt) USING (term) GROUP BY ALL),
lex AS (SELECT *, round(0.75::DOUBLE * shared / n_query + 0.25::DOUBLE * shared / greatest(sqrt(n_text), 1.0), 6) AS score FROM shared)"""


def top(cte: str, k: int, score: str = "score") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id, chunk_index) AS rank FROM {cte}) WHERE rank <= {k}"
