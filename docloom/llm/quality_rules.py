"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Counts come from built-in functions over each row alone, so nothing is shuffled. Repeated five-word windows are found by
sorting 64-bit window hashes with their places; the sort runs only for texts in which some hash occurs twice.

Defined results: null text has no words and fails; empty tables give empty results; repeated rows each get a row; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 5
#: frequent function words (English, German, French, Spanish)
STOP_WORDS = tuple("the of and to in is was it for on as with by der die und das den von zu mit des auf le la les de et un une en est que el los y se del las por con".split())


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``, where the text has at least ``least_words`` words."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    least_words: int = 10


RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols a word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations a word", "n_exclamations", "n_words", None, 0.4),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop words", "n_stop_words", "n_words", 0.01, None, 100),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all rules hold. Bounds are compared as products, so no row divides by zero."""
    verdict = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.numerator) >= F.lit(r.low) * F.col(r.denominator))
        if r.high is not None:
            ok = ok & (F.col(r.numerator) <= F.lit(r.high) * F.col(r.denominator))
        verdict = verdict & ((F.col("n_words") < r.least_words) | ok)
    return verdict


def _repeats() -> tuple[Column, Column]:
    """Window hashes qr_h with their places, sorted (to be qr_s); from qr_s, the places of hashes that occur twice or more."""
    placed = F.sort_array(F.transform("qr_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(
        F.filter(F.col("qr_s"), lambda s, k: s["h"].eqNullSafe(F.get(F.col("qr_s"), k - 1)["h"]) | s["h"].eqNullSafe(F.get(F.col("qr_s"), k + 1)["h"])),
        lambda s: s["i"],
    )
    return placed, F.sort_array(twice)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_exclamations, n_stop_words, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.withColumn("qr_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    x = x.withColumn("qr_l", F.filter(F.split(text, "\n"), lambda s: F.length(F.btrim(s, F.lit(SPACE))) > 0))
    x = x.withColumn("qr_x", F.transform("qr_w", lambda w: F.xxhash64(w)))
    size = F.size("qr_w").cast("long")
    x = x.withColumn("n_words", size)
    hashes = F.transform(
        F.slice("qr_x", 1, F.greatest(F.size("qr_x") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("qr_x"), i + j) for j in range(1, WINDOW)]),
    )
    x = x.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("qr_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
        F.size(F.filter("qr_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("qr_l").cast("long").alias("n_lines"),
        (F.size("qr_l") - F.size(F.array_distinct("qr_l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("qr_h"),
    )
    placed, twice = _repeats()
    x = x.withColumn("qr_s", F.when(F.size(F.array_distinct("qr_h")) < F.size("qr_h"), placed))
    x = x.withColumn("qr_i", F.when(F.col("qr_s").isNotNull(), twice))
    gaps = F.transform("qr_i", lambda i, k: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("qr_i"), k + 1) - i), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("qr_h", "qr_s", "qr_i")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    x = counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM twice GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_ex,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.rid = rep.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 12.0 * n_words AND n_symbols <= 0.1::DOUBLE * n_words
       AND n_ex <= 0.4::DOUBLE * n_words AND n_dup_lines <= 0.5 * n_lines AND (n_words < 100 OR n_stop >= 0.01::DOUBLE * n_words) AS kept
FROM f
"""
