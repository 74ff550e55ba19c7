"""Ranking signals: query intent bonus and noise penalty, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import markers as M
from docloom.functions import text as T


def is_summary_query(query: Column | str) -> Column:
    return T.has_any(T.fold(query), M.SUMMARY_QUERY)


def intent_parts(text: Column | str) -> Column:
    """What a text gives to each intent, whatever the query: n (its length), time, amount, process, summary."""

    def of(t: Column) -> Column:
        times = F.regexp_count(t, F.lit(M.TIME_VALUE))
        when_asked = T.bound(times, lambda n: F.when(n > 0, F.least(F.lit(0.8), 0.35 + 0.15 * (n - 1))).otherwise(0.0)) + F.when(T.has_any(t, M.DEADLINE_TEXT), 0.2).otherwise(0.0)
        amount = F.when(F.rlike(t, F.lit(M.NUMBER_VALUE)), 0.35).otherwise(0.0)
        process = F.least(F.lit(0.32), 0.08 * T.count_any(t, M.PROCESS_TEXT))
        summary = F.least(F.lit(0.36), 0.12 * T.count_any(t, M.SUMMARY_SECTION))
        return F.struct(F.length(t).alias("n"), when_asked.alias("time"), amount.alias("amount"), process.alias("process"), summary.alias("summary"))

    return T.bound(T.fold(text), of)


def intent_of(query: Column | str, parts: Column) -> Column:
    """The bonus of a query for a text with these ``intent_parts``."""
    q, total = T.fold(query), F.lit(0.0)
    for asked, value in ((M.TIME_QUERY, "time"), (M.QUANTITY_QUERY, "amount"), (M.PROCESS_QUERY, "process"), (M.SUMMARY_QUERY, "summary")):
        total = total + F.when(T.has_any(q, asked), parts[value]).otherwise(0.0)
    return F.when((F.length(q) > 0) & (parts["n"] > 0), total).otherwise(0.0)


def intent_bonus(query: Column | str, text: Column | str) -> Column:
    return T.bound(intent_parts(text), lambda p: intent_of(query, p))


def noise_penalty(text: Column | str) -> Column:
    def of(t: Column, lines: Column) -> Column:
        n = F.size(lines)
        pages = F.size(F.filter(lines, lambda s: F.rlike(s, F.lit(M.PAGE_NUMBER_LINE))))
        distinct = F.size(F.array_distinct(lines)) / n
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
        total = (
            F.when(n > 0, 0.5 * pages / n).otherwise(0.0)
            + F.when(n >= 4, T.bound(distinct, lambda d: F.when(d < 0.6, (0.6 - d) * 0.75).otherwise(0.0))).otherwise(0.0)
            + F.when(letters / F.length(t) < 0.35, 0.35).otherwise(0.0)
            + F.when((F.length(t) < 160) & (F.rlike(t, F.lit(M.URL)) | F.rlike(t, F.lit(M.EMAIL))), 0.15).otherwise(0.0)
        )
        return F.when(F.length(t) == 0, 0.8).otherwise(F.least(F.lit(1.0), total))

    def lines(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), T.strip), lambda s: F.length(s) > 0)

    return T.bound(T.strip(text), lambda t: T.bound(lines(t), lambda held: of(t, held)))


def rerank_score(query: Column | str, text: Column | str, score: Column) -> Column:
    """Rule reranking: shared terms, the retrieval score, and the two signals."""
    q = T.rerank_terms(query)
    shared = F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.rerank_terms(text))) / F.size(q)).otherwise(0.0)
    return 2.0 * shared + 0.35 * score + intent_bonus(query, text) - noise_penalty(text)
