"""Conversation tables: state, recent context, search, retention, export, summaries, follow-ups, cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import markers as M
from docloom.functions import text as T

TITLE_CHARS, RECENT, SUMMARY_AT, RETENTION_DAYS, CACHE_DAYS = 80, 10, 6, 90, 7


def state(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Message count, last turn, and the title: the start of the first user message."""
    title = F.min_by(F.col("text"), F.when(F.col("role") == "user", F.col(turn)))
    return messages.groupBy(conv).agg(F.count(F.lit(1)).alias("message_count"), F.max(turn).alias("last_turn"), F.substring(title, 1, TITLE_CHARS).alias("title"), F.sum((F.col("role") == "user").cast("long")).alias("user_messages"))


def recent(messages: DataFrame, n: int = RECENT, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def last_assistant(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_answer", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w))


def search(messages: DataFrame, keyword: str, limit: int = 50, offset: int = 0, order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Messages that hold the keyword whatever its case; a page of them."""
    return messages.where(F.contains(F.lower("text"), F.lit(keyword.lower()))).orderBy(*order).offset(offset).limit(limit)


def expire(conversations: DataFrame, messages: DataFrame, cutoff: Column, conv: str = "conv_id", updated: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """Conversations touched since the cutoff, and their messages."""
    kept = conversations.where(F.col(updated) >= cutoff)
    return kept, messages.join(kept.select(conv), conv, "left_semi")


def export(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One JSON document a conversation."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text")))
    return messages.groupBy(conv).agg(ordered.alias("messages")).select(conv, F.to_json(F.struct(F.col(conv), "messages")).alias("json"))


def summaries(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", at: int = SUMMARY_AT) -> DataFrame:
    """From ``at`` messages on, the first four fifths (two at least): how many, and a summary by topics."""
    w = Window.partitionBy(conv)
    x = messages.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy(turn))).where(F.col("n") >= at)
    x = x.where(F.col("nth") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.8)))
    users = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct(F.col(turn).alias("turn"), "text")))), lambda m: F.substring(m["text"], 1, 60)), 1, 4)
    return x.groupBy(conv).agg(F.count(F.lit(1)).alias("n_summarised"), F.concat(F.lit("对话涉及以下话题："), F.array_join(users, "；")).alias("summary"))


def clarified_question(messages: DataFrame, questions: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A short answer to a question back is put after the last full question and the short answers since."""
    history = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", T.strip("text").alias("text"))))
    h = messages.groupBy(conv).agg(history.alias("h"))
    asks = lambda c: T.has_any(c, M.QUESTION_WORDS) | (F.length(c) > 15)
    x = questions.join(h, conv, "left").withColumn("q", T.strip("query"))
    answers = F.filter("h", lambda m: m["role"] == "assistant")
    users = F.filter("h", lambda m: (m["role"] == "user") & (F.length(m["text"]) > 0))
    x = x.withColumn("answered", F.when(F.size(answers) > 0, F.element_at(answers, -1)["text"])).withColumn("users", users)
    full = F.array_max(F.transform("users", lambda m, i: F.when(asks(m["text"]), i)))
    x = x.withColumn("full", full)
    since = F.array_join(F.transform(F.slice("users", F.col("full") + 1, F.size("users")), lambda m: m["text"]), " ")
    follows = ~asks(F.col("q")) & (F.length("q") > 0) & T.has_any(F.coalesce("answered", F.lit("")), M.CLARIFYING) & F.col("full").isNotNull()
    return x.select(conv, F.when(follows, F.concat_ws(" ", since, "q")).otherwise(F.col("q")).alias("query"))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Requests with the stored result of the same key and index version, if it was used within ``days``."""
    fresh = cache.where(F.col("last_access") >= now - F.make_interval(days=F.lit(days)))
    return requests.join(fresh.select("cache_key", "index_version", "result_json"), ["cache_key", "index_version"], "left")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)
