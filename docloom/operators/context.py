"""Parent context, context budget, extractive answers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import markers as M
from docloom.functions import text as T

PARENT_CHARS, TOTAL_CHARS, CONTEXT_CHARS = 8000, 40000, 30000


def with_parents(hits: DataFrame, parents: DataFrame, nodes: DataFrame, query_id: str = "query_id", per_parent: int = PARENT_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """Adds parent_content: the text of the hit's parent node, once for each parent, within a budget that skips what does not fit."""
    p = parents.select("document_id", "parent_id", "content_node_id")
    n = nodes.select(F.col("document_id"), F.col("node_id").alias("content_node_id"), F.col("content").alias("parent_text"))
    # of all parents and nodes those of the hits' documents only, which are few: the rest is not dealt out
    own = F.broadcast(hits.select("document_id").distinct())
    p, n = p.join(own, "document_id", "left_semi"), n.join(own, "document_id", "left_semi")
    x = hits.join(p, ["document_id", "parent_id"], "left").join(n, ["document_id", "content_node_id"], "left")
    usable = (F.length(T.strip("parent_text")) > 0) & (T.strip("parent_text") != T.strip("content"))
    x = x.withColumn("usable", F.coalesce(usable, F.lit(False)))
    first = Window.partitionBy(query_id, "document_id", "parent_id", "usable").orderBy("rank")
    x = x.withColumn("usable", F.col("usable") & (F.row_number().over(first) == 1)).withColumn("cut", F.when(F.col("usable"), F.substring("parent_text", 1, per_parent)))
    # a greedy skip is no prefix sum: fold over the hits of a query in rank order, lengths only
    sizes = x.where("usable").groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.length("cut").alias("n")))).alias("all"))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, h: Column) -> Column:
        fits = acc["sum"] + h["n"] <= total
        return F.struct(F.when(fits, acc["sum"] + h["n"]).otherwise(acc["sum"]).alias("sum"), F.when(fits, F.concat(acc["taken"], F.array(h["rank"].cast("int")))).otherwise(acc["taken"]).alias("taken"))

    taken = sizes.select(query_id, F.explode(F.aggregate("all", start, step, lambda a: a["taken"])).alias("rank"), F.lit(True).alias("fits"))
    x = x.join(taken, [query_id, "rank"], "left")
    return x.withColumn("parent_content", F.when(F.col("usable") & F.col("fits"), F.col("cut"))).drop("usable", "fits", "cut", "parent_text", "content_node_id")


def context_blocks(hits: DataFrame, limit: int = CONTEXT_CHARS, query_id: str = "query_id") -> DataFrame:
    """Adds block, the part of each hit's block that fits into the budget; hits with nothing left are gone."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("filename"), F.lit(" chunk "), F.col("chunk_index").cast("string"))
    x = hits.withColumn("block", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))))
    before = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("used", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)))
    room = F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("int")
    return x.withColumn("block", F.col("block").substr(F.lit(1), room)).where(F.length("block") > 0).drop("used")


def context_text(blocks: DataFrame, query_id: str = "query_id") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"])
    return blocks.groupBy(query_id).agg(F.array_join(parts, "\n\n---\n\n").alias("context"))


def extractive_answer(hits: DataFrame, query_id: str = "query_id", limit: int = 260) -> DataFrame:
    """The first ``limit`` characters of each hit with its rank as citation; hits are few for each query."""
    line = F.concat(F.substring(T.squeeze("content"), 1, limit), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    x = hits.withColumn("line", F.when(F.length(T.squeeze("content")) > 0, line))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line")))), lambda b: b["line"])
    return x.groupBy(query_id).agg(F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(M.NO_ANSWER)).alias("answer"))


def sentence_answer(hits: DataFrame, query_text: str = "query", query_id: str = "query_id") -> DataFrame:
    line = F.concat(T.best_sentence("content", query_text), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda b: b["line"])
    return hits.groupBy(query_id).agg(F.array_join(lines, "\n").alias("answer"))


def cited_sources(answers: DataFrame, sources: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Sources an answer cites, in order of first mention; all of them where it cites none (but none for errors)."""
    size = sources.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_sources"))
    a = answers.join(size, query_id)
    valid = F.array_distinct(F.filter(T.citations("answer"), lambda r: (r >= 1) & (r <= F.col("n_sources"))))
    a = a.withColumn("cited", valid).withColumn("mode", F.coalesce("mode", F.lit("")))
    none = F.endswith("mode", F.lit("_error")) | ((F.col("mode") == "llm") & (F.size("cited") == 0) & F.contains("answer", F.lit("资料不足")))
    a = a.where(~none)
    every = F.sequence(F.lit(1), F.col("n_sources").cast("int"))
    listed = a.select(query_id, F.posexplode(F.when(F.size("cited") > 0, F.col("cited")).otherwise(every)).alias("pos", "rank"))
    return listed.join(sources, [query_id, "rank"]).withColumn("position", F.col("pos") + 1).drop("pos")
