"""Intent planning over a batch of questions: marker flags, document mentions, and a CASE chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import markers as M
from docloom.functions import text as T

TABULAR = (".xlsx", ".csv")


def requested_types(q: Column) -> Column:
    """Sorted array of the file types a question names."""
    return F.array_sort(F.filter(F.array(*[F.when(T.has_any(q, words), F.lit(s)) for s, words in M.TYPE_WORDS]), lambda x: x.isNotNull()))


def names_of(filename: Column, source_path: Column) -> Column:
    """File name, path and the stems of both, as written and compact, where that has two or more characters."""
    names = F.array(filename, T.stem_of(filename), source_path, T.stem_of(source_path))
    both = F.transform(names, lambda x: F.struct(T.fold(x).alias("low"), T.compact(x).alias("compact")))
    return F.array_distinct(F.filter(both, lambda x: F.length(x["compact"]) >= 2))


def mentions(q: Column, compact_q: Column, names: Column) -> Column:
    """Whether a question has one of ``names``; both sides are prepared once, not for each pair."""
    return F.exists(names, lambda x: F.contains(q, x["low"]) | F.contains(compact_q, x["compact"]))


def plan_queries(queries: DataFrame, documents: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, intent, file_types, source_paths (sorted), diverse.

    Questions are few; documents are summed up once for each suffix and only documents a question names are joined to it.
    """
    docs = documents.select("filename", "source_path", T.suffix_of(F.col("filename")).alias("suffix"))
    q = queries.select(query_id, T.fold(T.strip(query)).alias("q"))
    q = q.withColumn("types", requested_types(F.col("q")))
    for name, words in (("sums", M.SUMMARY_WANTED), ("counts", M.COUNT_FILES), ("lists", M.LIST_FILES), ("files", M.FILE_WORDS), ("all", M.ALL_FILES), ("table", M.TABLE_SCOPE), ("weak", M.MAX + M.MIN)):
        q = q.withColumn(name, T.has_any(F.col("q"), words))
    q = q.withColumn("strong", T.has_any(F.col("q"), M.SUM + M.AVG + M.COUNT_ROWS) | (T.has_any(F.col("q"), M.FILTER) & F.rlike(F.col("q"), F.lit(r"\d"))))
    kinds = docs.agg(F.coalesce(F.bool_or(F.col("suffix").isin(*TABULAR)), F.lit(False)).alias("any_table"), F.coalesce(F.bool_or(~F.col("suffix").isin(*TABULAR)), F.lit(False)).alias("any_other"))
    known = docs.select("source_path", "suffix", names_of(F.col("filename"), F.col("source_path")).alias("names"))
    asked = q.select(query_id, "q", T.compact(F.col("q")).alias("compact_q"))
    named = asked.join(known, mentions(F.col("q"), F.col("compact_q"), F.col("names"))).select(query_id, "source_path", "suffix")
    named = named.groupBy(query_id).agg(
        F.array_sort(F.collect_set("source_path")).alias("named"), F.array_sort(F.collect_set(F.when(F.col("suffix") != "", F.col("suffix")))).alias("named_types"),
        F.array_sort(F.collect_set(F.when(F.col("suffix").isin(*TABULAR), F.col("source_path")))).alias("named_tables"),
    )
    x = q.join(named, query_id, "left").crossJoin(F.broadcast(kinds))  # one row
    none = F.array().cast("array<string>")
    for c in ("named", "named_types", "named_tables"):
        x = x.withColumn(c, F.coalesce(c, none))
    tabular = F.array(*[F.lit(s) for s in TABULAR])
    scope = (F.size("types") > 0) | (F.size("named") > 0) | F.col("files")
    table_scope = ~F.col("any_other") | F.arrays_overlap("types", tabular) | (F.size("named_tables") > 0) | F.col("table")
    computes = F.col("any_table") & (F.col("strong") | (F.col("weak") & table_scope))
    broad = F.col("sums") & ((F.size("types") > 0) | F.col("table") | F.col("all"))
    wide_types = F.when(F.col("sums") & F.col("table") & (F.size("types") == 0), F.array(F.lit(".xlsx"))).otherwise(F.col("types"))
    x = x.withColumn("step", F.when(F.col("counts") & scope, "inventory_count").when(F.col("lists") & scope, "inventory_list").when(computes, "structured_computation").when(F.size("named") > 0, "named").when(broad, "broad").otherwise("content"))
    x = x.withColumn("file_types", F.when(F.col("step") == "structured_computation", F.array_intersect("types", tabular)).when(F.col("step") == "named", F.col("named_types")).when(F.col("step") == "broad", wide_types).otherwise(F.col("types")))
    by_type = x.where("step IN ('inventory_count', 'inventory_list', 'broad') OR (step = 'content' AND size(types) > 0)")
    chosen = by_type.select(query_id, "file_types").join(docs, (F.size("file_types") == 0) | F.array_contains(F.col("file_types"), F.col("suffix")))
    chosen = chosen.groupBy(query_id).agg(F.array_sort(F.collect_list("source_path")).alias("chosen"))
    x = x.join(chosen, query_id, "left").withColumn("chosen", F.coalesce("chosen", none))
    empty = (F.col("step") == "broad") & (F.size("chosen") == 0)
    intent = F.when((F.col("step") == "named") & F.col("sums"), "document_summary").when(F.col("step") == "named", "content").when(empty, "content").when(F.col("step") == "broad", "multi_document_summary").otherwise(F.col("step"))
    paths = F.when(F.col("step") == "structured_computation", F.col("named_tables")).when(F.col("step") == "named", F.col("named")).otherwise(F.col("chosen"))
    diverse = F.when(F.col("step") == "broad", F.lit(True) & ~empty | F.col("all")).when(F.col("step") == "content", F.col("all")).otherwise(F.lit(False))
    return x.select(query_id, intent.alias("intent"), "file_types", paths.alias("source_paths"), diverse.alias("diverse"))


def inventory_answer(plans: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Answers of the count and list intents, from the catalogue alone."""
    one = F.when(F.array_join("file_types", ",") == ".xlsx", " Excel ").when(F.array_join("file_types", ",") == ".csv", " CSV ").when(F.array_join("file_types", ",") == ".pdf", " PDF ").otherwise("")
    x = plans.where(F.col("intent").startswith("inventory")).withColumn("n", F.size("source_paths"))
    return x.select(query_id, "intent", "n", F.concat(F.lit("共 "), F.col("n").cast("string"), F.lit(" 个"), one, F.lit("文件")).alias("answer"))


def needs_history(q: Column | str) -> Column:
    """Whether a question leans on what was said before."""
    return T.has_any(T.text_of(q), M.FOLLOWUP)


def is_mixed(q: Column, any_other: Column, names_other: Column) -> Column:
    """Computation and documents in one question."""
    return any_other & ((T.has_any(q, M.MIXED_JOIN) & T.has_any(q, M.MIXED_CONTENT)) | names_other)
