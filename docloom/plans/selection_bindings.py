"""Filters, fallbacks and projections around a search, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chunking, selection
from docloom.plans import sql as S
from docloom.plans.bindings import KEYS, binding, chunks, documents, questions, table


@binding(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index FROM chunks WHERE chunk_index = 0 AND lower(source) IN ('src0', 'src1')")
def filtered_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("node_type", F.when(F.col("chunk_index") == 0, "First").otherwise("more"))
    return selection.chunk_filter(c, ("SRC0", "src1"), ("FIRST",), path="source", name=None).select("doc_id", "chunk_index")


@binding("SELECT event_id, user_id FROM events WHERE user_id = 13")
def user_rows(spark, sf_dir):
    return selection.for_user(table(spark, sf_dir, "events"), 13).select("event_id", "user_id")


@binding(f"""SELECT doc_id, sha256('文件名：' || doc_id || '.txt' || chr(10) || '文件主题：' || doc_id || chr(10) || '文件类型：txt' || chr(10) || '工作表：' || source || CASE WHEN length({S.strip('text')}) > 0 THEN chr(10) || text ELSE '' END) AS search_hash
FROM documents WHERE text IS NOT NULL""")
def search_text(spark, sf_dir):
    none = F.lit(None).cast("string")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    d = documents(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(chunking.search_text(name, F.col("source"), none, none, F.lit(None).cast("array<string>"), F.col("text")), 256).alias("search_hash"))


@binding(f"""WITH {S.CHUNKS}, q AS (SELECT item_id AS query_id FROM benchmark), h AS (SELECT query_id, query_id AS doc_id, 0 AS chunk_index, 1.0::DOUBLE AS score, 1 AS rank FROM q WHERE query_id % 2 = 0),
f AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id, chunk_index) AS rank FROM chunks)
SELECT query_id, doc_id, chunk_index, score, rank FROM h UNION ALL SELECT query_id, f.doc_id, f.chunk_index, 0.0::DOUBLE, f.rank FROM q, f WHERE query_id % 2 <> 0 AND f.rank <= 5""")
def first_results_fallback(spark, sf_dir):
    q = questions(spark, sf_dir).select("query_id")
    hits = q.where("query_id % 2 = 0").select("query_id", F.col("query_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return selection.first_results(q, hits, chunks(spark, sf_dir), 5, KEYS)


@binding(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, 0.3::DOUBLE AS score FROM chunks ORDER BY doc_id DESC, chunk_index LIMIT 20")
def recent_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).select(*KEYS, F.col("doc_id").alias("created_at"))
    return selection.recent_chunks(c, 20, "created_at", KEYS).select(*KEYS, "score")


@binding(f"WITH {S.CHUNKS} SELECT doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN source END AS display_content FROM chunks")
def display_on_first_chunk(spark, sf_dir):
    return selection.display_on_first(chunks(spark, sf_dir), F.col("source"), "chunk_index").select(*KEYS, "display_content")


@binding("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def count_by_value(spark, sf_dir):
    return selection.count_by(table(spark, sf_dir, "documents"), "lang")


@binding("SELECT event_id, replace(CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, ' ', 'T') AS iso FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", selection.iso_time("ts").alias("iso"))


@binding("SELECT source, list_sort(list(DISTINCT lang)) AS lang, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def manifest_totals(spark, sf_dir):
    return selection.manifest_totals(table(spark, sf_dir, "documents"), ["lang"], ["n_chars"], ["source"])


@binding("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def union_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return selection.union_records(d.where("doc_id % 2 = 0").select("doc_id", "lang", "source"), d.where("doc_id % 2 <> 0").select("doc_id", "lang"))


@binding("""WITH r AS (SELECT c_nationkey::BIGINT AS query_id, 'row' AS kind, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
d AS (SELECT n_nationkey::BIGINT AS query_id, 'document' AS kind, n_regionkey::BIGINT AS item, 1 AS rank FROM nation)
SELECT query_id, kind, item, row_number() OVER (PARTITION BY query_id ORDER BY kind DESC, rank) AS rank FROM (SELECT * FROM r WHERE rank <= 3 UNION ALL SELECT * FROM d)""")
def mixed_answer_sources(spark, sf_dir):
    from docloom.operators.postings import ranked

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("score"))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_regionkey").cast("long").alias("item"), F.lit(1).alias("rank"))
    return selection.mixed_sources(ranked(c, 3, ["item"]).drop("score"), d).select("query_id", "kind", "item", "rank")
