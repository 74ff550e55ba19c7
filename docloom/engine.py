"""One object over the operators: build and sync an index, ask batches of questions, compute, inspect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import signals
from docloom.functions import text as T
from docloom.operators import chunking, compute, context, index, models, planner, postings, ranking, selection

KEYS = ["document_id", "chunk_index"]


class Engine:
    """``root`` holds the versioned tables documents, nodes, parents, chunks, postings and stats."""

    def __init__(self, spark: SparkSession, root: str, chunk_size: int = chunking.CHUNK, overlap: int = chunking.OVERLAP, buckets: int = 64):
        """``buckets``: parts that a sync can replace by themselves; an index keeps the number that it was built with."""
        self.spark, self.store, self.size, self.overlap, self.buckets = spark, index.VersionedIndex(spark, root), chunk_size, overlap, buckets

    # --- index ---

    def _prepared(self, docs: DataFrame) -> DataFrame:
        return docs.select(T.source_path("source_path").alias("source_path"), T.text_of("text").alias("text")).withColumn("sha256", F.sha2("text", 256))

    def _tables(self, docs: DataFrame) -> dict[str, DataFrame]:
        docs = docs.withColumn("filename", F.element_at(F.split("source_path", "/"), -1)).withColumn("document_id", T.document_id("source_path"))
        nodes = chunking.documents_to_nodes(docs)
        chunks = chunking.nodes_to_chunks(nodes, self.size, self.overlap).withColumn("node_type", F.lit("text"))
        none = F.lit(None).cast("string")
        chunks = chunks.withColumn("search_text", chunking.search_text(F.col("filename"), none, none, none, F.lit(None).cast("array<string>"), F.col("content")))
        return {"documents": docs, "nodes": nodes, "parents": chunking.parents(nodes), "chunks": chunks, "postings": postings.postings(chunks, KEYS, "search_text"), "stats": postings.document_stats(chunks, KEYS, "search_text")}

    def build(self, docs: DataFrame) -> str:
        """``docs`` has source_path and text; the index is replaced."""
        return self.store.replace(self._tables(self._prepared(docs)), "document_id", self.buckets)

    def _replace(self, changed: DataFrame, rows) -> None:
        """Writes the buckets of the changed paths anew; ``rows`` gives their documents. Nothing is written if there are none."""
        held = self.store.manifest()
        if held is None:
            raise ValueError("this index is not in buckets: build it again")
        n = held["n"]
        at = index.bucket_of(T.document_id("source_path"), n)
        buckets = sorted(r[0] for r in changed.select(at).distinct().collect())  # at most n numbers
        if not buckets:
            return
        old = self.store.read("documents", buckets).select("source_path", "text", "sha256")
        self.store.replace(self._tables(rows(old, at.isin(buckets))), "document_id", n, buckets)

    def sync(self, docs: DataFrame, remove_missing: bool = True) -> DataFrame:
        """Brings the index up to ``docs``; returns what was done for each path.

        Only buckets with an added, updated or removed document are parsed and written; the files of all others stay.
        """
        new = self._prepared(docs)
        if self.store.version() is None:
            self.build(docs)
            return new.select(T.fold("source_path").alias("path"), F.lit("added").alias("action"))
        old = self.store.read("documents").select("source_path", "sha256")
        actions = index.sync_actions(old, new.drop("text"), remove_missing)
        changed = actions.where(F.col("action").isin("added", "updated", "removed")).select(F.col("path").alias("source_path"))
        self._replace(changed, lambda kept, inside: index.apply_sync(kept, new.where(inside), actions))
        return actions

    def delete(self, filenames: list[str]) -> None:
        gone = self.spark.createDataFrame([(f,) for f in filenames], "filename string")
        left = index.delete_documents(self.documents().select("source_path", "filename"), gone)
        changed = self.documents().select("source_path").join(left.select("source_path"), "source_path", "left_anti")
        self._replace(changed, lambda kept, inside: kept.join(left.select("source_path"), "source_path", "left_semi"))

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def diagnose(self) -> DataFrame:
        return index.integrity(*[self.store.read(t) for t in ("nodes", "parents", "chunks", "documents")])

    # --- questions ---

    def plan(self, queries: DataFrame) -> DataFrame:
        return planner.plan_queries(queries, self.documents())

    def search(self, queries: DataFrame, k: int = 5, diverse: bool = False, vectors: DataFrame | None = None, reranker: models.Scorer | None = None, rules: bool = False, source_paths: tuple[str, ...] = (), node_types: tuple[str, ...] = (), fallback: bool = False) -> DataFrame:
        """query_id, chunk keys, content, score and rank. ``vectors`` is a dense ranking (query_id, keys, rank) to fuse with.

        Only chunks of ``source_paths`` and ``node_types`` are ranked, if given; the statistics stay those of the whole index.
        With ``fallback``, a query without a hit gets the first k chunks.
        """
        if not 1 <= k <= 20:
            raise ValueError("k must be from 1 to 20")
        chunks = selection.chunk_filter(self.store.read("chunks"), source_paths, node_types)
        wide = max(3 * k, 15) if diverse else max(2 * k, 10) if reranker or rules else k
        scores = postings.bm25_scores(queries, chunks, KEYS, index=self.store.read("postings"), stats=postings.total_stats(self.store.read("stats")))
        if source_paths or node_types:
            scores = scores.join(chunks.select(*KEYS), KEYS, "left_semi")
        first = postings.ranked(scores, max(4 * wide, 20), KEYS)
        if fallback:
            first = selection.first_results(queries, first, chunks, k, KEYS)
        first = first.drop("rank")
        hits = first.join(chunks.select(*KEYS, "content", "filename", "source_path", "parent_id"), KEYS).join(queries.select("query_id", "query"), "query_id")
        bonus = signals.rerank_score("query", "content", F.col("score")) if rules else F.col("score") + signals.intent_bonus("query", "content") - signals.noise_penalty("content")
        hits = postings.ranked(hits.withColumn("score", F.round(bonus, 6)), wide, KEYS)
        if vectors is not None:
            fused = ranking.fuse_ranks(hits, vectors, KEYS, wide)
            hits = fused.join(chunks.select(*KEYS, "content", "filename", "source_path", "parent_id"), KEYS).join(queries.select("query_id", "query"), "query_id")
        if reranker is not None:
            again = models.rerank(hits, reranker, wide, KEYS)
            hits = again.join(hits.drop("score", "rank"), ["query_id", *KEYS])
        if diverse:
            return ranking.diversify(hits, k, "source_path")
        return hits.where(F.col("rank") <= k)

    def ask(self, queries: DataFrame, k: int = 5, with_parents: bool = True, **kw) -> tuple[DataFrame, DataFrame]:
        """Answers (query_id, intent, mode, answer) and the sources behind them. Computations go through ``compute``."""
        plans = self.plan(queries)
        content = queries.join(plans.where(~F.col("intent").startswith("inventory")).select("query_id"), "query_id", "left_semi")
        hits = self.search(content, k, **kw)
        if with_parents:
            hits = context.with_parents(hits, self.store.read("parents"), self.store.read("nodes"))
        found = context.extractive_answer(hits).withColumn("n", F.lit(1))
        counted = planner.inventory_answer(plans).select("query_id", F.col("answer").alias("counted"))
        out = plans.join(found, "query_id", "left").join(counted, "query_id", "left")
        mode = F.when(F.col("counted").isNotNull(), "structured").otherwise(models.answer_mode(F.col("intent"), F.col("n"), F.lit(None), F.lit(False)))
        from docloom.functions import markers as M

        return out.select("query_id", "intent", mode.alias("mode"), F.coalesce("counted", "answer", F.lit(M.NO_ANSWER)).alias("answer")), hits

    def compute(self, question: str, rows: DataFrame, sheets: list[compute.Sheet]) -> tuple[compute.Computation, DataFrame | None]:
        """The plan of a computation and its result; no result where the plan asks back."""
        plan = compute.plan_computation(question, sheets)
        return plan, None if plan.clarify else compute.compute(rows, plan)
