"""The engine: an index of chunks, and batches of queries against it.

Every stage takes and gives rows of all queries of a batch, so a batch is one plan, however
many queries it has. Wide texts join in only where they are needed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import clean, is_navigation, navigation_terms, query_variants, source_hints
from docsift.operators import fusion
from docsift.operators.bm25 import BM25Index, bm25_search, build_bm25
from docsift.operators.vectors import vector_search
from docsift.plans.models import Chat, Embedder, HashEmbedder, Reranker, generate
from docsift.plans.ship import ship
from docsift.sources.scratch import written

CANDIDATES = 30
SHOWN = ("chunk_id", "source_file", "page_start", "page_end", "section", "block_type", "display_text")
HIT_COLUMNS = ("qid", "rank", "chunk_id", "score", *SHOWN[1:])


@dataclass(frozen=True)
class Engine:
    """chunks: the columns of the chunk tables and ``ordinal``."""

    chunks: DataFrame
    bm25: BM25Index
    vectors: DataFrame
    embedder: Embedder
    reranker: Reranker | None = None

    @staticmethod
    def build(chunks: DataFrame, embedder: Embedder | None = None, reranker: Reranker | None = None) -> Engine:
        ship(chunks.sparkSession)
        embedder = embedder or HashEmbedder()
        if "ordinal" not in chunks.columns:
            chunks = chunks.withColumn("ordinal", F.struct("family", "order_key"))
        vectors = chunks.select("chunk_id", "ordinal", "source_file", F.lit(embedder.name).alias("embedder"), embedder.embed(F.col("index_text")).alias("embedding"))
        return Engine(chunks, build_bm25(chunks), vectors, embedder, reranker)

    def written(self) -> Engine:
        """The engine with its tables written to the shared folder, for any number of searches; texts are read and cleaned once."""
        own = self if self.bm25.chunks is None else Engine.build(written(self.chunks, "chunks"), self.embedder, self.reranker)
        return replace(own, bm25=own.bm25.written(), vectors=written(own.vectors, "vectors"))

    def ranked_lists(self, asked: DataFrame, variants: DataFrame, most: int = 2 * CANDIDATES) -> DataFrame:
        """(qid, list_no, chunk_id, score, rank): for each variant, words and vectors, over all chunks and over hinted sources; ``most``: the longest list asked for."""
        hinted = asked.select("qid", F.explode("hints").alias("source_file"))
        held = hinted.join(self.chunks.select("source_file").distinct(), "source_file")  # sources that have chunks
        flags = asked.select("qid", "candidates", "hints").join(held.select("qid").distinct().withColumn("restricted", F.lit(True)), "qid", "left").withColumn("restricted", F.coalesce("restricted", F.lit(False)))
        # a restricted variant asks a second time, with its sources; one search serves both
        kinds = F.when(F.col("restricted"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
        rows = variants.join(flags, "qid").withColumn("step", F.when(F.col("restricted"), 4).otherwise(2)).withColumn("kind", F.explode(kinds))
        rows = rows.select("qid", "variant_no", "kind", "candidates", "step", "text", F.when(F.col("kind") == 2, F.col("hints")).alias("sources"))
        words = bm25_search(self.bm25, rows, most)
        asks = rows.select(F.struct("qid", "variant_no", (F.col("kind") + 1).alias("kind"), "candidates", "step").alias("qid"), self.embedder.embed(F.col("text")).alias("embedding"), "sources")
        near = vector_search(self.vectors, asks, most, embedder=self.embedder.name).select("qid.*", "chunk_id", "score", "rank")
        lists = words.select(*near.columns).unionByName(near).where("rank <= candidates")
        return lists.select("qid", (F.col("variant_no") * F.col("step") + F.col("kind")).alias("list_no"), "chunk_id", "score", "rank")

    def search(self, queries: DataFrame, k: int = 8, candidates: int = CANDIDATES) -> DataFrame:
        """Hits of (qid, query): HIT_COLUMNS, in rank order; at most k for each query."""
        text = clean(F.col("query"))
        asked = queries.select("qid", "query", text.alias("clean_query"))
        asked = asked.select("qid", "query", source_hints(F.col("clean_query")).alias("hints"), is_navigation(F.col("clean_query")).alias("navigation"), navigation_terms(F.col("clean_query")).alias("terms"))
        asked = asked.withColumn("candidates", F.when(F.col("navigation"), 2 * candidates).otherwise(candidates))
        asked = written(asked, "asked")  # several joins read them
        variants = asked.select("qid", F.posexplode(query_variants(F.col("query"))).alias("variant_no", "raw")).select("qid", "variant_no", clean(F.col("raw")).alias("text"))
        variants = written(variants, "variants")
        fused = written(fusion.rrf(self.ranked_lists(asked, variants, 2 * candidates)), "fused")
        # the chunks that were found, so that the texts of all others do not travel
        held = written(self.chunks.select(*SHOWN).join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi"), "held")
        ranked = fusion.weigh(fused, held, asked.select("qid", "hints", "navigation", "terms", "candidates"))
        ranked = fusion.expand(ranked, F.col("candidates"))
        ranked = fusion.prioritize_sources(ranked, max(1, min(k, 3)))
        pool = fusion.diversify(ranked, F.greatest(F.lit(k), F.least(F.col("candidates"), F.lit(4 * k))))
        hits = pool.select("qid", F.col("pos").alias("rank"), "chunk_id", "score").join(held, "chunk_id").select(*HIT_COLUMNS)
        if self.reranker is not None:
            return self.reranker.rerank(queries, hits, k).select(*HIT_COLUMNS)
        return hits.where(F.col("rank") <= k)

    def retrieve(self, queries: DataFrame, k: int = 8) -> DataFrame:
        """Hits of (qid, query) or (qid, query, enhanced): three times k are searched; two searches are fused where they differ."""
        wide = max(k, 3 * k)
        first = self.search(queries.select("qid", "query"), wide)
        if "enhanced" not in queries.columns:
            return first.where(F.col("rank") <= k)
        changed = queries.where("enhanced <> query")
        second = self.search(changed.select("qid", F.col("enhanced").alias("query")), wide)
        both = fusion.fuse_queries(first.join(changed.select("qid"), "qid", "left_semi"), second, k)
        shown = self.chunks.select(*SHOWN)
        fused = both.join(shown, "chunk_id").select(*HIT_COLUMNS)
        return first.join(changed.select("qid"), "qid", "left_anti").where(F.col("rank") <= k).unionByName(fused)

    def answer(self, queries: DataFrame, k: int = 8, chat: Chat | None = None, verify: bool = False) -> DataFrame:
        """(qid, answer): a model's answer from the hits, or extracts of them without a model."""
        return generate(queries, self.retrieve(queries, k), chat, verify)
