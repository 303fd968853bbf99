"""Rank fusion and the weights, boosts and orders that follow it.

Ranked lists are rows (qid, list_no, chunk_id, score, rank); fused candidates are rows
(qid, chunk_id, score, first_list, first_rank), where the last two say in which list and
place a chunk came up first. Ties fall back on these. Every step is one window or one
aggregation by query, over the candidates of a query, whose number is bounded by the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import term_coverage, tokenize

RRF_K = 60
SCORE_WEIGHT = 0.03
#: Order of types among equal scores; others 1. Fixed values.
TYPE_PRIORITY = {"table_body": 5, "table": 5, "text": 4, "page_summary": 3, "section_summary": 2, "llm_summary": 2, "graph_index": 2, "local_heading_index": 2, "title": 1, "outline": 0}


def _by_query(*order) -> Window:
    return Window.partitionBy("qid").orderBy(*order)


FIRST_SEEN = ("first_list", "first_rank")


def rrf(lists: DataFrame, k: int = RRF_K, score_weight: float = SCORE_WEIGHT) -> DataFrame:
    """Sums 1 / (k + rank) and a share of the score relative to the list's best, over the lists."""
    best = F.max("score").over(Window.partitionBy("qid", "list_no"))
    part = 1.0 / (k + F.col("rank")) + F.when(best > 0, score_weight * F.col("score") / best).otherwise(0.0)
    parts = lists.withColumn("part", part)
    fused = parts.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return fused.select("qid", "chunk_id", "score", F.col("seen.list_no").alias("first_list"), F.col("seen.rank").alias("first_rank"))


def source_hint_weight(score: Column, source: Column, hints: Column) -> Column:
    return F.when(F.coalesce(F.size(hints), F.lit(0)) <= 0, score).when(F.array_contains(hints, source), score * 1.35).otherwise(score * 0.85)


def quality_weight(kind: Column, text: Column) -> Column:
    """A factor by type and by the length of what is shown."""
    return length_weight(kind, shown_length(text))


def shown_length(text: Column) -> Column:
    """Characters of a text without the blanks at its ends."""
    return F.length(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""))


def length_weight(kind: Column, n: Column) -> Column:
    by_type = F.when(kind.isin("title", "outline", "local_heading_index", "graph_index"), 0.72).when(kind.isin("table", "table_body"), 1.12).when(kind == "page_summary", 1.04).when(kind == "llm_summary", 0.82).otherwise(1.0)
    return by_type * F.when(n < 25, 0.55).when(n < 80, 0.82).otherwise(1.0)


def navigation_weight(kind: Column, coverage: Column) -> Column:
    """A factor for questions about the contents as a whole; coverage: the share of their terms in what is shown."""
    headings = F.when(coverage < 0.2, 0.58).otherwise(1.35 + 2.2 * coverage)
    graph = F.when(coverage < 0.2, 0.72).otherwise(1.2 + 1.8 * coverage)
    return F.when(kind == "local_heading_index", headings).when(kind == "graph_index", graph).when(kind == "outline", 2.2).when(kind.isin("page_summary", "section_summary"), 1.18).when(kind == "llm_summary", 1.08).otherwise(1.0)


def type_priority(kind: Column) -> Column:
    pairs = [F.lit(x) for item in TYPE_PRIORITY.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(1))


def weigh(fused: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Source hints, then quality, then navigation. asked: (qid, hints, navigation, terms)."""
    # what depends on the chunk alone is computed before the join: once for each chunk, not for each query that found it
    headings = F.when(F.col("block_type").isin("local_heading_index", "graph_index"), tokenize(F.col("display_text")))
    shown = chunks.select("chunk_id", "source_file", "page_start", "page_end", "block_type", shown_length(F.col("display_text")).alias("n_shown"), headings.alias("shown_terms"))
    rows = fused.join(shown, "chunk_id").join(asked, "qid")
    cover = F.when(F.col("navigation") & F.col("shown_terms").isNotNull(), term_coverage(F.col("terms"), F.col("shown_terms"))).otherwise(0.0)
    rows = rows.withColumn("cover", cover)  # a column, as the weight reads it several times
    score = source_hint_weight(F.col("score"), F.col("source_file"), F.col("hints")) * length_weight(F.col("block_type"), F.col("n_shown"))
    score = score * F.when(F.col("navigation"), navigation_weight(F.col("block_type"), F.col("cover"))).otherwise(1.0)
    return rows.withColumn("score", score).drop("n_shown", "shown_terms", "cover", "terms")


def expand(ranked: DataFrame, candidates: Column, focus: int = 8) -> DataFrame:
    """Boosts candidates that share a source (1.08) or a page (1.15) with the first ``focus``; the larger one only.

    Adds ``pos``, the place after the boost: by score, type priority, first occurrence.
    """
    rows = ranked.withColumn("place", F.row_number().over(_by_query(F.desc("score"), *FIRST_SEEN)))
    top = F.col("place") <= focus
    # whether a row of the query's top shares its source or page
    source = F.max(top.cast("int")).over(Window.partitionBy("qid", "source_file")) == 1
    page = F.max(top.cast("int")).over(Window.partitionBy("qid", "source_file", "page_start")) == 1
    leaf = F.col("block_type").isin("text", "table", "table_body")
    by_source = source & (leaf | F.col("block_type").isin("page_summary", "section_summary"))
    boost = F.when(F.col("place") > candidates, 1.0).when(page & leaf, 1.15).when(by_source, 1.08).otherwise(1.0)
    out = rows.withColumn("score", F.greatest("score", F.col("score") * boost))
    return out.withColumn("pos", F.row_number().over(_by_query(F.desc("score"), F.desc(type_priority(F.col("block_type"))), *FIRST_SEEN))).drop("place")


def prioritize_sources(ranked: DataFrame, least: Column | int) -> DataFrame:
    """Hinted sources first, if at least so many candidates are from them; ``pos`` anew."""
    hinted = F.coalesce(F.array_contains("hints", F.col("source_file")), F.lit(False))
    rows = ranked.withColumn("hinted", hinted)
    enough = F.sum(F.col("hinted").cast("int")).over(Window.partitionBy("qid")) >= least
    later = F.when(enough & ~F.col("hinted"), 1).otherwise(0)
    return rows.withColumn("later", later).withColumn("pos", F.row_number().over(_by_query("later", "pos"))).drop("later", "hinted")


def diversify(ranked: DataFrame, pool: Column | int) -> DataFrame:
    """The first of each page, then the rest, in order; as many as the pool holds. ``pos`` anew."""
    repeat = F.row_number().over(Window.partitionBy("qid", "source_file", "page_start", "page_end").orderBy("pos")) > 1
    rows = ranked.withColumn("repeat", repeat)
    return rows.withColumn("pos", F.row_number().over(_by_query("repeat", "pos"))).where(F.col("pos") <= pool).drop("repeat")


def fuse_queries(original: DataFrame, enhanced: DataFrame, k: int, weights: tuple[float, float] = (1.0, 0.65)) -> DataFrame:
    """(qid, chunk_id, score, rank) of two hit lists of each query, (qid, chunk_id, score, rank), the second weighted less."""
    hits = original.select("qid", "chunk_id", "score", "rank", F.lit(0).alias("list_no"), F.lit(weights[0]).alias("w")).unionByName(enhanced.select("qid", "chunk_id", "score", "rank", F.lit(1).alias("list_no"), F.lit(weights[1]).alias("w")))
    best = F.max("score").over(Window.partitionBy("qid", "list_no"))
    part = F.col("w") / (RRF_K + F.col("rank")) + F.when(best > 0, F.col("w") * SCORE_WEIGHT * F.col("score") / best).otherwise(0.0)
    fused = hits.withColumn("part", part).groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return fused.withColumn("rank", F.row_number().over(_by_query(F.desc("score"), "seen"))).where(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")
