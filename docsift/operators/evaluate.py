"""Retrieval metrics against gold pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import clean, known_source, page_matches


def hit_ranks(qa: DataFrame, hits: DataFrame) -> DataFrame:
    """(q_id, hit_rank, top1_ok) of the answerable questions.

    hits: (qid, rank, source_file, page_start, page_end). hit_rank is the first rank on a
    gold page of the gold source, null for a miss; a blank gold source meets any.
    """
    asked = qa.where("query_type = 'answerable'").select("q_id", known_source(clean(F.coalesce("source", F.lit("")))).alias("gold"), "gold_chunks")
    rows = asked.join(hits.withColumnRenamed("qid", "q_id"), "q_id", "left")
    right = (F.col("gold") == "") | (F.col("source_file") == F.col("gold"))
    page = F.exists(F.coalesce("gold_chunks", F.array().cast(qa.schema["gold_chunks"].dataType)), lambda g: page_matches(F.col("page_start"), F.col("page_end"), g["page"]))
    out = rows.groupBy("q_id").agg(F.min(F.when(right & page, F.col("rank"))).alias("hit_rank"), F.max((F.col("rank") == 1) & right).alias("first"), F.max(F.col("gold") == "").alias("any"))
    return out.select("q_id", "hit_rank", F.coalesce(F.col("any") | F.col("first"), F.lit(False)).alias("top1_ok"))


def metrics(ranks: DataFrame) -> DataFrame:
    """One row: questions, recall, mrr, source_accuracy; zeros without questions."""
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return ranks.agg(F.count("*").alias("questions"), share(F.col("hit_rank").isNotNull().cast("double")).alias("recall"), share(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"), share(F.col("top1_ok").cast("double")).alias("source_accuracy"))
