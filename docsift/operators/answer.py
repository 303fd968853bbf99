"""Evidence and answers as text, one row for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import page_label

REFUSAL = "文档中没有提供相关信息。"
BANNER = "未配置 LLM API，以下为检索到的候选证据。请基于这些证据人工核对或配置 API 生成最终答案。"


def evidence_line() -> Column:
    """[rank] 《source》pages，section, then the text shown."""
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit("，"), F.col("section"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 《"), F.col("source_file"), F.lit("》"), page_label(F.col("page_start"), F.col("page_end")), section, F.lit("\n"), F.col("display_text"))


def format_evidence(hits: DataFrame) -> DataFrame:
    """(qid, evidence): a query's hits in rank order, with a blank line between."""
    lines = F.array_sort(F.collect_list(F.struct("rank", evidence_line().alias("line"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n\n").alias("evidence"))


def extractive_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answer): the evidence under a banner, or a refusal without hits."""
    rows = queries.select("qid", "query").join(format_evidence(hits), "qid", "left")
    body = F.concat(F.lit(BANNER + "\n\n问题："), F.col("query"), F.lit("\n\n候选证据：\n"), F.col("evidence"))
    return rows.select("qid", F.coalesce(body, F.lit(REFUSAL)).alias("answer"))
