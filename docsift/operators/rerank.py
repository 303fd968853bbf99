"""Reranking: scores from a model, parsed, blended with the retrieval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names under which services return an item's index and its score, in order of preference. Fixed values.
INDEX_FIELDS = ("index", "document_index", "id")
SCORE_FIELDS = ("relevance_score", "score", "rerank_score")
FUNCTION_WEIGHT = 0.6
RUNTIME_WEIGHT = 0.25


def minmax(value: Column, over) -> Column:
    """Scaled to 0..1 within the window; 1 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def blend(hits: DataFrame, weight: float = FUNCTION_WEIGHT) -> DataFrame:
    """hits: (qid, idx, score, rerank_score, ...). Adds blended and new_rank; ties in the order of idx."""
    whole = Window.partitionBy("qid")
    mixed = hits.withColumn("blended", weight * minmax(F.col("rerank_score"), whole) + (1.0 - weight) * minmax(F.col("score"), whole))
    return mixed.withColumn("new_rank", F.row_number().over(whole.orderBy(F.desc("blended"), "idx")))


def parse_scores(responses: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, idx, rerank_score) for each hit (qid, idx), from responses (qid, place, item).

    ``item`` is one JSON object of a service's results. Its index is under index,
    document_index or id, else its place; its score under relevance_score, score or
    rerank_score, else 0. Items that name no hit are void. A query without any valid item
    scores its hits in their order; hits that no item names get -(idx + 1).
    """
    field = lambda *names: F.coalesce(*[F.get_json_object("item", f"$.{n}") for n in names])
    parsed = responses.select("qid", "place", F.coalesce(field(*INDEX_FIELDS), F.col("place").cast("string")).try_cast("double").alias("at"), F.coalesce(field(*SCORE_FIELDS), F.lit("0")).try_cast("double").alias("s"))
    parsed = parsed.where("at is not null and s is not null").withColumn("idx", F.col("at").cast("long"))
    sizes = hits.groupBy("qid").agg(F.count("*").alias("total"))
    # of several scores of one hit the lowest one counts, as the last in falling order
    scores = parsed.join(sizes, "qid").where("idx >= 0 and idx < total").groupBy("qid", "idx").agg(F.min("s").alias("s"))
    some = scores.select("qid").distinct().withColumn("some", F.lit(True))
    rows = hits.select("qid", "idx").join(sizes, "qid").join(scores, ["qid", "idx"], "left").join(some, "qid", "left")
    return rows.select("qid", "idx", F.coalesce("s", F.when(F.col("some"), -(F.col("idx") + 1)).otherwise(F.col("total") - F.col("idx")).cast("double")).alias("rerank_score"))


def response_scores(data: dict, total: int) -> list[float]:
    """``parse_scores`` for one service's answer about so many hits, on the executor that called it."""

    def number(item: dict, names: tuple, other) -> float | None:
        try:
            return float(next((item[name] for name in names if name in item), other))
        except (TypeError, ValueError):
            return None

    items = [(place, item) for place, item in enumerate(data.get("results", data.get("data", []))) if isinstance(item, dict)]
    read = [(number(item, INDEX_FIELDS, place), number(item, SCORE_FIELDS, 0)) for place, item in items]
    valid = sorted((int(at), -score) for at, score in read if at is not None and score is not None and 0 <= int(at) < total)
    lowest = {at: -score for at, score in valid}  # of several scores the lowest, which comes last
    return [lowest.get(i, -(i + 1.0)) if lowest else float(total - i) for i in range(total)]


def document_text(source: Column, start: Column, end: Column, section: Column, kind: Column, text: Column) -> Column:
    """What a reranker reads of a chunk."""
    pages = F.when(start == end, F.concat(F.lit("page: "), start.cast("string"))).otherwise(F.concat(F.lit("pages: "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("source: "), source), pages, F.concat(F.lit("section: "), F.coalesce(section, F.lit(""))), F.concat(F.lit("type: "), kind), F.when(text != "", text))
