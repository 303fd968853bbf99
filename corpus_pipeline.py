"""A corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept; all but the last return the columns of
their input, whatever their names. A row is told from others by its doc_id and text together, so
an id with several texts is several documents. Rows with a null doc_id pass the stages that
compare documents. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.exact_dedup import exact_dedup
from docsift.llm.jaccard_join import classes
from docsift.llm.language_id import keep_identified, prototypes
from docsift.llm.packing import pack
from docsift.llm.shared import Tables, table, text_key
from docsift.llm.substring_dedup import removals

#: A text is rejected if its cosine with every known language is below MIN_LANGUAGE_SCORE; one of
#: fewer than FULL_GRAMS distinct trigrams below the same share of it. README has the measured scores.
MIN_LANGUAGE_SCORE = 0.3
FULL_GRAMS = 120


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, th): whole rows out of the way of other names, and what tells them apart."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("th"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fit no known language, are null or have no letters; learns from the rows with a language. Without such rows no text with letters goes."""
    return keep_identified(docs, prototypes(docs), MIN_LANGUAGE_SCORE, FULL_GRAMS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it, and of such without any doc_id, one."""
    stays = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"))
    kept = rows.alias("a").join(stays.alias("b").hint("merge"), F.expr("a.sha = b.sha and a.id <=> b.id"), "left_semi")
    return kept.dropDuplicates(["sha", "id"]).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays, of its texts there the one with the least digest; rows that repeat it stay together."""
    found = classes(docs).where("class is not null and id is not null and class_size > 1").select("id", "th", "class")
    stays = found.groupBy("class").agg(F.min(F.struct("id", "th")).alias("stays"))
    gone = found.join(stays, "class").where("struct(id, th) <> stays").select("id", "th").distinct()
    return _packed(docs).join(gone.hint("merge"), ["id", "th"], "left_anti").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the later document; one that loses all its words goes. Other texts stay as they are."""
    _, lost = removals(docs)
    rows = _packed(docs).join(lost.select("id", "th", "kept_text").hint("merge"), ["id", "th"], "left").where("kept_text is null or kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    fresh = {"text": F.coalesce("kept_text", "row.text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", packing),
]

#: Packing and language profiles are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written and read again."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
