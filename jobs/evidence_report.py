"""Evidence report: what the documents hold on each question of a table of conversations.

For everyone who runs a question-answering service over a body of documents, and wants to know
before any model is asked which questions the documents answer. Each question is searched with
BM25 over the chunks of all documents; a row tells the chunks found, the share of the question's
words that they cover, the words they lack, and the note to show where that share is too small.

    questions/sufficient=true|false      a row for each question
    sources                              how often each source is found, and found first

The report is made anew by each run and replaces the last one, so a run that is repeated gives
the same tables. With ``--index`` the chunks and postings come from a chunk intake's output,
otherwise ``--documents`` are chunked here.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import clean, evidence_coverage, insufficiency_note, tokenize
from docsift.operators.bm25 import bm25_search, build_bm25
from docsift.plans.ship import ship
from docsift.sources.scratch import drop, written
from jobs.chunk_intake import chunks_of, current_chunks, current_index
from jobs.settings import command_line, load

log = logging.getLogger("jobs.evidence_report")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Settings:
    role: str = "user"
    top_k: int = 5
    least_coverage: float = 0.35


def report(asked: DataFrame, hits: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """A row for each question (conv_id, turn, text); hits: (conv_id, turn, chunk_id, score, rank)."""
    keys = ["conv_id", "turn"]
    # the question's text goes to its hits, and only those of its terms that a chunk has come back
    wanted = hits.join(asked.select(*keys, "text"), keys).join(chunks.select("chunk_id", "source_file", "display_text"), "chunk_id")
    shown = wanted.select(*keys, "rank", "chunk_id", "source_file", "score", F.array_intersect(tokenize(F.col("text")), tokenize(F.col("display_text"))).alias("tokens"))
    # at most top_k chunks of 700 characters for each question
    found = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_file", "score"))).alias("evidence"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    rows = asked.select(*keys, F.array_distinct(tokenize(F.col("text"))).alias("terms")).join(found, keys, "left")
    nothing = F.array().cast("array<string>")
    share, missing = evidence_coverage(F.col("terms"), F.coalesce("tokens", nothing))
    rows = rows.select(*keys, "evidence", F.size("terms").alias("n_terms"), share.alias("coverage"), missing.alias("missing"))
    rows = rows.withColumn("note", insufficiency_note(F.col("coverage"), F.col("missing"), settings.least_coverage))
    return rows.withColumn("sufficient", F.col("evidence").isNotNull() & (F.col("coverage") >= settings.least_coverage))


def run(spark: SparkSession, questions: str, out: str, documents: str | None = None, index: str | None = None, settings: Settings | None = None) -> None:
    """Reports on the questions of the chosen role at ``questions``, Parquet files with conv_id, turn, role and text.

    A question without words, or that finds nothing, is not sufficient. Of a turn that is repeated the
    least text counts; turns without conv_id or number are left out.
    """
    settings = settings or Settings()
    ship(spark)
    with shuffles_deleted(spark):
        _run(spark, questions, out, documents, index, settings)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go with its end, where Spark knows that setting; otherwise those of all actions pile up until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)


def _run(spark: SparkSession, questions: str, out: str, documents: str | None, index: str | None, settings: Settings) -> None:
    if index:
        chunks, words = current_chunks(spark, index), current_index(spark, index)
    else:
        docs = spark.read.parquet(documents).where("doc_id is not null")
        chunks = written(chunks_of(docs).select("chunk_id", "source_file", "display_text", F.struct("doc_id", "part").alias("ordinal")), "report", "zstd")
        words = build_bm25(chunks, "display_text").written("zstd")
    asked = spark.read.parquet(questions).where(F.col("role") == settings.role).select("conv_id", "turn", clean(F.coalesce("text", F.lit(""))).alias("text"))
    asked = written(asked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text")), "asked")
    # written, so that what the search shuffles is gone before the report shuffles
    hits = written(bm25_search(words, asked, settings.top_k), "hits", "zstd")
    n_chunks, n_asked = chunks.count(), asked.count()
    report(asked, hits, chunks, settings).write.mode("overwrite").partitionBy("sufficient").parquet(f"{out}/questions")
    drop(asked, hits, *([] if index else [chunks, words.postings]))
    rows = read_report(spark, out)
    sources = rows.select(F.explode("evidence").alias("e")).groupBy(F.col("e.source_file").alias("source_file")).agg(F.count("*").alias("found"), F.count_if(F.col("e.rank") == 1).alias("first"))
    sources.write.mode("overwrite").parquet(f"{out}/sources")
    log.info("%s: %d chunks, %d questions read; %d rows written, %d sources", out, n_chunks, n_asked, rows.count(), spark.read.parquet(f"{out}/sources").count())


def read_report(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/questions").withColumn("sufficient", F.col("sufficient").cast("boolean"))


def main(argv: list[str] | None = None) -> int:
    parser = command_line("jobs.evidence_report", "Tells which questions the documents answer.", {"questions": "Parquet files of conversations", "out": "folder of the report"}, {"documents": "Parquet files of documents", "index": "output of a chunk intake, in place of documents"})
    args = parser.parse_args(argv)
    if not args.documents and not args.index:
        parser.error("give --documents or --index")
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("evidence_report").getOrCreate()
    try:
        run(spark, args.questions, args.out, args.documents, args.index, load(Settings, args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
