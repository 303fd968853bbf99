"""Chunks, indexes, manifests and question sets on disk."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.bm25 import BM25Index

CHUNK_SCHEMA = "chunk_id string, source_file string, page_start int, page_end int, section string, block_type string, raw_text string, contextual_prefix string, index_text string, display_text string, image_refs array<string>"
QA_SCHEMA = "q_id string, source string, query_type string, question string, answer string, gold_chunks array<struct<page:string,section:string,content:string>>"
CHUNK_COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, in chunk order, as gzip files, as a chunk holds its text three times; overwrites."""
    order = [c for c in ("family", "order_key", "ordinal") if c in chunks.columns]
    chunks.orderBy(*order).select(*CHUNK_COLUMNS).write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``ordinal``, their place in the files; blank lines are skipped, broken ones are an error."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.withColumn("ordinal", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def save_bm25(index: BM25Index, path: str) -> None:
    """Tables below a path; postings lie sorted by term, so a probe skips most row groups.

    Those of an index being built are written unsorted first: ranges and statistics come from them, and texts are read once.
    """
    if index.chunks is not None:
        index = index.written()
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_bm25(spark: SparkSession, path: str) -> BM25Index:
    return BM25Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats")])


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def write_manifest(spark: SparkSession, path: str, chunk_count: int, embedder: str, dimensions: int, model: str = "") -> None:
    row = [(datetime.now(UTC).isoformat(), chunk_count, embedder, dimensions, model)]
    spark.createDataFrame(row, "built_at string, chunk_count long, vector_embedder string, dimensions int, embedding_model string").coalesce(1).write.mode("overwrite").json(path)


def check_manifest(spark: SparkSession, path: str, embedder: str, dimensions: int) -> dict:
    """The manifest; an error if the vectors were made by another embedder or have another length."""
    row = spark.read.schema("built_at string, chunk_count long, vector_embedder string, dimensions int, embedding_model string").json(path).first().asDict()
    if row["vector_embedder"] != embedder or row["dimensions"] != dimensions:
        raise ValueError(f"the index holds vectors of {row['vector_embedder']} ({row['dimensions']}), the active embedder is {embedder} ({dimensions}); build the index again")
    return row


def read_qa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, broken lines). Pages are text whether they come as a number or a range."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", QA_SCHEMA + ", _broken string", options).alias("r")).select("r.*")
    return rows.where("_broken is null").drop("_broken"), rows.where("_broken is not null").select("_broken")
