"""Chunk intake: takes new document files into the chunk and posting tables that searches read.

A full rebuild chunks and tokenizes everything again whenever a document arrives. This job is a
file stream with a checkpoint instead: a run takes the files that no run before it has taken, and
ends. Each micro-batch writes the partitions of its own number in three tables,

    documents/batch=N                    doc_id: which documents the batch holds
    chunks/batch=N/source_file=...       chunks in the library's format, with doc_id and part, but for index_text
    postings/batch=N                     term, tf, dl, chunk_id, ordinal, source_file, chunk by chunk

and no other, so a batch that runs again after a failure replaces what it wrote before. Nothing
that is written is rewritten: a document that comes again counts from its last batch on, and
``current`` leaves out what it had before, also if nothing is left of it. Of a doc_id that is
several times in one batch, the row of the newest file counts, then of the last file by name, then
the last row. ``index_text`` is the text once more behind a few words made of other columns, so
``current_chunks`` puts it together instead of its being stored. Rows without doc_id can't be cited and are left out; null texts give no chunks.

Run it with a checkpoint and an output that belong together; a new checkpoint needs a new output.
With very many sources set ``partition_by`` to [], as each is a folder of its own otherwise.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.operators.bm25 import BM25Index, build_bm25, of_postings
from docsift.operators.chunking import leaf_chunks, leaf_prefix
from docsift.plans.ship import ship
from jobs.settings import command_line, load

log = logging.getLogger("jobs.chunk_intake")
DOCUMENTS = "doc_id long, text string, source string"
CHUNKS = "chunk_id string, doc_id long, part long, page_start int, page_end int, section string, block_type string, index_text string, display_text string, image_refs array<string>, batch long, source_file string"
POSTINGS = "term string, tf long, dl int, chunk_id string, ordinal struct<doc_id: bigint, part: bigint>, source_file string, batch long"
LEDGER = "doc_id long, batch long"
#: Rows left out up to which they are sent to all tasks, so that the others stay where they are.
LEFT_OUT_SENT = 100_000


@dataclass(frozen=True)
class Settings:
    files_per_batch: int = 64
    partition_by: list[str] = field(default_factory=lambda: ["source_file"])


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text, source): overlapping parts of the clean text, those under 20 characters dropped; null sources count as empty."""
    blocks = docs.select(F.coalesce("source", F.lit("")).alias("source_file"), F.lit(1).alias("page"), F.lit("").alias("section"), F.lit("text").alias("block_type"), F.array().cast("array<string>").alias("image_refs"), F.col("doc_id").alias("block_index"), F.coalesce("text", F.lit("")).alias("text"))
    return leaf_chunks(blocks).withColumns({"doc_id": F.col("order_key.b"), "part": F.col("order_key.c")})


def _without(rows: DataFrame, left_out: DataFrame, on) -> DataFrame:
    """Rows but those left out, which are counted first: a plan made before they are known shuffles the rows with all their texts."""
    n = left_out.count()
    return rows if not n else rows.join(F.broadcast(left_out) if n <= LEFT_OUT_SENT else left_out, on, "left_anti")


def _last_of_each(rows: DataFrame) -> DataFrame:
    """The rows of a batch that count: of each doc_id the last. Only ids and places are shuffled, and the few rows that don't count are left out by their place."""
    keys = rows.select("doc_id", "file", "row", F.struct("written", "file", "row").alias("at"))
    repeated = keys.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("at").alias("last")).where("n > 1")
    lost = keys.join(repeated, "doc_id").where("at < last").select("file", "row")
    return _without(rows, lost, ["file", "row"])


def _write(rows: DataFrame, path: str, number: int, partition_by: list[str]) -> None:
    """Writes a batch's partitions, in place of those that an earlier attempt at the batch has left."""
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch", *partition_by).parquet(path)


def _take(out: str, settings: Settings):
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        docs = _last_of_each(batch.where("doc_id is not null"))
        _write(docs.select("doc_id"), f"{out}/documents", number, [])
        wanted = [c.split()[0] for c in CHUNKS.split(", ") if not c.startswith(("batch", "index_text"))]
        _write(chunks_of(docs).select(*wanted), f"{out}/chunks", number, settings.partition_by)
        # read back, so that texts are cleaned and cut once
        chunks = _read(spark, f"{out}/chunks", CHUNKS).where(F.col("batch") == number)
        postings = build_bm25(chunks.withColumn("ordinal", F.struct("doc_id", "part")), "display_text").postings
        # a chunk's postings lie together, so that its columns are runs; in the order of terms its id would be written out for each
        _write(postings, f"{out}/postings", number, [])
        log.info("batch %d: %d rows read, %d documents, %d chunks written", number, batch.count(), _read(spark, f"{out}/documents", LEDGER).where(F.col("batch") == number).count(), chunks.count())

    return take


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    # an empty name of a partition is read as null
    return rows.withColumn("source_file", F.coalesce("source_file", F.lit(""))) if "source_file" in rows.columns else rows


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings | None = None) -> int:
    """Takes what is new at ``documents``, Parquet files with doc_id, text and source, and waits for the end; the number of batches taken."""
    settings = settings or Settings()
    ship(spark)
    for name, schema, parts in (("documents", LEDGER, []), ("chunks", CHUNKS, settings.partition_by), ("postings", POSTINGS, [])):
        # so that the tables can be read though no file has come yet
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch", *parts).parquet(f"{out}/{name}")
    place = F.col("_metadata")
    # as a pattern, which only matches itself: a stream takes no path of a single file otherwise
    path = documents.rstrip("/")
    rows = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path)
    rows = rows.select("doc_id", "text", "source", place["file_modification_time"].alias("written"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    stream = rows.writeStream.foreachBatch(_take(out, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    taken = sum(1 for p in stream.recentProgress if p["numInputRows"] > 0)
    log.info("%s: %d batches taken from %s", out, taken, documents)
    return taken


def _standing(spark: SparkSession, out: str, rows: DataFrame, doc_id: str) -> DataFrame:
    """Rows of the last batch of each document. What is left out is few, so it is found and the rows stay where they are."""
    ledger = spark.read.schema(LEDGER).parquet(f"{out}/documents")
    last = F.max("batch").over(Window.partitionBy("doc_id"))
    gone = ledger.withColumn("last", last).where("batch < last").select(F.col("doc_id").alias("gone_id"), F.col("batch").alias("gone_batch"))
    return _without(rows, gone, (F.col(doc_id) == F.col("gone_id")) & (F.col("batch") == F.col("gone_batch")))


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every document as it stands, with ``ordinal``, their order."""
    rows = _standing(spark, out, _read(spark, f"{out}/chunks", CHUNKS), "doc_id")
    # tables of earlier versions hold it
    made = F.concat(leaf_prefix(F.col("source_file"), F.col("page_start"), F.col("section"), F.col("block_type")), F.lit("\n"), F.col("display_text"))
    return rows.withColumns({"index_text": F.coalesce("index_text", made), "ordinal": F.struct("doc_id", "part")})


def current_index(spark: SparkSession, out: str) -> BM25Index:
    """The BM25 index of ``current_chunks``, from the postings written; no text is read."""
    postings = _standing(spark, out, _read(spark, f"{out}/postings", POSTINGS), "ordinal.doc_id").drop("batch")
    return of_postings(postings, current_chunks(spark, out).select("chunk_id"))


def main(argv: list[str] | None = None) -> int:
    parser = command_line("jobs.chunk_intake", "Takes new document files into the chunk and posting tables.", {"documents": "folder of Parquet files", "out": "folder of the tables", "checkpoint": "folder of the stream's state"})
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("chunk_intake").getOrCreate()
    try:
        run(spark, args.documents, args.out, args.checkpoint, load(Settings, args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
