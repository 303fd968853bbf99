"""python -m docsift COMMAND: build, ask, evaluate, check over the folders that the settings name."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import clean
from docsift.operators import chunking
from docsift.operators.bm25 import build_bm25
from docsift.operators.evaluate import hit_ranks, metrics
from docsift.operators.merge import summary_candidates, summary_chunks, upsert
from docsift.plans import models
from docsift.plans.config import Settings, get_settings
from docsift.plans.engine import Engine
from docsift.plans.ship import ship
from docsift.sources import storage
from docsift.sources.layout import load_blocks


def build_chunk_tables(spark: SparkSession, s: Settings, root: str) -> int:
    blocks = chunking.number_blocks(load_blocks(spark, root)).persist()
    storage.write_chunks(chunking.build_chunks(blocks), s.chunks_path)
    blocks.unpersist()
    return storage.read_chunks(spark, s.chunks_path).count()


def build_summaries(spark: SparkSession, s: Settings, limit: int, dry_run: bool = False, workers: int = 4) -> int:
    """Adds a model's summaries to the chunks; they are written beside the old chunks first, which are then replaced.

    Summaries are logged as they are made, so a run that was stopped goes on without asking again. A dry run counts the chunks that would be summarised and calls nothing.
    """
    if dry_run:
        return summary_candidates(storage.read_chunks(spark, s.chunks_path), limit).count()
    chat = models.chat_client(s, timeout=90, retries=2)
    if chat is None:
        raise SystemExit("summaries need LLM_API_KEY")
    chunks = storage.read_chunks(spark, s.chunks_path)
    made = summary_chunks(models.logged_summaries(summary_candidates(chunks, limit), chat, s.summary_log, workers)).select(*chunks.columns)
    merged = upsert(chunks, made).persist()
    n = merged.count()
    storage.write_chunks(merged, f"{s.chunks_path}.new")
    storage.write_chunks(storage.read_chunks(spark, f"{s.chunks_path}.new"), s.chunks_path)
    return n


def build_index(spark: SparkSession, s: Settings) -> None:
    chunks, embedder = storage.read_chunks(spark, s.chunks_path), models.get_embedder(s)
    storage.save_bm25(build_bm25(chunks), s.index_path)
    storage.save_vectors(chunks.select("chunk_id", "ordinal", "source_file", F.lit(embedder.name).alias("embedder"), embedder.embed(F.col("index_text")).alias("embedding")), s.vectors_path)
    storage.write_manifest(spark, s.manifest_path, chunks.count(), embedder.name, embedder.dimensions, s.embedding_model or s.local_embedding_model)


def open_engine(spark: SparkSession, s: Settings) -> Engine:
    embedder = models.get_embedder(s)
    storage.check_manifest(spark, s.manifest_path, embedder.name, embedder.dimensions)
    return Engine(storage.read_chunks(spark, s.chunks_path), storage.load_bm25(spark, s.index_path), spark.read.parquet(s.vectors_path), embedder, models.get_reranker(s))


def retrieve(engine: Engine, s: Settings, queries, k: int):
    chat = models.chat_client(s) if s.enable_query_enhancement else None
    return engine.retrieve(models.enhance(queries, chat, s.query_enhancement_mode) if chat else queries, k)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docsift")
    parser.add_argument("--data", default="data")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="parsed layouts to chunks, summaries if asked for, indexes")
    build.add_argument("root")
    build.add_argument("--summaries", type=int, default=None, metavar="LIMIT", help="0: all")
    build.add_argument("--workers", type=int, default=4, choices=range(1, 17), metavar="1..16", help="calls to the model at a time")
    build.add_argument("--dry-run", action="store_true", help="only count what would be summarised")
    commands.add_parser("index", help="indexes of the chunks there are")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int, default=8)
    evaluate = commands.add_parser("evaluate")
    evaluate.add_argument("qa")
    evaluate.add_argument("--top-k", type=int, default=5)
    commands.add_parser("check", help="whether the index fits the active embedder")
    args = parser.parse_args(argv)

    # a relative path is relative to this process, not to the JVM
    s = get_settings(".env", data_dir=args.data if "://" in args.data else str(Path(args.data).resolve()))
    spark = SparkSession.builder.appName("docsift").getOrCreate()
    ship(spark)
    if args.command == "build":
        print(f"{build_chunk_tables(spark, s, args.root)} chunks")
        if args.summaries is not None:
            n = build_summaries(spark, s, args.summaries, args.dry_run, args.workers)
            print(f"{n} chunks to summarise" if args.dry_run else f"{n} chunks with summaries")
        build_index(spark, s)
    elif args.command == "index":
        build_index(spark, s)
    elif args.command == "check":
        print(storage.check_manifest(spark, s.manifest_path, (e := models.get_embedder(s)).name, e.dimensions))
    elif args.command == "ask":
        asked = spark.createDataFrame([(1, args.question)], "qid int, query string")
        hits = retrieve(open_engine(spark, s), s, asked, args.top_k)
        print(models.generate(asked, hits, models.chat_client(s), s.enable_llm_verifier).first()["answer"])
    else:
        qa, broken = storage.read_qa(spark, args.qa)
        asked = qa.where("query_type = 'answerable'").select(F.col("q_id").alias("qid"), clean(F.col("question")).alias("query"))
        ranks = hit_ranks(qa, retrieve(open_engine(spark, s), s, asked, args.top_k)).persist()
        for row in ranks.orderBy("q_id").toLocalIterator():
            print(f"{row.q_id}: {'HIT' if row.hit_rank else 'MISS'} rank={row.hit_rank or '-'}")
        m = metrics(ranks).first()
        print(f"questions {m.questions}, Recall@{args.top_k} {m.recall:.3f}, MRR@{args.top_k} {m.mrr:.3f}, SourceAccuracy@1 {m.source_accuracy:.3f}; {broken.count()} lines skipped")
    return 0


if __name__ == "__main__":
    sys.exit(main())
