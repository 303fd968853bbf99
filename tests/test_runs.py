"""Runs that are stopped and go on, indexes of another embedder, layouts of any depth, pairs scored together."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docsift.functions.udfs import hash_vector
from docsift.operators.chunking import number_blocks
from docsift.operators.vectors import vector_search
from docsift.plans import models
from docsift.plans.engine import Engine
from docsift.plans.models import HashEmbedder, Reranker, logged_summaries
from docsift.queries import QUERIES
from docsift.sources.layout import section_paths

from .plain import tokens_of

SF = "/root/testdata/sf0.001"


def candidates(spark, n):
    rows = [(f"id{i}", "s", 1, 2, "x", f"text number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "summary_id string, source_file string, page_start int, page_end int, section string, display_text string")


def test_summaries_go_on_where_they_were_stopped(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()

    def chat(system, user, temperature, stop_after=None):
        if stop_after is not None and len(list(calls.iterdir())) >= stop_after:
            raise SystemError("the machine is gone")
        with open(calls / f"{user.split()[-1]}-{random.getrandbits(60)}", "w"):
            pass
        return f"summary of {user.split()[-1]}"

    rows = candidates(spark, 60)
    with pytest.raises(Exception, match="the machine is gone"):
        logged_summaries(rows, lambda s, u, t: chat(s, u, t, 25), log, tasks=2, group=10)
    saved = {r.summary_id for r in spark.read.schema(models.SUMMARY_LOG).json(log).collect()}
    assert 0 < len(saved) < 60
    before = {f.name for f in calls.iterdir()}
    got = {r.summary_id: r.summary for r in logged_summaries(rows, chat, log, tasks=2, group=10).collect()}
    assert got == {f"id{i}": f"summary of {i}" for i in range(60)}
    asked_again = {f"id{f.name.split('-')[0]}" for f in calls.iterdir() if f.name not in before}
    assert not asked_again & saved and asked_again == set(got) - saved
    n = len(list(calls.iterdir()))
    assert logged_summaries(rows, chat, log).count() == 60 and len(list(calls.iterdir())) == n  # nothing is left to ask


def test_failed_summaries_are_asked_again(spark, tmp_path):
    log, rows = str(tmp_path / "log"), candidates(spark, 6)

    def failing(system, user, temperature):
        raise RuntimeError("busy")

    assert logged_summaries(rows, failing, log).count() == 0
    assert logged_summaries(rows, lambda s, u, t: "short", log).count() == 6
    assert logged_summaries(rows.limit(0), failing, log).count() == 0


def test_an_index_of_another_embedder_is_an_error(spark):
    rows = [(f"c{i}", "s", 1, 1, "", "text", f"words of chunk {i}", f"words of chunk {i}", i) for i in range(5)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, page_start int, page_end int, section string, block_type string, index_text string, display_text string, ordinal int")
    asked = spark.createDataFrame([(1, "words of chunk 3")], "qid int, query string")
    engine = Engine.build(chunks, HashEmbedder(dimensions=8))
    assert engine.search(asked, 3).count() == 3
    other = Engine(engine.chunks, engine.bm25, engine.vectors, HashEmbedder(name="another", dimensions=8))
    with pytest.raises(Exception, match="build the index again"):
        other.search(asked, 3).collect()
    nameless = engine.vectors.withColumn("embedder", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="vectors of nobody"):
        vector_search(nameless, spark.createDataFrame([(1, [1.0] * 8)], "qid int, embedding array<double>"), 3, embedder="x").collect()


def test_section_paths_of_any_depth(spark):
    r = random.Random(3)
    rows = []
    for doc in range(6):
        for pos in range(300):
            level = r.choice([None, None, r.randint(1, 1000), r.randint(1, 5)])
            rows.append((f"d{doc}", pos, f"t{pos}" if level else None, level))
    rows += [("deep", k, f"t{k}", k + 1) for k in range(1000)] + [("deep", 1000, None, None)]
    blocks = spark.createDataFrame(rows, "doc_key string, block_pos int, title string, title_level int").repartition(5)
    want, open_, last = {}, [], None
    for doc, pos, title, level in sorted(rows, key=lambda x: (x[0], x[1])):
        if doc != last:
            open_, last = [], doc
        if level is not None:
            open_ = [x for x in open_ if x[0] < level] + [(level, title)]
        want[doc, pos] = " > ".join(t for _, t in open_)
    assert {(x.doc_key, x.block_pos): x.section for x in section_paths(blocks).collect()} == want
    few = blocks.where("title_level is null or title_level <= 5")
    a, b = ({(x.doc_key, x.block_pos): x.section for x in rows.collect()} for rows in (section_paths(few), section_paths(few, [1, 2, 3, 4, 5])))
    assert a == b
    assert section_paths(blocks.limit(0)).count() == 0


def test_block_numbers_are_the_same_when_tasks_run_again(spark):
    blocks = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 97).cast("string")).alias("doc_key"), F.col("id").alias("block_pos")).repartition(6)
    numbered = number_blocks(blocks)
    first = {(r.doc_key, r.block_pos): r.block_index for r in numbered.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # other ranges, if they were cut again
    try:
        assert {(r.doc_key, r.block_pos): r.block_index for r in numbered.collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered = sorted(first)
    assert [first[k] for k in ordered] == list(range(3000))


def test_pairs_of_all_queries_are_scored_together(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def pairs(found):
        with open(calls / str(random.getrandbits(60)), "w"):
            pass
        sizes = [len(q) + len(d) for q, d in found]
        assert sizes == sorted(sizes)
        return [float(len(set(q.split()) & set(d.split()))) for q, d in found]

    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "qid int, query string")
    hits = [(i, k + 1, f"c{k}", 1.0 / (k + 1), "s", 1, 1, "", "text", " ".join(f"w{j}" for j in range(k * 5, k * 5 + 6))) for i in range(20) for k in range(5)]
    df = spark.createDataFrame(hits, "qid int, rank int, chunk_id string, score double, source_file string, page_start int, page_end int, section string, block_type string, display_text string").coalesce(1)
    one = Reranker("one", lambda q, docs: [float(len(set(q.split()) & set(d.split()))) for d in docs])
    many = Reranker("many", None, pairs=pairs)
    want, got = ([tuple(r) for r in x.rerank(queries, df, 3).select("qid", "rank", "chunk_id", "score").orderBy("qid", "rank").collect()] for x in (one, many))
    assert got == want and len(list(calls.iterdir())) < 20


def test_hash_embedding_digests_are_those_of_plain_vectors(spark):
    import hashlib

    docs = {r.doc_id: r.body for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace("text", "<[^>]+>", " ").alias("body")).collect()}
    for r in QUERIES["hash_embedding"](spark, SF).where("doc_id < 40").collect():
        vector = hash_vector(tokens_of(docs[r.doc_id]))
        assert r.vector_sha256 == hashlib.sha256(",".join(str(math.floor(x * 1e6 + 0.5)) for x in vector).encode()).hexdigest()
