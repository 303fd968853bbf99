import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.functions.text import tokenize
from docsift.functions.udfs import token_arrays
from docsift.operators import bm25
from docsift.operators.bm25 import bm25_scores, bm25_search, build_bm25, top_k

from .plain import tokens_of

LETTERS = [*"abz09_-./ \n!'", "é", "漢", "字", "🙂", "i̇"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(LETTERS), max_size=12).map("".join)), max_size=6), st.integers(0, 2))
def test_tokens_of_bytes_are_those_of_the_pattern(texts, skip):
    counts, tokens = token_arrays(pa.array(texts, pa.string()).slice(skip))
    want = [tokens_of(t or "") for t in texts[skip:]]
    assert counts.tolist() == [len(w) for w in want] and tokens.to_pylist() == [t for w in want for t in w]


def test_terms_are_the_tokens_of_queries(spark):
    texts = ["A b-c ./x Kelvin K", "频率 abc 频率", "", None, "x" * 50, "İstanbul Straße"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, index_text string")
    got = {(r.chunk_id, r.term, r.tf) for r in build_bm25(chunks).postings.collect()}
    each = chunks.select("chunk_id", F.explode(tokenize(F.coalesce("index_text", F.lit("")))).alias("term")).groupBy("chunk_id", "term").count().collect()
    assert got == {tuple(r) for r in each}


def corpus(spark, seed, n, copies=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, [1 / (1 + k) for k in range(40)], k=r.randint(0, 30))), f"s{i % 3}", (i * 7919) % 1009) for i in range(n // copies)]
    rows = [(k * 10_000 + i, text, source, place + k) for k in range(copies) for i, text, source, place in rows]
    return spark.createDataFrame(rows, "chunk_id long, index_text string, source_file string, ordinal int"), words


@pytest.mark.parametrize(("copies", "k"), [(1, 3), (4, 5), (1, 1000)])
def test_search_with_bounds_finds_what_scoring_everything_finds(spark, copies, k, monkeypatch):
    chunks, words = corpus(spark, copies, 400, copies)
    r = random.Random(9)
    asked = [(q, " ".join(r.choices([*words, "unknown"], k=r.choice([0, 1, 4, 20]))), r.choice([None, ["s0"], ["s1", "s2"], [], ["none"]])) for q in range(60)]
    queries = spark.createDataFrame(asked, "qid int, text string, sources array<string>")
    index = build_bm25(chunks)
    scored = bm25_scores(index, queries.select("qid", "text")).join(queries.select("qid", "sources"), "qid").where("sources is null or array_contains(sources, source_file)")
    want = {(x.qid, x.rank): (x.chunk_id, x.score) for x in top_k(scored, ["qid"], k, [F.desc("score"), "ordinal"]).collect()}
    for size, at_once in ((8192, 4096), (50, 4096), (8192, 13)):
        monkeypatch.setattr(bm25, "SHARD_CHUNKS", size)
        monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", at_once)
        got = {(x.qid, x.rank): (x.chunk_id, x.score) for x in bm25_search(index, queries, k).collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    limits = spark.createDataFrame([(q, s) for q, _, sources in asked for s in sources or [] if sources is not None], "qid int, source_file string")
    few = bm25_search(index, queries.select("qid", "text").where("qid % 2 = 0"), k, allowed=limits.where("qid % 2 = 0"))
    assert {x.qid for x in few.collect()} <= {q for q, _, s in asked if s}


def shard(rows):
    """rows: (term, chunk, impact)."""
    t, c, i = zip(*rows, strict=True)
    return bm25.Shard(pa.table({"term": list(t), "chunk_id": list(c), "ordinal": list(c), "impact": list(map(float, i)), "source": ["s"] * len(c)}))


def test_blocks_below_the_kth_score_are_not_scored():
    r = random.Random(4)
    rows = [(f"t{t}", c, r.random() ** 4) for c in range(8000) for t in r.sample(range(30), 6)]
    s = shard(rows)
    table = pa.table({"q": [1], "terms": [["t1", "t2", "t3"]], "weights": [[1.0, 2.0, 0.5]], "sources": pa.array([None], pa.list_(pa.string()))})
    got = s.top(table, 10)
    total = {}
    for t, c, i in rows:
        if t in ("t1", "t2", "t3"):
            total[c] = total.get(c, 0) + {"t1": 1, "t2": 2, "t3": 0.5}[t] * i
    want = sorted(total, key=lambda c: (-round(total[c], 9), c))[:10]
    assert got.column("chunk_id").to_pylist() == want
    assert s.scored < 0.2 * s.matched


def test_a_term_of_all_chunks_is_no_single_task(spark, monkeypatch):
    """However many queries there are, postings are dealt by chunk: the largest share is near the median."""
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 5)
    n = 6000
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.concat(F.lit("everywhere "), (F.col("id") % 50).cast("string")).alias("index_text"), F.col("id").alias("ordinal"))
    queries = spark.range(20).select(F.col("id").alias("qid"), F.concat(F.lit("everywhere "), F.col("id").cast("string")).alias("text"))
    found = bm25_search(build_bm25(chunks), queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    inputs = plan[plan.index("FlatMapCoGroupsInArrow") :]
    postings = [line for line in inputs.split("\n") if "hashpartitioning(term" in line]
    assert len(postings) <= 2 * inputs.count("HashAggregate(keys=[term")  # only for document frequencies, which are summed before they are sent
    sizes = [r["count"] for r in chunks.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(8))).count().collect()]
    assert max(sizes) <= 3 * np.median(sizes)
    assert found.count() == 60


def test_queries_of_many_terms_are_scored_without_bounds():
    r = random.Random(5)
    s = shard([(f"t{t}", c, r.random()) for c in range(4000) for t in {min(int(r.expovariate(0.05)), 99) for _ in range(40)}])
    asked = [(sorted(r.sample(range(len(s.terms)), 30)), np.array([r.random() for _ in range(30)]), mask) for mask in (None, np.arange(4000) % 3 == 0) for _ in range(15)]
    took, found = [], []
    for search in (s.best, s.every):
        begin = time.perf_counter()
        found.append([search(terms, weights, 5, mask) for terms, weights, mask in asked])
        took.append(time.perf_counter() - begin)
    for (ids, scores), (others, more) in zip(*found, strict=True):
        assert ids.tolist() == others.tolist() and np.abs(scores - more).max() < 1e-8
    assert took[1] < took[0] / 2  # so many questions at once are a matter of what a pair costs
    table = pa.table({"q": [1], "terms": [[f"t{t}" for t in range(40)]], "weights": [[1.0] * 40], "sources": pa.array([None], pa.list_(pa.string()))})
    s.scored = s.matched = 0
    s.best = None
    assert s.top(table, 5).num_rows == 5 and s.scored == s.matched


def test_copies_of_many_queries_are_few(spark, monkeypatch):
    assert bm25.shards_of(43_000, 4.5e6, 5_000, 200, 16) == 200  # few queries: as many tasks as may be
    assert bm25.shards_of(43_000, 4.5e6, 6_500_000, 200, 16) == 16
    assert bm25.shards_of(2_900_000, 3e8, 27_000_000, 100, 24) == 24 and bm25.shards_of(29_000_000, 3e9, 270_000_000, 1000, 24) == 222
    assert bm25.shards_of(0, 0.0, 0, 8, 16) == 8
    chunks, words = corpus(spark, 11, 200)
    r = random.Random(11)
    queries = spark.createDataFrame([(q, " ".join(r.choices([*words, "Unknown"], k=r.choice([0, 3, 20])))) for q in range(40)], "qid int, text string")
    index = build_bm25(chunks)
    want = sorted(map(tuple, bm25_search(index, queries, 4).collect()))
    for name, n in (("QUERIES_AT_ONCE", 5), ("BLOCK_QUERIES", 7), ("SHARD_MOST", 60), ("TERMS_IN_A_ROW", 2)):
        monkeypatch.setattr(bm25, name, n)
    found = bm25_search(index, queries, 4)
    assert sorted(map(tuple, found.collect())) == want and want
    # a chunk's postings travel in one row, and queries as texts
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list((cast(qtf" not in plan


def test_postings_of_a_chunk_become_one_row():
    rows = pa.record_batch([["a", "b", "c", "a"], [1.0, 2.0, 3.0, 4.0], ["x", "x", "y", "x"], [1, 1, 2, 1], ["s", "s", None, "s"]], ["term", "impact", "chunk_id", "ordinal", "source"])
    (packed,) = bm25._packed([rows, rows.slice(0, 0)])
    assert packed.to_pydict() == {"term": ["a\nb", "c", "a"], "impact": [[1.0, 2.0], [3.0], [4.0]], "chunk_id": ["x", "y", "x"], "ordinal": [1, 2, 1], "source": ["s", None, "s"]}
    got = bm25.Shard(pa.Table.from_batches([packed])).of_texts(pa.table({"q": [7, None], "text": ["a c b b", None], "sources": pa.array([None, None], pa.list_(pa.string())), "terms": [None, ["a", "b", "z"]], "idf": [None, [1.0, 0.5, 9.0]]}), 5)
    assert got.to_pydict() == {"q": [7], "chunk_id": ["x"], "ordinal": [1], "score": [7.0]}
