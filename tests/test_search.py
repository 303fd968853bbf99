"""Search operators against plain versions, and the whole search against one written in plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsift.functions.udfs import hash_vector
from docsift.operators import fusion, rerank
from docsift.operators.bm25 import bm25_search, build_bm25
from docsift.operators.vectors import vector_search
from docsift.plans.engine import Engine
from docsift.plans.models import HashEmbedder, Reranker

from .conftest import SF
from .plain import tokens_of


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, source_file string, page_start int, page_end int, section string, block_type string, index_text string, display_text string, ordinal long")


def simple(spark, texts):
    return chunks_of(spark, [(f"d{k + 1}", "s", 1, 1, "", "text", t, t, k) for k, t in enumerate(texts)])


@pytest.mark.parametrize(("query", "want"), [("a b", {"d1": 1.097666, "d2": 0.200353}), ("a a b", {"d1": 2.028065, "d2": 0.200353}), ("zzz", {})])
def test_bm25_by_hand(spark, query, want):
    index = build_bm25(simple(spark, ["a b a", "b c"]))
    hits = bm25_search(index, spark.createDataFrame([(1, query)], "qid int, text string")).collect()
    assert {h.chunk_id: round(h.score, 6) for h in hits} == want


def test_restriction_leaves_statistics_alone(spark):
    rows = [(f"c{k}", f"s{k % 2}", 1, 1, "", "text", t, t, k) for k, t in enumerate(["a b", "a c", "a d", "b"])]
    index = build_bm25(chunks_of(spark, rows))
    q = spark.createDataFrame([(1, "a b")], "qid int, text string")
    every = {h.chunk_id: h.score for h in bm25_search(index, q).collect()}
    only = {h.chunk_id: h.score for h in bm25_search(index, q, allowed=spark.createDataFrame([(1, "s1")], "qid int, source_file string")).collect()}
    assert only == {c: s for c, s in every.items() if c in ("c1", "c3")}


def test_ties_keep_chunk_order(spark):
    hits = bm25_search(build_bm25(simple(spark, ["x y"] * 5)), spark.createDataFrame([(1, "y x")], "qid int, text string"), 3).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["d1", "d2", "d3"]


def test_top_k_limits_before_the_shuffle(spark):
    plan = bm25_search(build_bm25(simple(spark, ["a"])), spark.createDataFrame([(1, "a")], "qid int, text string"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_vector_search_is_exact(spark, monkeypatch):
    import docsift.operators.vectors as vs

    monkeypatch.setattr(vs, "SHARD_ROWS", 25)
    r = random.Random(1)
    rows = [(f"c{k}", k, f"s{k % 3}", [r.randint(-2, 2) * 1.0 for _ in range(4)]) for k in range(60)]
    v = spark.createDataFrame(rows, "chunk_id string, ordinal int, source_file string, embedding array<double>")
    q = spark.createDataFrame([(k, [r.randint(-2, 2) * 1.0 for _ in range(4)]) for k in range(8)], "qid int, embedding array<double>")
    allowed = spark.createDataFrame([(k, f"s{k % 3}") for k in range(8)], "qid int, source_file string")
    for most, limit in ((3, None), (3, allowed), (4096, None), (4096, allowed)):  # a table of blocks, and one that is sent
        monkeypatch.setattr(vs, "QUERIES_AT_ONCE", most)
        got = {}
        for h in vector_search(v, q, 5, allowed=limit).collect():
            got.setdefault(h.qid, []).append((h.rank, h.chunk_id, h.score))
        for qid, vec in q.collect():
            scored = sorted((-sum(a * b for a, b in zip(vec, e, strict=True)), o, c) for c, o, s, e in rows if limit is None or s == f"s{qid % 3}")
            assert sorted(got.get(qid, [])) == [(k + 1, c, -s) for k, (s, _, c) in enumerate(x for x in scored if x[0] < 0)][:5]


def test_vectors_of_another_length_are_an_error(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 1, None)], "chunk_id string, ordinal int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "qid int, embedding array<double>")
    with pytest.raises(Exception, match="build the index again"):
        vector_search(v, q, 5).collect()
    assert vector_search(v, q.limit(0), 5).count() == vector_search(v.where("ordinal = 1"), q, 5).count() == 0


def test_a_common_vector_gives_each_query_k_rows(spark):
    v = spark.createDataFrame([(f"c{k}", (9 - k % 10, k), [1.0]) for k in range(3000)], "chunk_id string, ordinal struct<a:int,b:int>, embedding array<double>").coalesce(1)
    found = vector_search(v, spark.createDataFrame([(1, [2.0])], "qid int, embedding array<double>"), 4)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["c9", "c19", "c29", "c39"]


def test_rrf_by_hand(spark):
    lists = spark.createDataFrame([(1, 0, "a", 10.0, 1), (1, 0, "b", 5.0, 2), (1, 1, "b", 1.0, 1)], "qid int, list_no int, chunk_id string, score double, rank int")
    got = {r.chunk_id: round(r.score, 6) for r in fusion.rrf(lists).collect()}
    assert got == {"a": 0.046393, "b": 0.077522}
    split = [fusion.rrf(lists.where(f"list_no = {k}")) for k in (0, 1)]
    summed = split[0].unionByName(split[1]).groupBy("chunk_id").agg(F.sum("score").alias("s")).collect()
    assert {r.chunk_id: round(r.s, 6) for r in summed} == got


def test_query_fusion_by_hand(spark):
    hits = lambda rows: spark.createDataFrame(rows, "qid int, chunk_id string, score double, rank int")
    got = fusion.fuse_queries(hits([(1, "a", 1.0, 1), (1, "b", 0.5, 2)]), hits([(1, "b", 2.0, 1)]), 5).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("b", 0.061285), ("a", 0.046393)]


def test_blend_by_hand(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 0.5, 0.0), (1, 2, 0.0, 1.0), (2, 0, 2.0, 3.0), (2, 1, 2.0, 3.0)], "qid int, idx int, score double, rerank_score double")
    got = {(r.qid, r.idx): (r.blended, r.new_rank) for r in rerank.blend(rows, 0.25).collect()}
    assert got == {(1, 0): (0.75, 1), (1, 1): (0.375, 2), (1, 2): (0.25, 3), (2, 0): (1.0, 1), (2, 1): (1.0, 2)}


def test_quality_weights_by_hand(spark):
    rows = spark.createDataFrame([("title", "x" * 24), ("table", "x" * 50), ("text", "x" * 30), ("llm_summary", "　" + "x" * 90)], "k string, t string")
    got = [round(r[0], 6) for r in rows.select(fusion.quality_weight(F.col("k"), F.col("t"))).collect()]
    assert got == [0.396, 0.9184, 0.82, 0.82]


def placed(spark, rows):
    return spark.createDataFrame([(1, c, 1.0 / (k + 1), s, p, p, "text", 0, k, ["h"], k + 1) for k, (c, s, p) in enumerate(rows)], "qid int, chunk_id string, score double, source_file string, page_start int, page_end int, block_type string, first_list int, first_rank int, hints array<string>, pos int")


def test_diversity_and_priority_by_hand(spark):
    d = fusion.diversify(placed(spark, [("0", "s", 1), ("1", "s", 1), ("2", "s", 2), ("3", "s", 3), ("4", "s", 1)]), 4)
    assert [r.chunk_id for r in d.orderBy("pos").collect()] == ["0", "2", "3", "1"]
    rows = [("0", "o", 1), ("1", "h", 2), ("2", "o", 3), ("3", "h", 4), ("4", "h", 5)]
    assert [r.chunk_id for r in fusion.prioritize_sources(placed(spark, rows), 3).orderBy("pos").collect()] == ["1", "3", "4", "0", "2"]
    assert [r.chunk_id for r in fusion.prioritize_sources(placed(spark, rows[:4]), 3).orderBy("pos").collect()] == ["0", "1", "2", "3"]


def test_expansion_takes_the_larger_boost(spark):
    got = {r.chunk_id: round(r.score, 6) for r in fusion.expand(placed(spark, [("a", "s", 1)]), F.lit(30)).collect()}
    assert got == {"a": 1.15}


def test_a_reranker_reorders(spark):
    chunks = simple(spark, ["alpha beta gamma delta", "alpha beta other words", "alpha unrelated text here"])
    engine = Engine.build(chunks, reranker=Reranker("t", lambda q, docs: [float(len(d)) for d in docs], 1.0))
    hits = engine.search(spark.createDataFrame([(1, "alpha beta")], "qid int, query string"), 3).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["d3", "d1", "d2"] or hits[0].score == 1.0


# --- the whole search, plainly -------------------------------------------------------------

KINDS = ["text", "title", "table", "page_summary", "graph_index", "local_heading_index", "outline", "section_summary", "llm_summary"]
WORDS = "设备 频率 检测 干扰 无线电 系统 管理 案例 gsm-r bds 终端 服务 产品 应用 技术".split()


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for k in range(70):
        body = "".join(r.choice(WORDS) + r.choice(["", " ", "，"]) for _ in range(r.randint(2, 30)))
        rows.append((f"c{k:02}", r.choice(["产品手册.pdf", "杂志.pdf", "other.pdf"]), p := r.randint(1, 9), p + (k % 7 == 0), "节", KINDS[k % len(KINDS)], "前缀 " + body, body, k))
    return rows


def plain_search(rows, query, k):
    import re

    by = {r[0]: r for r in rows}
    tokens = {r[0]: tokens_of(r[6]) for r in rows}
    counts = {c: Counter(t) for c, t in tokens.items()}
    n, avg = len(rows), sum(map(len, tokens.values())) / len(rows)
    df = Counter(t for c in counts.values() for t in c)
    vectors = {c: hash_vector(t) for c, t in tokens.items()}

    def words(q, allowed):
        out = []
        for r in rows:
            c = r[0]
            if allowed is not None and c not in allowed:
                continue
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[c][t] * 2.5 / (counts[c][t] + 1.5 * (0.25 + 0.75 * len(tokens[c]) / avg)) for t in tokens_of(q) if t in counts[c])
            if s > 0:
                out.append((c, round(s, 9)))
        return sorted(out, key=lambda x: -x[1])[:most]

    def near(q, allowed):
        v = hash_vector(tokens_of(q))
        out = [(r[0], round(sum(a * b for a, b in zip(v, vectors[r[0]], strict=True)), 9)) for r in rows if allowed is None or r[0] in allowed]
        return sorted([x for x in out if x[1] > 0], key=lambda x: -x[1])[:most]

    hints = {s for w, s in (("产品手册", "产品手册.pdf"), ("杂志", "杂志.pdf")) if w in query}
    nav = any(w in query for w in ("有哪些", "列举", "案例", "目录", "文章", "主题"))
    most = 60 if nav else 30
    allowed = {r[0] for r in rows if r[1] in hints} if hints else set()
    variants = [query]
    for part in re.split("[，,；;。\n]|并|以及|同时|且", query):
        part = part.strip(" ？?：:")
        if len(part) >= 4 and part not in variants:
            variants.append(part)
    lists = []
    for v in variants[:8]:
        lists += [words(v, None), near(v, None)]
        if allowed:
            lists += [words(v, allowed), near(v, allowed)]
    score = {}
    for ranked in lists:
        for rank, (c, s) in enumerate(ranked, 1):
            score[c] = score.get(c, 0) + 1 / (60 + rank) + 0.03 * s / ranked[0][1]
    stop = set("中国 中国无 无线电 杂志 记录 记录了 哪些 有哪些 典型 列举 包括 包括哪些 根据 这期 文章 主题 目录".split())
    terms = {t for t in tokens_of(query) if len(t) >= 2 and t not in stop}
    for c in score:
        _, source, _, _, _, kind, _, shown, _ = by[c]
        f = (1.35 if source in hints else 0.85) if hints else 1
        f *= {"title": 0.72, "outline": 0.72, "local_heading_index": 0.72, "graph_index": 0.72, "table": 1.12, "page_summary": 1.04, "llm_summary": 0.82}.get(kind, 1)
        f *= 0.55 if len(shown.strip()) < 25 else 0.82 if len(shown.strip()) < 80 else 1
        if nav:
            cover = len(terms & set(tokens_of(shown))) / len(terms) if terms else 0
            f *= {"outline": 2.2, "page_summary": 1.18, "section_summary": 1.18, "llm_summary": 1.08}.get(kind, 1)
            f *= (0.58 if cover < 0.2 else 1.35 + 2.2 * cover) if kind == "local_heading_index" else 1
            f *= (0.72 if cover < 0.2 else 1.2 + 1.8 * cover) if kind == "graph_index" else 1
        score[c] *= f
    ranked = sorted(score, key=lambda c: -round(score[c], 11))
    sources, pages = {by[c][1] for c in ranked[:8]}, {by[c][1:3] for c in ranked[:8]}
    boosted = dict(score)
    for c in ranked[:most]:
        leaf = by[c][5] in ("text", "table", "table_body")
        if by[c][1:3] in pages and leaf:
            boosted[c] = score[c] * 1.15
        elif by[c][1] in sources and (leaf or by[c][5] in ("page_summary", "section_summary")):
            boosted[c] = score[c] * 1.08
    priority = {"table_body": 5, "table": 5, "text": 4, "page_summary": 3, "title": 1, "outline": 0}
    ranked = sorted(score, key=lambda c: (-round(boosted[c], 11), -priority.get(by[c][5], 2)))
    inside = [c for c in ranked if by[c][1] in hints]
    if hints and len(inside) >= max(1, min(k, 3)):
        ranked = inside + [c for c in ranked if by[c][1] not in hints]
    seen, first, rest = set(), [], []
    for c in ranked:
        (rest if by[c][1:4] in seen else first).append(c)
        seen.add(by[c][1:4])
    return [(c, round(boosted[c], 7)) for c in (first + rest)[:k]]


@pytest.mark.parametrize("query", ["干扰检测设备的频率，并说明系统管理", "产品手册有哪些终端设备", "杂志里的案例和无线电应用技术", "gsm-r", "没有的词汇xyz"])
def test_the_whole_search(spark, query):
    rows = corpus(3)
    engine = Engine.build(chunks_of(spark, rows))
    hits = engine.search(spark.createDataFrame([(1, query)], "qid int, query string"), 9).orderBy("rank").collect()
    assert [(h.chunk_id, round(h.score, 7)) for h in hits] == plain_search(rows, query, 9)


def test_enhanced_queries_are_fused(spark):
    engine = Engine.build(chunks_of(spark, corpus(4)))
    q = spark.createDataFrame([(1, "设备频率", "检测干扰系统"), (2, "系统管理", "系统管理")], "qid int, query string, enhanced string")
    got = engine.retrieve(q, 5)
    plain = engine.retrieve(q.select("qid", "query"), 5)
    assert {(r.qid, r.rank) for r in got.collect()} == {(a, b) for a in (1, 2) for b in range(1, 6)}
    assert got.where("qid = 2").exceptAll(plain.where("qid = 2")).count() == 0
    assert got.where("qid = 1").exceptAll(plain.where("qid = 1")).count() > 0


def test_answers_cite_the_hits(spark):
    engine = Engine.build(chunks_of(spark, corpus(5)))
    q = spark.createDataFrame([(1, "设备频率"), (2, "qqqq")], "qid int, query string")
    got = {r.qid: r.answer for r in engine.answer(q, 2).collect()}
    assert "[1] 《" in got[1] and "[2] 《" in got[1] and "[3] 《" not in got[1] and got[2] == "文档中没有提供相关信息。"


def test_a_small_query_batch_is_broadcast_and_columns_are_pruned(spark):
    chunks = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("doc_id").alias("ordinal"), F.col("text").alias("index_text"))
    plan = bm25_search(build_bm25(chunks), spark.createDataFrame([(1, "a")], "qid int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
    assert all("n_chars" not in line for line in plan.split("\n") if "ReadSchema" in line)


def test_hash_embedder_is_the_plain_one(spark):
    texts = ["GSM-R 频率", "", None, "a b a 频率频率 _x-y", corpus(1)[0][6]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").coalesce(1).select("k", HashEmbedder().embed(F.col("s")).alias("v")).collect()
    for r in rows:
        vector = [0.0] * 384
        for token, count in Counter(tokens_of(texts[r.k] or "")).items():
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            vector[int.from_bytes(digest[:4], "little") % 384] += (1 - 2 * (digest[4] % 2)) * (1 + math.log(count))
        length = math.sqrt(sum(x * x for x in vector))
        assert r.v == pytest.approx([x / length if length else 0.0 for x in vector])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert spark.read.parquet(f"{SF}/benchmark.parquet").count() * 8 == e.entry(spark).count()


# --- what grows with the chunks ------------------------------------------------------------


def test_only_chunks_that_are_found_travel_with_their_texts(spark, monkeypatch):
    import docsift.plans.engine as module

    kept, write = {}, module.written

    def watch(rows, name, *more):
        kept[name] = write(rows, name, *more)
        return kept[name]

    monkeypatch.setattr(module, "written", watch)
    chunks = simple(spark, [f"word{k} of chunk {k}" for k in range(300)])
    hits = Engine.build(chunks).search(spark.createDataFrame([(1, "word7"), (2, "word8")], "qid int, query string"), 3).collect()
    assert {h.chunk_id for h in hits} >= {"d8", "d9"}
    found = {r.chunk_id for r in kept["fused"].collect()}
    assert {r.chunk_id for r in kept["held"].collect()} == found and len(found) < 300


def test_a_search_counts_only_the_terms_asked_for(spark):
    index = build_bm25(simple(spark, ["a b", "a c", "d"])).written()
    some = index.only(spark.createDataFrame([("a",), ("z",)], "term string"))
    every = {r.term: (r.df, r.idf) for r in index.terms.collect()}
    assert {r.term: (r.df, r.idf) for r in some.terms.collect()} == {"a": every["a"]} and every["a"][0] == 2


def test_later_slices_give_only_rows_that_reach_the_kth_score(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    import docsift.operators.vectors as vs

    monkeypatch.setattr(vs, "ROWS_AT_ONCE", 10)
    score = np.random.default_rng(3).integers(-3, 40, 1000).astype(float)
    score[500] = np.nan
    block = vs.Block(pa.table({"qid": [1], "v": [[1.0]], "sources": pa.array([None], pa.list_(pa.string()))}))
    rows = [r for b in block.hits(pa.array(range(1000)), pa.array(range(1000)), pa.array([[s] for s in score]), pa.nulls(1000, pa.string()), 5) for r in b.to_pylist()]
    best = sorted((-s, k) for k, s in enumerate(score) if s > 0)[:5]
    assert sorted((-r["score"], r["chunk_id"]) for r in rows)[:5] == best and len(rows) < 100


def test_terms_of_headings_are_taken_once_for_each_chunk(spark):
    chunks = simple(spark, ["alpha beta"]).withColumn("block_type", F.lit("graph_index"))
    fused = spark.createDataFrame([(1, "d1", 1.0, 0, 1)], "qid int, chunk_id string, score double, first_list int, first_rank int")
    asked = spark.createDataFrame([(1, ["h"], True, ["alpha", "gamma"])], "qid int, hints array<string>, navigation boolean, terms array<string>")
    rows = fusion.weigh(fused, chunks, asked)
    assert round(rows.first()["score"], 6) == round(0.85 * 0.72 * 0.55 * (1.2 + 1.8 * 0.5), 6)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # the two branches of one tokenize


def test_letters_of_any_text(spark):
    from docsift.plans.models import LetterEmbedder

    texts = ["", None, "Aab é z", "zzz", "İk 频"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", LetterEmbedder().embed(F.col("t")).alias("v"))
    got = {r.k: r.v for r in rows.collect()}
    for k, t in enumerate(texts):
        counts = [(t or "").lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"]
        n = math.sqrt(sum(c * c for c in counts)) or 1
        assert got[k] == pytest.approx([c / n for c in counts])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 1
