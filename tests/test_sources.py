import json
import os

import pytest
from pyspark.sql import functions as F

from docsift.operators import chunking
from docsift.operators.bm25 import bm25_search, build_bm25
from docsift.operators.evaluate import hit_ranks, metrics
from docsift.plans import models
from docsift.plans.config import get_settings
from docsift.plans.engine import Engine
from docsift.sources import storage
from docsift.sources.layout import load_blocks
from docsift.streaming.upsert import current, upsert_stream


def write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "parsed files"
    flat = [
        {"type": "text", "text": "# 应用场景", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "a &amp; b <i>c</i>", "page_idx": 0}, {"type": "header", "text": "gone"},
        {"type": "table", "table_body": "<td>1</td> 2", "table_caption": ["list"], "page_idx": 1}, {"type": "text", "text": "  "}, {"type": "text", "text": "untitled", "text_level": "1", "page_idx": 2}, "no object", {"type": "text", "text": 5}, {"type": "image_caption", "table_footnote": "note"},
    ]
    write(root / "产品手册.pdf-1", "full.md", "")
    write(root / "产品手册.pdf-1", "x_content_list_v2.json", [{"type": "text", "text": "second choice"}])
    write(root / "产品手册.pdf-1", "x_content_list.json", flat)
    write(root / "b.pdf-2", "full.md", "")
    write(root / "b.pdf-2", "x_content_list.json", [{"type": "header", "text": "nothing here"}])
    write(root / "b.pdf-2", "block_list.json", {"pdfData": [[{"type": "title", "text": "First", "level": 1}, {"type": "text", "text": "dropped", "is_discarded": True}], [{"type": "title", "text": "Second", "level": 2}, {"type": "text", "text": "body", "page_idx": 4, "text_level": 1}]]})
    write(root / "noname", "full.md", "")
    write(root / "noname", "orig_origin.pdf", "")
    write(root / "noname", "a_content_list.json", [{"type": "text", "text": "lone"}])
    write(root / "incomplete.pdf-3", "x_content_list.json", [{"type": "text", "text": "no full.md"}])
    write(root / "deep" / "c.pdf-4", "full.md", "")
    write(root / "deep" / "c.pdf-4", "x_content_list.json", [{"type": "text", "text": "too deep"}])
    return str(root)


def test_layouts_become_blocks(spark, root):
    got = [(r.source_file, r.page, r.block_type, r.text, r.section) for r in load_blocks(spark, root).orderBy("doc_key", "block_pos").collect()]
    assert got == [
        ("b.pdf", 1, "title", "First", "First"), ("b.pdf", 1, "title", "Second", "First > Second"), ("b.pdf", 5, "text", "body", "First > Second"),
        ("orig_origin.pdf", 1, "text", "lone", ""),
        ("产品手册.pdf", 1, "title", "# 应用场景", "应用场景"), ("产品手册.pdf", 1, "text", "a & b c", "应用场景"), ("产品手册.pdf", 2, "table", "1 2", "应用场景"), ("产品手册.pdf", 3, "text", "untitled", "应用场景"), ("产品手册.pdf", 1, "image_caption", "note", "应用场景"),
    ]


def small_chunks(spark):
    rows = [("f", "f", k, 1 + k // 3, "text", f"chunk number {k} about topic {k % 4} with words", "s", None) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_key string, source_file string, block_pos int, page int, block_type string, text string, section string, image_refs array<string>")
    return chunking.build_chunks(chunking.number_blocks(df))


def test_chunk_files_are_smaller_than_the_texts_they_hold(spark, tmp_path):
    chunks = small_chunks(spark).withColumn("display_text", F.repeat("display_text", F.lit(50)))
    chunks = chunks.withColumns({"raw_text": F.col("display_text"), "index_text": F.col("display_text")}).cache()
    storage.write_chunks(chunks, str(tmp_path))
    texts = chunks.agg(F.sum(F.octet_length("display_text")).alias("n")).first()["n"]
    assert sum(f.stat().st_size for f in tmp_path.glob("part-*")) < texts


def test_chunks_survive_a_round_trip_in_order(spark, tmp_path):
    chunks = small_chunks(spark).cache()
    storage.write_chunks(chunks, str(tmp_path / "chunks"))
    back = storage.read_chunks(spark, str(tmp_path / "chunks"))
    want = [r.chunk_id for r in chunks.orderBy("family", "order_key").collect()]
    assert [r.chunk_id for r in back.orderBy("ordinal").collect()] == want
    assert back.drop("ordinal").exceptAll(chunks.select(*storage.CHUNK_COLUMNS)).count() == 0
    write(tmp_path / "bad", "x.json", '{"chunk_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        storage.read_chunks(spark, str(tmp_path / "bad")).collect()


def test_an_index_survives_a_round_trip(spark, tmp_path):
    chunks = small_chunks(spark).withColumn("ordinal", F.struct("family", "order_key"))
    index, q = build_bm25(chunks), spark.createDataFrame([(1, "topic 3")], "qid int, text string")
    storage.save_bm25(index, str(tmp_path / "bm25"))
    key = lambda rows: sorted((r.rank, r.chunk_id, r.score) for r in rows.collect())
    assert key(bm25_search(storage.load_bm25(spark, str(tmp_path / "bm25")), q)) == key(bm25_search(index, q)) != []
    storage.write_manifest(spark, str(tmp_path / "m"), 9, "hashing-fallback", 384)
    assert storage.check_manifest(spark, str(tmp_path / "m"), "hashing-fallback", 384)["chunk_count"] == 9
    with pytest.raises(ValueError, match="build the index again"):
        storage.check_manifest(spark, str(tmp_path / "m"), "other", 384)


def test_questions_metrics_and_broken_lines(spark, tmp_path):
    lines = ['{"q_id": "q1", "source": "f", "query_type": "answerable", "question": "a", "gold_chunks": [{"page": 3}]}', "", '{"q_id": "q2", "source": "", "query_type": "answerable", "question": "b", "gold_chunks": [{"page": "5-6", "section": "x"}]}', "{broken", '{"q_id": "q3", "source": "f", "query_type": "unanswerable", "question": "c", "gold_chunks": []}', '{"q_id": "q4", "source": "g", "query_type": "answerable", "question": "d", "gold_chunks": [{"page": 1}]}']
    write(tmp_path, "qa.jsonl", "\n".join(lines))
    qa, bad = storage.read_qa(spark, str(tmp_path / "qa.jsonl"))
    assert qa.count() == 4 and bad.count() == 1
    hits = spark.createDataFrame([("q1", 1, "g", 3, 3), ("q1", 2, "f", 2, 4), ("q2", 1, "z", 6, 9), ("q4", 1, "g", 2, 2)], "qid string, rank int, source_file string, page_start int, page_end int")
    ranks = {r.q_id: (r.hit_rank, r.top1_ok) for r in hit_ranks(qa, hits).collect()}
    assert ranks == {"q1": (2, False), "q2": (1, True), "q4": (None, True)}
    m = metrics(hit_ranks(qa, hits)).first()
    assert (m.questions, round(m.recall, 6), round(m.mrr, 6), round(m.source_accuracy, 6)) == (3, 0.666667, 0.5, 0.666667)
    assert metrics(hit_ranks(qa.limit(0), hits)).first()[:] == (0, 0.0, 0.0, 0.0)


def test_settings_come_from_the_environment(tmp_path, monkeypatch):
    write(tmp_path, ".env", "# note\nLLM_MODEL=from-file\nRERANKER_WEIGHT=0.4\nENABLE_LLM_VERIFIER=yes\n")
    for name in ("RERANKER_WEIGHT", "ENABLE_LLM_VERIFIER", "LLM_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("LLM_MODEL", "from-env")
    s = get_settings(tmp_path / ".env", data_dir="x")
    assert (s.llm_model, s.reranker_weight, s.enable_llm_verifier, s.chunks_path) == ("from-env", 0.4, True, "x/chunks")
    assert s.embedding_base_url == s.llm_base_url and "api_key" not in repr(s)
    for name in ("RERANKER_WEIGHT", "ENABLE_LLM_VERIFIER"):  # which the file has set
        os.environ.pop(name, None)


def test_models_are_chosen_by_settings():
    s = get_settings()
    assert models.get_embedder(s).name == "hashing-fallback" and models.get_reranker(s) is None and models.chat_client(s) is None
    assert models.get_embedder(get_settings(embedding_api_key="k", embedding_model="m")).name == "openai-compatible:m"
    assert models.get_embedder(get_settings(local_embedding_model="m")).name == "sentence-transformers:m"
    assert models.get_embedder(get_settings(local_embedding_model="m", use_flagembedding=True)).name == "flagembedding-m3:m"
    assert models.get_reranker(get_settings(reranker_api_key="k", reranker_model="m")).name == "api-reranker:m"
    assert models.get_reranker(get_settings(local_reranker_model="m")).weight == 0.25


@pytest.mark.parametrize(("data", "want"), [({"results": [{"index": 1, "relevance_score": 0.5}]}, [-1.0, 0.5, -3.0]), ({"data": [{"document_index": "0", "score": 2}, {"id": 9, "score": 1}, "x"]}, [2.0, -2.0, -3.0]), ({}, [3.0, 2.0, 1.0])])
def test_service_scores(data, want):
    assert models.response_scores(data, 3) == want


@pytest.mark.parametrize(("reply", "want"), [("no json", True), ('x {"answerable": true, "supported": false} y', False), ('{"answerable": true, "supported": true}', True), ("{broken}", True)])
def test_verdicts(reply, want):
    assert models.supported(reply) is want


def test_answers_with_and_without_a_model(spark):
    q = spark.createDataFrame([(1, "question one"), (2, "fails"), (3, "no hits")], "qid int, query string")
    hits = spark.createDataFrame([(k, 1, "f", 1, 2, "s", "text") for k in (1, 2)], "qid int, rank int, source_file string, page_start int, page_end int, section string, display_text string")
    plain = {r.qid: r.answer for r in models.generate(q, hits, None).collect()}
    assert "[1] 《f》第 1-2 页，s\ntext" in plain[1] and plain[3] == "文档中没有提供相关信息。"

    def chat(system, user, temperature):
        if "fails" in user:
            raise RuntimeError("down")
        return '{"answerable": true, "supported": false}' if temperature == 0.0 else " answer [1] "

    got = {r.qid: r.answer for r in models.generate(q, hits, chat).collect()}
    assert got[1] == "answer [1]" and got[2].startswith("LLM API 调用失败") and plain[2] in got[2] and got[3] == plain[3]
    assert {r.qid: r.answer for r in models.generate(q, hits, chat, verify=True).collect()}[1] == plain[3]
    assert {r.qid: r.enhanced for r in models.enhance(q, chat).collect()} == {1: "answer [1]", 2: "fails", 3: "answer [1]"}
    assert [r.enhanced for r in models.enhance(q, None).collect()] == ["question one", "fails", "no hits"]


def test_a_given_embedder_serves_both_sides(spark):
    made = models.FunctionEmbedder("length", 2, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    engine = Engine.build(small_chunks(spark), made)
    hits = engine.search(spark.createDataFrame([(1, "zzz")], "qid int, query string"), 3).collect()
    assert len(hits) == 3 and all(h.score > 0 for h in hits)


def test_streamed_upserts_keep_places_and_take_the_last_values(spark, tmp_path):
    schema = "chunk_id string, v int, ordinal long"
    source = tmp_path / "in"
    for k, rows in enumerate(([("x", 1, 0), ("y", 1, 1)], [("y", 2, 0), ("z", 3, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        q = upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    table = current(spark, str(tmp_path / "table"), "chunk_id string, v int, ordinal struct<batch:bigint,at:string>")
    assert [(r.chunk_id, r.v) for r in table.orderBy("ordinal").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_saving_an_index_reads_the_texts_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    chunks = small_chunks(spark).select("chunk_id", "source_file", "index_text").cache()
    n = chunks.count()
    index = build_bm25(chunks.mapInArrow(count, chunks.schema))
    storage.save_bm25(index, str(tmp_path / "bm25"))
    assert read.value == 2 * n  # tokens, and the number of chunks


def test_items_are_parsed_for_all_fields_at_once(spark):
    from docsift.sources.layout import blocks_of_items

    items = [{"type": "text", "text": " ", "table_body": "a <b>b</b> &amp; c", "text_level": 1, "page_idx": "2"}, {"type": "text", "text": 5, "table_caption": "x", "text_level": 1.5}, {"type": "table", "text": ["no"], "page_idx": 3.0}, "no object"]
    rows = spark.createDataFrame([("d", "s", "1", k, i if isinstance(i, str) else json.dumps(i)) for k, i in enumerate(items)], "doc_key string, source_file string, priority string, block_pos int, item string")
    got = blocks_of_items(rows, True)
    assert [(r.block_pos, r.block_type, r.text, r.level, r.page) for r in got.orderBy("block_pos").collect()] == [(0, "title", "a b & c", 1, 3), (1, "text", "x", None, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and plan.count("<[^>]+>") == 1
