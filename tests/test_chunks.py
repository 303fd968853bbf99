import random

from pyspark.sql import functions as F

from docsift.operators import chunking
from docsift.operators.merge import summary_candidates, summary_chunks, upsert
from docsift.sources.layout import section_paths, title_level

BLOCKS = "doc_key string, source_file string, block_pos int, page int, block_type string, text string, section string, image_refs array<string>"


def blocks(spark, rows):
    """rows: (file, page, type, text, section)"""
    return chunking.number_blocks(spark.createDataFrame([(f, f, k, p, t, x, s, None) for k, (f, p, t, x, s) in enumerate(rows)], BLOCKS))


def test_section_paths_by_hand(spark):
    rows = [("d", k, name, level) for k, (name, level) in enumerate([("A", 1), ("B", 2), (None, None), ("C", 2), ("D", 3), ("E", 1)])] + [("e", 0, None, None)]
    df = spark.createDataFrame(rows, "doc_key string, block_pos int, title string, title_level int")
    got = [r.section for r in section_paths(df).orderBy("doc_key", "block_pos").collect()]
    assert got == ["A", "A > B", "A > B", "A > C", "A > C > D", "E", ""]


def test_section_paths_match_a_stack(spark):
    r, rows, want = random.Random(7), [], {}
    for d in range(40):
        stack = []
        for k in range(25):
            level = r.choice([None, 1, 2, 3, 4, -1])
            if level is not None:
                stack = [(lv, n) for lv, n in stack if lv < level] + [(level, f"t{k}")]
            rows.append((f"d{d}", k, None if level is None else f"t{k}", level))
            want[f"d{d}", k] = " > ".join(n for _, n in stack)
    df = spark.createDataFrame(rows, "doc_key string, block_pos int, title string, title_level int").repartition(3)
    assert {(x.doc_key, x.block_pos): x.section for x in section_paths(df).collect()} == want


def test_title_levels_by_hand(spark):
    rows = spark.createDataFrame([("应用场景", 1), ("抗干扰检测设备", 3), ("概述", None)], "t string, l int")
    assert [r[0] for r in rows.select(title_level(F.col("t"), F.col("l"))).collect()] == [2, 1, 2]


def test_block_numbers_run_over_files(spark):
    rows = [(f"f{k % 7}", 1, "text", "x" * 30, "") for k in range(50)]
    got = sorted((r.doc_key, r.block_pos, r.block_index) for r in blocks(spark, rows).collect())
    assert [g[2] for g in got] == list(range(50))


def test_short_leaves_go_unless_tables(spark):
    got = chunking.leaf_chunks(blocks(spark, [("f", 1, "title", "t" * 19, "s"), ("f", 1, "table_body", "t" * 19, "s"), ("f", 1, "text", "t" * 20, "s")])).collect()
    assert sorted(len(r.display_text) for r in got) == [19, 20]
    assert got[0].contextual_prefix.startswith("该片段来自《f》第 1 页，章节/栏目为“s”，内容类型为 ")
    assert all(r.index_text == r.contextual_prefix + "\n" + r.display_text for r in got)


def titles(spark, pages, section=None):
    return chunking.leaf_chunks(blocks(spark, [("f", p, "title", f"a heading of some length {k:03}", section or f"s{k}") for k, p in enumerate(pages)]))


def test_heading_windows_by_hand(spark):
    got = chunking.heading_chunks(titles(spark, [1, 2, 3, 9, 10, 11])).orderBy("order_key").collect()
    assert [(r.order_key.b, r.page_start, r.page_end) for r in got] == [(0, 1, 3), (1, 9, 11), (2, 9, 11)]
    assert got[1].display_text == got[2].display_text and got[1].chunk_id != got[2].chunk_id


def test_outline_by_hand(spark):
    assert [len(r.display_text.split("\n")) for r in chunking.outline_chunks(titles(spark, range(1, 32))).orderBy("order_key").collect()] == [30, 1]


def test_the_commonest_section_names_a_page_and_the_first_wins_ties(spark):
    body = "some words that make up a leaf of enough length {}"
    rows = [("f", 1, "text", body.format(k), s) for k, s in enumerate(["late", "b", "b", "late"])] + [("f", 2, "text", body.format(9), "b")]
    got = chunking.page_chunks(chunking.leaf_chunks(blocks(spark, rows))).collect()
    assert [(r.page_start, r.section) for r in got] == [(1, "late")]


def test_all_families_come_in_order(spark):
    rows = []
    for k in range(24):
        rows.append(("f", 1 + k // 4, "title" if k % 3 == 0 else "text", f"block {k} " + "with quite a few words in it " * 3, f"top > part {k // 6}"))
    got = chunking.build_chunks(blocks(spark, rows)).orderBy("family", "order_key").collect()
    assert [k for k in dict.fromkeys(r.block_type for r in got if r.family)] == ["page_summary", "section_summary", "local_heading_index", "graph_index", "outline"]
    assert len({r.chunk_id for r in got}) == len(got)
    graph = next(r for r in got if r.block_type == "graph_index")
    assert graph.section == "结构图索引：top" and "top -> part 0" in graph.display_text


def test_upsert_by_hand(spark):
    layer = lambda rows: spark.createDataFrame(rows, "chunk_id string, v int, ordinal int")
    once = upsert(layer([("x", 1, 0)]), layer([("x", 2, 0), ("y", 1, 1)]), layer([("y", 3, 0)]))
    assert [(r.chunk_id, r.v) for r in once.orderBy("ordinal").collect()] == [("x", 2), ("y", 3)]
    flat = once.select("chunk_id", "v", F.col("ordinal.layer").alias("ordinal"))
    again = upsert(flat, flat)
    assert sorted((r.chunk_id, r.v) for r in again.collect()) == [("x", 2), ("y", 3)]


def test_summaries_skip_what_has_one(spark):
    rows = [(f"c{k}", "f", 1, 2, "s", "page_summary", "x" * (150 + k), None, k) for k in range(20)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, page_start int, page_end int, section string, block_type string, display_text string, image_refs array<string>, ordinal int")
    first = summary_candidates(chunks, limit=4).orderBy("ordinal").collect()
    assert [r.chunk_id for r in first] == ["c10", "c11", "c12", "c13"]
    made = summary_chunks(summary_candidates(chunks, limit=4).withColumn("summary", F.when(F.col("chunk_id") == "c11", " ").otherwise(" short ")))
    assert {r.display_text for r in made.collect()} == {"short"} and made.count() == 3
    more = chunks.unionByName(made.select(chunks.columns))
    assert summary_candidates(more).count() == 10 - 3


def test_leaves_are_written_with_their_text_once(spark, monkeypatch):
    held = []

    def keep(rows, name, *options):
        held.append((name, rows.columns))
        return rows

    rows = [("f", "f", k, 1, "text", f"chunk number {k} with a few words", "s", None) for k in range(3)]
    blocks = spark.createDataFrame(rows, "doc_key string, source_file string, block_pos int, page int, block_type string, text string, section string, image_refs array<string>")
    numbered = chunking.number_blocks(blocks)
    monkeypatch.setattr(chunking, "written", keep)
    got = chunking.build_chunks(numbered).where("family = 0")
    [columns] = [c for name, c in held if name == "leaves"]
    assert "display_text" in columns and not {"raw_text", "index_text"} & set(columns)
    assert sorted(map(str, got.select(*chunking.COLUMNS).collect())) == sorted(map(str, chunking.leaf_chunks(numbered).select(*chunking.COLUMNS).collect()))


def test_leaves_are_made_once_and_cleaned_once_for_pages(spark):
    numbered = blocks(spark, [("f", 1, "text", "some words that make up a leaf of enough length", "s")])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    leaves = chunking.leaf_chunks(numbered)
    assert plan(leaves).count("<[^>]+>") == 1
    assert plan(chunking.page_chunks(leaves)).count("Generate posexplode") == 1
