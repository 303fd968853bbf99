import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docsift.operators.bm25 import bm25_search, build_bm25
from docsift.sources.scratch import shared_folder
from jobs import chunk_intake, evidence_report
from jobs.settings import load

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, chunk_id int, batch string"


def add(spark, rows, folder):
    """Documents as one more file of a folder, with columns whose names the job uses itself."""
    full = [(*r, 1, "x") for r in rows]
    spark.createDataFrame(full, DOCS).coalesce(1).write.mode("append").parquet(folder)


def texts(spark, out):
    return {(r.doc_id, r.part): r.display_text for r in chunk_intake.current_chunks(spark, out).collect()}


def long(word, n=300):
    return " ".join(f"{word}{i}" for i in range(n))


def test_intake_takes_only_what_is_new(spark, tmp_path):
    docs, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    add(spark, [(1, long("one"), "a"), (2, "a text of twenty characters", None), (3, None, "b"), (4, "", "b"), (None, long("none"), "a"), (5, "too short", "b")], docs)
    assert chunk_intake.run(spark, docs, out, state) == 1
    first = texts(spark, out)
    assert {i for i, _ in first} == {1, 2} and first[2, 0] == "a text of twenty characters" and len([k for k in first if k[0] == 1]) > 2
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert chunk_intake.run(spark, docs, out, state) == 0 and texts(spark, out) == first
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")} == files

    # a revised document, one that is emptied, a new one, and one that is twice in a file
    add(spark, [(1, "document one is now much shorter", "a"), (2, "", None), (6, "the sixth document, first form", "c"), (6, "the sixth document, last form", "c")], docs)
    assert chunk_intake.run(spark, docs, out, state) == 1
    assert texts(spark, out) == {(1, 0): "document one is now much shorter", (6, 0): "the sixth document, last form"}
    assert set(files) <= set((tmp_path / "out").rglob("*.parquet"))  # nothing written before was rewritten
    sources = {r.doc_id: r.source_file for r in chunk_intake.current_chunks(spark, out).collect()}
    assert sources == {1: "a", 6: "c"}


def test_index_of_a_grown_table_searches_as_one_built_at_once(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").where("doc_id is not null")
    docs, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    for part in range(3):
        whole.where(F.col("doc_id") % 3 == part).coalesce(2).write.mode("append").parquet(docs)
        assert chunk_intake.run(spark, docs, out, state, chunk_intake.Settings(files_per_batch=1)) >= 1
    chunks = chunk_intake.chunks_of(whole).withColumn("ordinal", F.struct("doc_id", "part"))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as qid", "text")
    want = {(r.qid, r.rank): (r.chunk_id, r.score) for r in bm25_search(build_bm25(chunks, "display_text"), asked, 5).collect()}
    got = {(r.qid, r.rank): (r.chunk_id, r.score) for r in bm25_search(chunk_intake.current_index(spark, out), asked, 5).collect()}
    assert got == want and len(got) > 100


def test_a_batch_that_failed_runs_again_with_the_same_result(spark, tmp_path, monkeypatch):
    docs, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    add(spark, [(1, long("one"), "a"), (2, long("two"), "b")], docs)
    write = chunk_intake._write

    def failing(rows, path, number, parts):
        write(rows, path, number, parts)
        if path.endswith("chunks"):
            raise RuntimeError("stopped between two tables")

    monkeypatch.setattr(chunk_intake, "_write", failing)
    with pytest.raises(Exception, match="stopped between"):
        chunk_intake.run(spark, docs, out, state)
    monkeypatch.undo()
    assert chunk_intake.run(spark, docs, out, state) == 1
    rows = chunk_intake.current_chunks(spark, out)
    assert rows.count() == rows.select("chunk_id").distinct().count() == chunk_intake.chunks_of(spark.read.parquet(docs)).count()
    assert chunk_intake.current_index(spark, out).postings.groupBy("chunk_id").count().count() == rows.count()


def test_intake_of_an_empty_folder_and_without_partitions(spark, tmp_path):
    docs, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    (tmp_path / "docs").mkdir()
    settings = chunk_intake.Settings(partition_by=[])
    assert chunk_intake.run(spark, docs, out, state, settings) == 0
    assert chunk_intake.current_chunks(spark, out).count() == chunk_intake.current_index(spark, out).postings.count() == 0
    add(spark, [(1, long("one"), "a/b=c"), (2, long("two"), "")], docs)
    assert chunk_intake.run(spark, docs, out, state, settings) == 1
    assert {r.source_file for r in chunk_intake.current_chunks(spark, out).collect()} == {"a/b=c", ""}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_intake_moves_and_stores_texts_once(spark, tmp_path, monkeypatch):
    docs, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    add(spark, [(1, long("one"), "a"), (2, long("two"), None), (3, long("three"), "c")], docs)
    seen, write = [], chunk_intake._write
    monkeypatch.setattr(chunk_intake, "_write", lambda rows, path, *rest: (seen.append((path, plan(rows))), write(rows, path, *rest)))
    monkeypatch.setattr(chunk_intake, "LEFT_OUT_SENT", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunk_intake.run(spark, docs, out, state)
        assert all("Exchange" not in p and "Join" not in p and "Sort" not in p for _, p in seen) and len(seen) == 3
        assert "Exchange" not in plan(chunk_intake.current_chunks(spark, out))
        add(spark, [(2, long("again"), "b")], docs)
        chunk_intake.run(spark, docs, out, state)
        assert "BroadcastHashJoin" in plan(chunk_intake.current_chunks(spark, out))
        add(spark, [(3, long("first"), "c"), (3, long("last"), "c")], docs)
        chunk_intake.run(spark, docs, out, state)
        assert "SortMergeJoin" in plan(chunk_intake.current_chunks(spark, out))  # two are left out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = chunk_intake.current_chunks(spark, out)
    want = chunk_intake.chunks_of(spark.createDataFrame([(1, long("one"), "a"), (2, long("again"), "b"), (3, long("last"), "c")], "doc_id long, text string, source string"))
    columns = ["chunk_id", "section", "block_type", "index_text", "display_text"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert "index_text" not in spark.read.parquet(f"{out}/chunks").columns
    # the postings of a chunk are one run in its file
    for _, ids in spark.read.parquet(f"{out}/postings").select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "chunk_id").orderBy("i").groupBy("f").agg(F.sort_array(F.collect_list(F.struct("i", "chunk_id")))).collect():
        runs = [a.chunk_id for a, b in zip(ids, [None, *ids[:-1]], strict=True) if b is None or a.chunk_id != b.chunk_id]
        assert len(runs) == len(set(runs))


QUESTIONS = "conv_id long, turn long, role string, text string, rank int"


def test_report_of_questions(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("docs", "asked", "report"))
    add(spark, [(1, "the turbine runs at 300 rpm and weighs little", "a"), (2, "pumps move water through long pipes", "b"), (3, None, "b"), (None, "turbine turbine turbine turbine", "z")], docs)
    rows = [(1, 0, "user", "turbine rpm", 1), (1, 1, "assistant", "turbine", 1), (2, 0, "user", "zebra crossing rules", 1), (3, 0, "user", None, 1), (4, 0, "user", "pumps", 1), (4, 0, "user", "pipes", 1), (None, 0, "user", "pumps", 1)]
    spark.createDataFrame(rows, QUESTIONS).write.parquet(asked)
    seen = []
    for _ in range(2):
        evidence_report.run(spark, asked, out, docs)
        got = {(r.conv_id, r.turn): r for r in evidence_report.read_report(spark, out).collect()}
        seen.append({k: (r.sufficient, r.coverage, r.missing, r.note, [(e.chunk_id, e.source_file) for e in r.evidence or []]) for k, r in got.items()})
    assert seen[0] == seen[1] and set(seen[0]) == {(1, 0), (2, 0), (3, 0), (4, 0)}
    assert seen[0][1, 0][:3] == (True, 1.0, []) and seen[0][1, 0][4][0][1] == "a"
    assert seen[0][2, 0][:2] == (False, 0.0) and seen[0][2, 0][2] == ["crossing", "rules", "zebra"] and "0.00" in seen[0][2, 0][3]
    assert not seen[0][3, 0][0] and seen[0][4, 0][0]
    assert {(r.source_file, r.found, r["first"]) for r in spark.read.parquet(f"{out}/sources").collect()} == {("a", 1, 1), ("b", 1, 1)}
    assert {p.name for p in (tmp_path / "report" / "questions").iterdir() if p.is_dir()} == {"sufficient=true", "sufficient=false"}


def test_report_leaves_no_tables_behind(spark, tmp_path):
    docs, asked, shared = str(tmp_path / "docs"), str(tmp_path / "asked"), Path(shared_folder(spark).removeprefix("file:")) / "docsift"
    add(spark, [(1, "the turbine runs at 300 rpm and weighs little", "a")], docs)
    spark.createDataFrame([(1, 0, "user", "turbine rpm", 1)], QUESTIONS).write.parquet(asked)
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    was = spark.conf.get(evidence_report.CLEANUP, None)
    evidence_report.run(spark, asked, str(tmp_path / "report"), docs)
    assert {p.name for p in shared.iterdir()} <= before and spark.conf.get(evidence_report.CLEANUP, None) == was
    assert evidence_report.read_report(spark, str(tmp_path / "report")).count() == 1


def test_report_from_an_intake(spark, tmp_path):
    asked, out, tables = f"{SF}/conversations.parquet", str(tmp_path / "a"), str(tmp_path / "tables")
    chunk_intake.run(spark, f"{SF}/documents.parquet", tables, str(tmp_path / "state"))
    evidence_report.run(spark, asked, out, index=tables)
    evidence_report.run(spark, asked, str(tmp_path / "b"), f"{SF}/documents.parquet")
    a, b = (sorted(map(str, evidence_report.read_report(spark, x).collect())) for x in (out, str(tmp_path / "b")))
    assert a == b and a


def test_settings(tmp_path):
    for kind, name in ((chunk_intake.Settings, "chunk_intake"), (evidence_report.Settings, "evidence_report")):
        assert load(kind, None) == load(kind, str(Path(chunk_intake.__file__).parent / f"{name}.json"))
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"unknown": 1}))
    with pytest.raises(TypeError):
        load(chunk_intake.Settings, str(bad))
    with pytest.raises(SystemExit):
        evidence_report.main(["--questions", "q", "--out", "o"])
