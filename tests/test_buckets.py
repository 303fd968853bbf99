import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import merge
from docsift.operators.merge import read_buckets, upsert_buckets

SCHEMA = "chunk_id string, body string, ordinal long"


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA).repartition(2)


def state(spark, path):
    return {r.chunk_id: (r.body, r.ordinal) for r in read_buckets(spark, path, SCHEMA).collect()}


def files(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path, r, want = tmp_path / "t", random.Random(2), {}
    for step in range(4):
        keys = r.sample(range(200), 120 if step == 0 else 3)
        found = [(f"k{k}", f"{step}-{k}", step * 1000 + i) for i, k in enumerate(keys)]
        before = files(path) if path.exists() else {}
        touched = upsert_buckets(str(path), rows(spark, found), buckets=16)
        for key, body, ordinal in found:
            want[key] = (body, want.get(key, (None, ordinal))[1])
        assert state(spark, str(path)) == want
        kept = {f: t for f, t in before.items() if not any(f"bucket={b}/" in str(f) for b in touched)}
        assert kept.items() <= files(path).items() and (step == 0 or 0 < len(touched) <= 3)
    assert upsert_buckets(str(path), rows(spark, []), buckets=16) == [] and state(spark, str(path)) == want


def test_repeated_keys_and_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_buckets(path, rows(spark, [("a", "first", 1), ("a", "last", 9), ("b", None, 2)]), buckets=4)
    assert state(spark, path) == {"a": ("last", 1), "b": (None, 2)}


def test_a_run_that_was_stopped_while_copying_is_made_good(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    upsert_buckets(str(path), rows(spark, [(f"k{k}", "old", k) for k in range(50)]), buckets=4)
    monkeypatch.setattr(merge, "delete", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        upsert_buckets(str(path), rows(spark, [("k1", "new", 100), ("k2", "new", 101)]), buckets=4)
    monkeypatch.undo()
    for f in list((path / "table").rglob("*.parquet")):  # as if the copy had only begun: the old buckets are gone, the new ones not there
        if any(f"bucket={b}" in str(f) for b in {x.parent.name.split("=")[1] for x in (path / "staged").rglob("*.parquet")}):
            f.unlink()
    upsert_buckets(str(path), rows(spark, [("k3", "newer", 200)]), buckets=4)
    want = {f"k{k}": ("old", k) for k in range(50)} | {"k1": ("new", 1), "k2": ("new", 2), "k3": ("newer", 3)}
    assert state(spark, str(path)) == want and not (path / "staged").exists()
    assert read_buckets(spark, str(path), SCHEMA).agg(F.count("*")).first()[0] == 50
