import importlib
import random

import numpy as np
from pyspark.sql import functions as F

from .helpers import awkward, bundle, documents, linked, prose, removed, trigrams
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def stages():
    return importlib.import_module("corpus_pipeline")


def apply(spark, docs, sf_dir, upto):
    for _, stage in stages().STAGES[:upto]:
        docs = stage(spark, docs, sf_dir)
    return docs


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_does_what_its_brute_force_version_does(spark):
    near = prose(1, 120).split()
    docs = documents(spark, [*awkward(), (30, " ".join([*near[:100], "other", *near[101:]]))]).cache()
    names = [n for n, _ in stages().STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "substring_dedup", "packing"]

    one = apply(spark, docs, SF, 1)
    assert one.columns == docs.columns
    texts = rows_of(one)
    given, proto = rows_of(docs), sum(bundle(r.text) for r in docs.where("lang is not null").collect())
    fits = set()
    for i, t in given.items():
        if (v := bundle(t)).any():
            least = stages().MIN_LANGUAGE_SCORE * min(1, len(trigrams(t)) / stages().FULL_GRAMS)
            fits |= {i} if v @ proto / np.linalg.norm(v) / np.linalg.norm(proto) >= least else set()
    assert set(texts) == fits and {1, 2, 3, 9, 10, 11, 12, 13, 17, 30} <= fits and {4, 5, 6, 15, 16}.isdisjoint(fits)

    two = stages().drop_exact_copies(spark, one, SF)
    last = {}
    for i, t in texts.items():
        last[t] = max(i, last.get(t, -1))
    assert rows_of(two) == {i: t for t, i in last.items()} and two.columns == docs.columns

    three = stages().drop_near_copies(spark, two, SF)
    held = rows_of(two)
    groups = linked(held, 5, 0.8)
    assert rows_of(three) == {i: t for i, t in held.items() if groups[i][0] == i} and three.columns == docs.columns

    four = stages().drop_repeated_passages(spark, three, SF)
    held = rows_of(three)
    want = removed(held, 50)
    got = rows_of(four)
    assert set(got) == {i for i, w in want.items() if w[1] < w[0]}
    for i, t in got.items():
        assert t == held[i] if not want[i][1] else len(t.encode().split()) == want[i][0] - want[i][1]
    assert four.columns == docs.columns

    check_pieces(stages().packing(spark, four.coalesce(1), SF).collect(), list(got.items()), 1024, 0.1)


def test_texts_with_letters_stay_where_no_language_is_known(spark):
    docs = documents(spark, [*awkward(), (None, "hello there")])
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = stages().language_id(spark, unlabelled, SF)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [None, *range(1, 18)] if i not in (4, 5, 6, 15, 16))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    t = prose(3, 60)
    docs = documents(spark, [(1, t), (1, t), (None, t), (None, "some other words here"), (None, "some other words here")])
    kept = sorted((str(r.doc_id), r.text[:4]) for r in stages().drop_exact_copies(spark, docs, SF).collect())
    assert kept == sorted([("1", t[:4]), ("None", "some")])
    assert stages().drop_near_copies(spark, docs, SF).where("doc_id is null").count() == 3
    lowest = documents(spark, [(-(2**63), t), (None, t)])
    assert stages().drop_exact_copies(spark, lowest, SF).count() == 1
    for _, stage in stages().STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_an_id_with_several_texts(spark):
    a, b = prose(41, 90), prose(42, 80)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (2, b), (2, near), (3, b + " "), (3, prose(43, 10)), (4, prose(44, 30) + " " + " ".join(b.split()[:70])), (4, "short one")]
    docs = documents(spark, [*rows, (4, "short one")])
    exact = sorted((r.doc_id, r.text) for r in stages().drop_exact_copies(spark, docs, SF).collect())
    assert exact == sorted(rows)
    left = sorted((r.doc_id, r.text) for r in stages().drop_near_copies(spark, documents(spark, rows), SF).collect())
    assert left == sorted(x for x in rows if x not in [(2, near), (3, b + " ")])
    left = sorted((r.doc_id, r.text) for r in stages().drop_repeated_passages(spark, documents(spark, left), SF).collect())
    assert left == sorted([(1, a), (2, b), (3, prose(43, 10)), (4, prose(44, 30) + " " + " "[:0]), (4, "short one")])


def test_text_that_fits_no_language_goes(spark):
    import base64

    r = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [base64.b64encode(r.randbytes(n)).decode() for n in (200, 900)] + [r.randbytes(n).hex() for n in (300, 2000)] + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (300, 900)]
    rows = spark.createDataFrame([(-1 - k, x, None, "junk", len(x or "")) for k, x in enumerate([*junk, None, "", "123 !"])], docs.schema)
    kept = {x.doc_id for x in stages().language_id(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    own = {x.doc_id for x in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert min(kept) >= 0 and len(kept) >= 0.99 * len(own)


def test_the_whole_pipeline_on_the_small_tables(spark):
    out = stages().run(spark, SF)
    assert out.count() > 100 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
