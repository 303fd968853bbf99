import datetime as dt
import random
import textwrap
import time

import numpy as np
import pytest

from docsift.llm import graph_index as gi
from docsift.llm.graph_index import nearest
from docsift.llm.language_id import identify, keep_identified, prototypes
from docsift.llm.license_scan import SENTENCES, license_scan, sentences
from docsift.llm.queries import QUERIES, op9_language_id
from docsift.llm.url_filter import LIST_SCHEMA, url_filter

from .helpers import awkward, bundle, documents

SF = "/root/testdata/sf0.001"


def test_language_id_is_right_on_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, SF).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edge_cases(spark):
    docs = documents(spark, [*awkward(), (None, "hello there")])
    known = prototypes(docs)
    assert set(known) == {"en"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, known).collect()}
    assert got[4] == got[5] == got[6] == got[15] == ("und", 0.0)
    assert got[1][0] == got[None][0] == "en" and got[1][1] > 0.5
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    far = documents(spark, [(1, chr(0x323A0) * 3), (2, "\U0001D400")])  # letters beyond the first planes
    assert {r.lang_pred for r in identify(far, known).collect()} == {"en"}
    assert prototypes(docs.limit(0)) == {} and identify(docs.limit(0), known).count() == 0
    kept = keep_identified(docs, known, 0.0, 100)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[0] != "und"}


def test_language_id_matches_its_plain_version(spark):
    rows = [x for x in awkward() if not x[1] or len(x[1]) < 9000] + [(50 + k, t) for k, t in enumerate(["Éa és là", "ÉA ÉS LÀ!", "der Bär, die Bären"])]
    docs = spark.createDataFrame([(i, t, ("aa", "bb", None)[i % 3]) for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    protos = {name: sum(bundle(t) for i, t in rows if ("aa", "bb", None)[i % 3] == name and t) for name in ("aa", "bb")}
    for r in identify(docs, prototypes(docs)).collect():
        v = bundle(dict(rows)[r.doc_id])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in protos.items()}
        assert abs(max(0.0, *cosine.values()) - r.score) < 1e-4 and cosine[r.lang_pred] > max(cosine.values()) - 1e-4


def test_prototypes_do_not_depend_on_partitions(spark):
    docs = documents(spark, awkward())
    a, b = prototypes(docs.repartition(1))["en"], prototypes(docs.repartition(7))["en"]
    assert np.allclose(a, b, rtol=1e-3, atol=1e-2)


def evaluate(host, path, day, entries):
    """A plain version of the list join."""
    best = None
    for rule in {e[0] for e in entries}:
        name, _, rest = rule.partition("/")
        if not (host == name or host.endswith("." + name)) or (rest and not (path + "/").startswith("/" + rest + "/")):
            continue
        past = [e for e in entries if e[0] == rule and e[3] <= day]
        if past and (last := max(past, key=lambda e: (e[3], e[2], e[1]))) and (best is None or len(rule) > len(best[0])):
            best = last
    return best


def test_url_filter_matches_the_plain_version(spark):
    entries = [
        ("bad.example", "x", "block", "2024-01-05"), ("bad.example", "x", "remove", "2024-01-10"), ("bad.example", "x", "block", "2024-01-15"),
        ("ok.bad.example", "x", "allow", "2024-01-01"), ("site.example/a", "y", "block", "2024-01-03"), ("site.example/a/b", "y", "allow", "2024-01-08"), ("1.2.3.4", "z", "block", "2024-01-01"),
        ("twice.example", "p", "block", "2024-01-02"), ("twice.example", "q", "remove", "2024-01-02"),
    ]
    urls = [("http://bad.example/x", "bad.example", "/x"), ("https://u@Sub.BAD.example.:80/?q", "sub.bad.example", "/"), ("http://ok.bad.example", "ok.bad.example", ""), ("http://notbad.example", "notbad.example", ""),
            ("http://site.example/a/c", "site.example", "/a/c"), ("http://site.example/a/b#x", "site.example", "/a/b"), ("http://site.example/ab", "site.example", "/ab"), ("http://1.2.3.4/", "1.2.3.4", "/"), ("http://9.1.2.3.4/", "9.1.2.3.4", "/"), ("http://twice.example/", "twice.example", "/")]
    rows, want = [], []
    for k, (url, host, path) in enumerate(urls):
        for d in range(1, 20, 3):
            day = dt.date(2024, 1, d)
            rows.append((100 * k + d, url, day, "clash", "clash"))
            e = evaluate(host, path, str(day), entries) if not (host.startswith("9.") and host[2:] == "1.2.3.4") else None
            e = e if e and e[2] in ("block", "allow") else None
            want.append((100 * k + d, host, bool(e and e[2] == "block"), e and e[0], e and e[3]))
    rows += [(None, None, dt.date(2024, 1, 9), "", ""), (7, "/relative", None, "", ""), (7, "/relative", None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, rule string, host string")
    listed = spark.createDataFrame(entries + [(None, "n", "block", "2024-01-01"), ("n.example", "n", "block", None)], LIST_SCHEMA)
    got = url_filter(df, listed).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id, r.host, r.blocked, r.rule or "", str(r.listed_on or "")) for r in got if r.page_id is not None and r.page_id != 7) == sorted((a, b, c, d or "", e or "") for a, b, c, d, e in want if a != 7)
    assert [(r.host, r.blocked) for r in got if r.page_id is None] == [("", False)] and sum(r.page_id == 7 and not r.host for r in got) == 2
    assert url_filter(df.limit(0), listed).count() == 0 and not any(r.blocked for r in url_filter(df, listed.limit(0)).collect())


def test_url_filter_an_ended_longer_rule_hides_no_shorter_one(spark):
    entries = [("farm.example", "x", "block", "2024-01-05"), ("www.farm.example", "x", "allow", "2024-01-10"), ("www.farm.example", "x", "remove", "2024-01-15"), ("farm.example/a", "y", "allow", "2024-01-06"), ("farm.example/a", "y", "remove", "2024-01-08")]
    rows = [(1, "http://www.farm.example/", "2024-01-07"), (2, "http://www.farm.example/", "2024-01-12"), (3, "http://www.farm.example/", "2024-01-20"), (4, "http://farm.example/a", "2024-01-07"), (5, "http://farm.example/a", "2024-01-09")]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, fetched_on string"), spark.createDataFrame(entries, LIST_SCHEMA)).collect()
    assert sorted((r.page_id, r.blocked, r.rule) for r in got) == [(1, True, "farm.example"), (2, False, "www.farm.example"), (3, True, "farm.example"), (4, False, "farm.example/a"), (5, True, "farm.example")]


def test_url_filter_without_broadcasts_of_rules_and_with_a_hot_label(spark):
    rules = [(f"h{k}.example.com/a/b" if k % 2 else f"h{k}.example.com", "x", action, f"2024-01-{d:02}") for k in range(200) for d, action in ((2, "block"), (9, "remove"), (20, "allow"))]
    rows = [(k, f"https://www.h{k % 300}.example.com/a/b/" + "x" * (100_000 if k == 5 else 3), dt.date(2024, 1, 1 + k % 28)) for k in range(600)] + [(None, None, dt.date(2024, 1, 2)), (1000, "", dt.date(2024, 1, 2))]
    df, listed = spark.createDataFrame(rows, "page_id long, url string, fetched_on date"), spark.createDataFrame(rules, LIST_SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.page_id: (r.blocked, r.rule) for r in url_filter(df, listed).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(rows) and sum(b for b, _ in got.values()) > 50
    for i, url, day in rows[:600]:
        host = url.split("/")[2]
        e = evaluate(host, "/a/b/xxx", str(day), rules)
        assert got[i] == ((e[2] == "block", e[0]) if e and e[2] != "remove" else (False, None))
    assert got[None] == got[1000] == (False, None)


def test_license_rules(spark):
    mit = SENTENCES[11] + "\n\n" + SENTENCES[12] + "."
    wrapped = mit.replace(" copies ", "\ncopies ").replace(" without ", "\n  without ")
    rows = [(1, "Intro. Licensed under the Apache License, Version 2.0.\nMore."), (2, mit), (3, wrapped), (4, SENTENCES[12] + "."), (5, None), (6, ""), (7, "released UNDER the   MIT license! Licensed under CC BY-NC 4.0."), (8, SENTENCES[9] + ";\n" + SENTENCES[10] + "."), (8, "x"), (None, "Licensed under the MIT License")]
    got = sorted((str(r.doc_id), r.licenses, r.n_licenses) for r in license_scan(documents(spark, rows)).collect())
    assert got == sorted([("1", "Apache-2.0", 1), ("2", "MIT", 1), ("3", "MIT", 1), ("4", "", 0), ("5", "", 0), ("6", "", 0), ("7", "CC-BY-NC-4.0,MIT", 2), ("8", "Apache-2.0", 1), ("8", "", 0), ("None", "MIT", 1)])
    assert len({sentences(t)[0] for t in SENTENCES.values()}) == len(SENTENCES)
    assert license_scan(documents(spark, rows).limit(0)).count() == 0
    assert len(sentences("." * 300_000 + "x" + "!?" * 100_000 + " y")) == 3  # in linear time


def test_licenses_of_commented_headers(spark):
    mit = "Copyright (c) 2020 Someone\n" + SENTENCES[11] + "\n\n" + SENTENCES[12] + "."
    two = f"{SENTENCES[13]}\n\n1. {SENTENCES[14]}.\n2. {SENTENCES[15]}.\n"
    three = two + "3. Neither the name of Some Company, Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    cases = [("// SPDX-License-Identifier: MIT\nint main()", "MIT"), ("/* SPDX-License-Identifier: MPL-2.0 */\nint main()", "MPL-2.0"), ("-- SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("# SPDX-License-Identifier: ISC\nimport os", "ISC"),
             ("; SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("/* Licensed under the Apache\n   License, Version 2.0 */\nint main()", "Apache-2.0"), ("# a heading\n- a line\n\ntext", "")]
    for text, name in [(mit, "MIT"), (two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (SENTENCES[16] + ".", "GPL-3.0-or-later"), (lesser, "LGPL-2.1-or-later")]:
        for mark in ("", "# ", "// ", " * ", "-- ", "; "):
            cases.append(("\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, 61) or [""])), name))
    got = {r.doc_id: r.licenses for r in license_scan(documents(spark, [(i, text) for i, (text, _) in enumerate(cases)])).collect()}
    assert [(cases[i][0], got[i]) for i in sorted(got)] == cases


def test_url_filter_of_deep_urls(spark):
    deep = "/".join(f"s{k}" for k in range(100_000))
    host = "a." * 10_000 + "deep.example.com"
    rows = [(1, f"http://x.example.com/{deep}", "2024-01-05"), (2, f"http://{host}/p", "2024-01-05"), (3, "http://x.example.com" + "/" * 50_000 + "s0/s1", "2024-01-05"), (4, "http://10.0.0.1/s0", "2024-01-05")]
    entries = [("x.example.com/s0/s1", "c", "block", "2024-01-01"), ("deep.example.com", "c", "block", "2024-01-01"), ("/".join(["x.example.com", *deep.split("/")[:300]]), "d", "allow", "2024-01-03"), ("0.1", "c", "block", "2024-01-01")]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on string")
    began = time.time()
    got = {r.page_id: (r.blocked, r.category) for r in url_filter(df, spark.createDataFrame(entries, LIST_SCHEMA)).collect()}
    assert got == {1: (False, "d"), 2: (True, "c"), 3: (True, "c"), 4: (False, None)} and time.time() - began < 20


def test_licenses_of_names_with_full_stops_expressions_and_titles(spark):
    two = f"{SENTENCES[13]}\n\n1. {SENTENCES[14]}.\n2. {SENTENCES[15]}.\n"
    clause = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    cases = [(two + clause.format(who), "BSD-3-Clause") for who in ("Google Inc.", "Google LLC", "the copyright holder", "Foo Co., Ltd.", "a holder whose name is long " * 40)]
    cases += [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0,MIT"), ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\n", "GPL-2.0-only"),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0-only"), ("SPDX-License-Identifier: Nobody-1.0 OR ISC", "ISC"), ("SPDX-License-Identifier: Nobody-1.0", ""),
        ("MIT License\n\nCopyright (c) 2020 x", "MIT"), ("The MIT License (MIT)\n\nCopyright", "MIT"), ("BSD 3-Clause License\n\nCopyright", "BSD-3-Clause"), ("ISC License\n", "ISC"),
        ("   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright", "GPL-3.0-only"), ("  GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright", "GPL-2.0-only"), (" GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999\n\n", "LGPL-2.1-only"),
        ("   Apache License\n      Version 2.0, January 2004\n     http://www.apache.org/licenses/\n\n TERMS", "Apache-2.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"), ("Mozilla Public License Version 2.0\n====\n", "MPL-2.0"),
        # several rules on one text, and one text many times
        (f"{SENTENCES[2]}. {SENTENCES[4]}. {SENTENCES[2]}.", "CC-BY-NC-4.0,MIT"), ("the apache license is long", ""),
    ]
    got = {r.doc_id: r.licenses for r in license_scan(documents(spark, [(i, text) for i, (text, _) in enumerate(cases)])).collect()}
    assert [(cases[i][0], got[i]) for i in sorted(got)] == cases
    began = time.time()
    license_scan(documents(spark, [(1, "neither the name of x. nor the names of " * 5000), (2, "Neither the name " * 20000)])).collect()
    assert time.time() - began < 30


def brute(vectors, q, k):
    own = vectors[q]
    scored = sorted((-float(np.dot(v, own)), i) for i, v in vectors.items() if i != q)
    return [i for _, i in scored[:k]]


def test_nearest_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(gi, "SHARD_VECTORS", 400)
    r = np.random.default_rng(1)
    vectors = {i: (r.normal(size=16) * r.uniform(0.5, 2)).astype(np.float32).astype(float) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in vectors.items()], "vec_id long, embedding array<float>, node int, shard int").repartition(3)
    got = nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    found = {}
    for x in got:
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    recall = []
    for q, hits in found.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11))
        assert all(abs(s - np.dot(vectors[q], vectors[v])) < 1e-9 for _, v, s in hits)
        assert [h[2] for h in hits] == sorted((h[2] for h in hits), reverse=True)
        recall.append(len({h[1] for h in hits} & set(brute(vectors, q, 10))) / 10)
    assert len(recall) == 75 and np.mean(recall) > 0.95


def test_nearest_beside_vectors_of_other_lengths(spark):
    r = np.random.default_rng(2)
    vectors = {i: v / np.linalg.norm(v) for i, v in enumerate(r.normal(size=(1500, 16)))}
    vectors[7] = vectors[7] * 1e5
    vectors |= {2000 + i: v * 1e-3 for i, v in enumerate(r.normal(size=(30, 16)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for x in nearest(df, df.where("vec_id % 20 = 0"), k=10).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    assert len(found) == 77 and np.mean([len(hits & set(brute(vectors, q, 10))) / 10 for q, hits in found.items()]) > 0.95


def test_nearest_beside_one_long_vector_at_the_registered_settings(spark):
    r = np.random.default_rng(3)
    base = {i: v for i, v in enumerate(r.normal(size=(2000, 16)))}
    for length in (1e4, 1e8, 1e200):
        vectors = dict(base)
        vectors[7] = base[7] / np.linalg.norm(base[7]) * length
        vectors[20] = base[20] / np.linalg.norm(base[20]) * length  # one of the queries
        df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
        found = {}
        for x in nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
            assert not np.isnan(x.score)
            found.setdefault(x.query_id, set()).add(x.vec_id)
        assert len(found) == 100 and np.mean([len(hits & set(brute(vectors, q, 20))) / 20 for q, hits in found.items()]) >= 0.95


def test_nearest_of_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.5]), (2, [0.0, 3.0]), (2, [5.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), k=5).collect()
    assert sorted((x.rank, x.vec_id, x.score) for x in got) == [(1, 2, 5.0), (2, 1, 2.0)]


def test_nearest_of_ties_and_unusable_vectors(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(40)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [float("inf"), 1.0]), (200, []), (220, [1.0, 2.0, 3.0]), (None, same), (300, [0.0, 1.0]), (0, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    by = {}
    for x in got:
        by.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(by) == {0, 20, 300}
    assert sorted(by[0]) == [(k, k, 1.0) for k in range(1, 6)]
    assert sorted(by[20]) == [(k + 1, k, 1.0) for k in range(5)]
    assert sorted(by[300]) == [(k + 1, k, 0.0) for k in range(5)]
    assert nearest(df.limit(0), df, k=5).count() == 0 and nearest(df, df.limit(0), k=5).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in nearest(few, few, k=5).orderBy("query_id").collect()] == [(0, 1, 2.0), (1, 0, 2.0)]


def hard(kind, n, r):
    x = r.normal(size=(n, 64))
    if kind == "normal":
        return x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":
        return x * np.exp(r.normal(size=(n, 1)))
    middle = r.normal(size=(2 if kind == "two" else 50, 64))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    x = middle[r.integers(0, len(middle), n)] + (1e-5 if kind == "two" else 1e-2) * x
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", ["normal", "lengths", "two", "fifty"])
def test_nearest_of_hard_vectors_at_the_registered_settings(spark, kind):
    """Standard normal ones, lengths over three powers of ten, and tight clusters, against brute force."""
    x = hard(kind, 2000, np.random.default_rng(5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for row in nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert len(found) == 100 and np.mean([len(found[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) > 0.98


def test_nearest_breaks_ties_of_other_vectors_by_id(spark):
    rows = [(j, [5.0, float(j % 61)]) for j in range(1, 121)] + [(1000, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 1000"), k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(j, 5.0) for j in range(1, 21)]


def test_every_node_is_reached_from_an_entry():
    graph = np.array([[1, -1], [0, -1], [3, -1], [2, 0], [-1, -1]])
    assert gi.entry_nodes(graph, np.array([0])).tolist() == [0, 2, 4]
    assert gi.far_apart(np.array([[0.0], [1], [9], [5]]), 3).tolist() == [0, 2, 3] and gi.far_apart(np.zeros((4, 2)), 3).tolist() == [0]


def test_pruning_keeps_near_and_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]], np.float32)
    kept = gi.robust_prune(x, (x * x).sum(1), np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)
    assert kept[0].tolist()[:3] == [1, 3, 4] and 2 not in kept


def test_a_wider_beam_measures_no_node_again(monkeypatch):
    x = np.random.default_rng(6).normal(size=(1500, 32))
    graph, entry = gi.build_graph(gi.directions(x))
    measured, products = [], gi.Walk._products
    monkeypatch.setattr(gi.Walk, "_products", lambda self, row, node: (measured.extend(zip(row.tolist(), node.tolist(), strict=True)), products(self, row, node))[1])
    walk = gi.Walk(x, np.zeros(len(x)), graph, entry, x[:40])
    for beam in (30, 60, 1500):
        ids, far = walk.on(np.arange(40), beam)
        assert (np.diff(far[:, :30], axis=1) >= 0).all()
    assert len(measured) == len(set(measured)) and not any(node in set(entry.tolist()) for _, node in measured)
    assert (ids[:, :10] == np.argsort(-(x[:40] @ x.T), axis=1)[:, :10]).mean() > 0.99  # all that is reached is in the widest beam


def test_the_shards_that_a_query_visits_do_not_grow_with_the_table():
    assert [gi.shards_of(n, 8192) for n in (1, 8192, 8193, 32 * 8192, 600_000, 2_000_000)] == [1, 1, 2, 32, 32, 32]
    assert gi.shards_of(64 * 65536, 8192) == 64 and gi.shards_of(1500, 400) == 4


def test_each_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 13))
    random.seed(0)
