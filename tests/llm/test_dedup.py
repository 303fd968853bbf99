import random

import numpy as np

from docsift.llm import jaccard_join as jj
from docsift.llm import substring_dedup as sd
from docsift.llm.arrays import text_slices, windows, word_hashes, words
from docsift.llm.components import components
from docsift.llm.exact_dedup import exact_dedup
from docsift.llm.jaccard_join import jaccard_join
from docsift.llm.shared import Tables
from docsift.llm.substring_dedup import removals, substring_dedup

from .helpers import awkward, documents, linked, prose, removed, sha


def test_exact_dedup_matches_brute_force_with_small_blocks(spark):
    texts = awkward() + [(20, "ab" * 50), (21, "ab" * 50), (22, "ab" * 49 + "ac"), (23, "ab" * 25), (24, "ab" * 25)]
    for block in (7, 16384):
        got = {r.doc_id: r for r in exact_dedup(documents(spark, texts), block_bytes=block).collect()}
        classes: dict = {}
        for i, t in texts:
            classes.setdefault(t or "", []).append(i)
        assert len(got) == len(texts)
        for i, t in texts:
            ids = classes[t or ""]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), sha(t or ""))


def test_exact_dedup_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "b")]
    got = sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(documents(spark, rows)).collect())
    assert got == sorted([("None", sha("a"), "1", 3, False), ("None", sha("b"), "None", 2, True), ("None", sha("b"), "None", 2, True), ("1", sha("a"), "1", 3, True), ("1", sha("a"), "1", 3, True), ("2", sha("c"), "2", 1, True)])


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a")]).limit(0)
    assert exact_dedup(docs).count() == substring_dedup(docs).count() == jaccard_join(docs).count() == 0


def test_word_arrays_agree_with_split():
    import pyarrow as pa

    texts = [t for _, t in awkward()]
    for size in (1, 100, 1 << 20):
        found = []
        for lo, hi, data, offsets in text_slices(pa.array(texts), size):
            starts, ends, doc = words(data, offsets)
            raw = data.tobytes()
            parts = [[] for _ in range(hi - lo)]
            for a, b, d in zip(starts, ends, doc, strict=True):
                parts[d].append(raw[a:b])
            found += parts
        assert found == [(t or "").encode().split() for t in texts]


def test_equal_windows_have_equal_hashes_wherever_they_lie():
    import pyarrow as pa

    hashes = []
    for text in ("a b c d e", "x y z a b c d e"):
        (_, _, data, offsets), = text_slices(pa.array([text]))
        starts, ends, _ = words(data, offsets)
        hashes.append(windows(word_hashes(data, starts, ends), 3))
    assert (hashes[0] == hashes[1][3:]).all() and len(np.unique(hashes[1])) == 6


def test_substring_dedup_matches_brute_force(spark):
    texts = dict(awkward())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(documents(spark, texts.items())).collect()}
    assert got == removed(texts, 50)
    assert sum(x[1] > 0 for x in got.values()) >= 5


def test_substring_dedup_on_many_random_overlaps(spark):
    r = random.Random(5)
    pool = [prose(100 + k, 12) for k in range(8)]
    texts = {i: " ".join(r.choice(pool) for _ in range(r.randint(0, 6))) for i in range(60)}
    for length, gram in ((15, 3), (10, 8)):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(documents(spark, texts.items()), length=length).collect()} if gram == 8 and length > gram else None
        every, lost = removals(documents(spark, texts.items()), length=length, gram=gram)
        counts = {x.id: x.n_removed for x in lost.select("id", "n_removed").collect()}
        want = removed(texts, length)
        assert {i: counts.get(i, 0) for i in texts} == {i: w[1] for i, w in want.items()}
        assert got is None or got == want


def test_spans_are_maximal_and_repeated_rows_stay_one_each(spark):
    base = prose(1, 120)
    rows = [(1, base), (2, "start " + base), (2, "start " + base), (None, base)]
    docs = documents(spark, rows)
    assert substring_dedup(docs).count() == 4
    _, lost = removals(docs)
    (row,) = [x for x in lost.collect()]
    assert row.id == 2 and [(s.start, s.end) for s in row.spans] == [(1, 121)] and row.kept_text.strip() == "start"


def test_jaccard_join_matches_all_pairs(spark):
    texts = dict(awkward())
    base = prose(9, 60).split()
    for k in range(30):  # a group whose members differ in one word each
        texts[100 + k] = " ".join([*base[: k + 10], f"w{k}", *base[k + 11 :]])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(documents(spark, texts.items())).collect()}
    assert got == linked(texts, 5, 0.8)


def test_jaccard_join_of_large_groups_by_blocks_and_deep_paths(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(jj, "BLOCK_SETS", 25)
    base = prose(4, 80).split()
    texts = {i: " ".join([*base[: i % 60], f"w{i}", *base[i % 60 + 1 :]]) for i in range(90)}
    texts |= {1000 + i: " ".join(base[:20]) + " " + prose(500 + i, 60) for i in range(30)}
    texts |= {2000 + i: f"all of these begin with seven words w{i % 35}" for i in range(40)}
    for kept in (0.7, 2.0):  # with and without leaves that are not worth splitting
        monkeypatch.setattr(jj, "KEPT", kept)
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(documents(spark, texts.items()), recall=1 - 1e-12, bucket=8).collect()}
        assert got == linked(texts, 5, 0.8)


def test_runs_follow_the_recall_asked_for():
    assert jj.runs_for(0.99999) == 5 and jj.runs_for(0.9) == 1 and jj.runs_for(0.9, branch=1) > 4
    assert jj.runs_for(0.99999, similarity=0.5) > jj.runs_for(0.99999, similarity=0.8)


def test_the_recall_of_links_at_the_threshold(spark):
    texts, r = {}, random.Random(8)
    for k in range(150):  # pairs of 54 and 48 shingles, 46 of them common: 0.82; and at 0.9
        words = prose(3000 + k, 58).split()
        texts[10 * k] = " ".join(words)
        texts[10 * k + 1] = " ".join(words[4:54] + [f"x{r.random()}", "y"])
        texts[10 * k + 2] = " ".join(words[:57] + [f"x{r.random()}"])
    want = linked(texts, 5, 0.8)
    total = sum(x[1] for x in want.values())
    for recall, least in ((0.9, 0.9), (0.99999, 1.0)):
        got = jaccard_join(documents(spark, texts.items()), recall=recall, bucket=2).agg({"n_links": "sum"}).first()[0]
        assert total * least <= got <= total


def test_an_id_with_several_texts(spark):
    a, b = prose(21, 70), prose(22, 70)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (2, b), (2, near), (2, near + " "), (3, "start " + b), (3, a), (4, b + " " + prose(23, 55)), (4, "few words")]
    got = sorted((r.doc_id, r.class_id, r.class_size, r.n_links, r.n_shingles) for r in jaccard_join(documents(spark, rows)).collect())
    assert got == sorted([(1, 1, 4, 1, 66), (2, 1, 4, 1, 66), (2, 1, 4, 1, 66), (3, 1, 4, 1, 66), (2, 2, 2, 1, 66), (3, 2, 2, 1, 67), (4, 4, 1, 0, 121), (4, 4, 1, 0, 1)])
    # each row is judged against smaller ids, by its own text
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(documents(spark, rows)).collect())
    assert got == sorted([(1, 70, 0), (2, 70, 0), (2, 70, 69), (2, 70, 69), (3, 71, 70), (3, 70, 70), (4, 125, 70), (4, 2, 0)])


def test_similar_pairs_agree_with_all_pairs():
    r = random.Random(3)
    pool = np.arange(1, 60, dtype=np.uint64)
    sets = [np.unique(np.array(r.sample(list(pool), 40), np.uint64)) for _ in range(12)]
    want = {(a, b) for a in range(12) for b in range(a + 1, 12) if len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b]))}
    side = np.arange(12) % 2 == 0
    for across in (False, True):
        got = [(int(a), int(b)) for i, j in jj._similar_pairs(sets, side, across, 0.5) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if not across or side[a] != side[b]}


def test_jaccard_join_of_null_ids_and_repeated_rows(spark):
    t = prose(1, 40)
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.n_links) for r in jaccard_join(documents(spark, [(None, t), (5, t), (5, t), (6, ""), (None, "")])).collect())
    assert got == sorted([("None", "5", 3, 0), ("5", "5", 3, 0), ("5", "5", 3, 0), ("6", "6", 1, 0), ("None", "None", 1, 0)])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(Tables(spark, "t"), df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}}


def test_the_window_length_may_equal_the_gram():
    h = np.arange(1, 20, dtype=np.uint64)
    least, at = sd._minimizers(h, np.zeros(19, int), 8, 8)
    assert (least == windows(h, 8)).all() and len(at) == 12
