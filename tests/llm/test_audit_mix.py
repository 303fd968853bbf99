import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import divergence as dv
from docsift.llm import mixing as mx
from docsift.llm.divergence import divergence_audit
from docsift.llm.mixing import mix
from docsift.llm.shared import Tables

from .helpers import awkward, prose

SCHEMA = "doc_id long, text string, lang string, source string, term string, c long, no int, row long, size int, shard string"


def rows_of(spark, rows):
    """(doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4, "s") for r in rows], SCHEMA).repartition(3)


def plain_audit(rows, top, min_docs):
    """By evaluating every term of every pair."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        groups[lang or ""].add(source or "")
        docs[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // n for t in kept}

        own = {s: p(count[lang, s]) for s in sources}
        all_ = p(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-f(own[s][t], all_[t]), t.encode()) for t in kept if count[lang, s][t] and own[s][t] > all_[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)[:most])}
    return out


def audited(docs, **kw):
    got = [tuple(r) for r in divergence_audit(docs, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé漢") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary[: r.choice([5, 20, 60])]) for _ in range(r.randint(0, 40))]
        rows.append((i, r.choice([" ", "-", "\n", "1"]).join(words), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", None])))
    return rows


@pytest.mark.parametrize(("seed", "top", "min_docs"), [(1, 3, 3), (2, 200, 3), (3, 1, 1), (4, 10, 2)])
def test_audit_matches_evaluating_everything(spark, seed, top, min_docs):
    rows = corpus(seed, 80)
    assert audited(rows_of(spark, rows), top=top, min_docs=min_docs) == plain_audit(rows, top, min_docs)


def test_audit_of_awkward_texts(spark):
    rows = [(i, t, ("x", None, "")[k % 3], ("s", None, "t", "u")[k % 4]) for k, (i, t) in enumerate(awkward())]
    rows += rows[:4]  # repeated rows are documents of their own
    rows += [(90, "Ünïcode ÀB ab AB", "only", "one"), (91, "rare words", "bare", "p"), (92, "other things", "bare", "q"), (93, None, "bare", None)]
    got = audited(rows_of(spark, rows))
    assert got == plain_audit(rows, 200, 3)
    assert {r for r in got if r[0] == "bare"} == {("bare", *r) for r in [("", "pair", "p", 0, 1), ("", "pair", "q", 0, 2), ("p", "pair", "", 0, 1), ("p", "pair", "q", 0, 2), ("q", "pair", "", 0, 1), ("q", "pair", "p", 0, 2)]}
    assert divergence_audit(rows_of(spark, rows).limit(0)).count() == 0


def test_audit_does_not_depend_on_batches(spark, monkeypatch):
    rows = corpus(5, 60)
    want = audited(rows_of(spark, rows))
    monkeypatch.setattr(dv, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(dv, "PAIRS_HELD", 5)
    assert audited(rows_of(spark, rows).repartition(9)) == want


def test_audit_evaluates_few_buckets(spark):
    """Only buckets whose bounds reach the k-th value are evaluated, and terms that tie with it are among them."""
    rows = [(1, "l", "s", f"t{k:04d}", 1 + 1000 // (1 + k % 500), 5000, 1, 10 * (1 + 1000 // (1 + k % 500)), 9 if k % 2 else 8) for k in range(1000)]
    scored = spark.createDataFrame(rows, "no long, lang string, source string, term string, c long, lang_c long, p0 long, p long, q long")
    kept = []

    class Spy(Tables):
        def write(self, df, wide=False):
            kept.append(super().write(df, wide))
            return kept[-1]

    got = [(r.item, r.value, r.rank) for r in dv._top_terms(Spy(spark, "spy"), scored, 4).orderBy("rank").collect()]
    plain = sorted((-((p - q) ** 2 // q), t) for _, _, _, t, _, _, _, p, q in rows if p > q)[:4]
    assert got == [(t, -v, k + 1) for k, (v, t) in enumerate(plain)]
    bounds, wanted = kept
    assert wanted.join(bounds, ["no", "bucket"]).agg(F.sum("n")).first()[0] < 20


# --- mixing -------------------------------------------------------------------------------


def plain_targets(sizes, cycle, most):
    """By sharing, capping and sharing the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[o] for o in names if o not in full)) for s in names if s not in full}
        above = {s for s, x in share.items() if x > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= above


def size_of(text):
    return len((text or "").encode().split())


def mixed_rows(seed, n, skew=True):
    r = random.Random(seed)
    names = ["b", "a", "Z", "é", None, ""]
    return [(i, prose(seed * 1000 + i, r.choice([0, 1, 5, 30, 200])) if i % 11 else None, "en", "a" if skew and i % 3 == 0 else r.choice(names)) for i in range(n)]


@pytest.mark.parametrize(("seed", "cycle", "most", "block", "shard"), [(1, (1, 2, 3), 3, 64, 4), (2, (5, 1), 2, 10, 7), (3, (1,), 1, 4096, 1024), (4, (1, 1, 1, 1, 1, 100), 3, 50, 3)])
def test_mix_meets_targets_and_limits(spark, seed, cycle, most, block, shard):
    rows = mixed_rows(seed, 90)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size_of(text)
    want = plain_targets(sizes, cycle, most)
    m = mix(rows_of(spark, rows), cycle, most, block_words=block, shard_blocks=shard)
    got = m.taken().collect()
    assert sorted(r.doc_id for r in got) == list(range(90))
    taken = Counter()
    for r in got:
        assert r.size == size_of(rows[r.doc_id][1]) and r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-9 * max(1, r.target)
        assert 0 <= r.taken <= most * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s]) for s in sizes)

    pieces = m.pieces.join(m.documents.select("row", "source", "size"), "row").collect()
    whole = {s: (Counter(), defaultdict(set)) for s in sizes}
    for p in pieces:
        assert 0 < p.length <= block and 0 <= p.start and p.start + p.length <= p["size"] and p.at + p.length <= block
        for word in range(p.start, p.start + p.length):
            assert (p.row, p["pass"], word) not in whole[p.source][1][p.row]
            whole[p.source][1][p.row].add((p.row, p["pass"], word))  # no word of a pass is drawn twice
    shards = defaultdict(set)
    for p in pieces:
        shards[p.shard].add(p.slot)
    blocks = sum(-(-int(want[s]) // block) for s in sizes)
    held = sorted(len(x) for x in shards.values())
    assert sum(held) == blocks and len(held) == -(-blocks // shard) and held[-1] - held[0] <= 1 and held[-1] <= shard
    assert all(x == set(range(len(x))) for x in shards.values())


def test_mix_is_the_same_again_and_another_with_another_seed(spark):
    rows = mixed_rows(7, 60)
    ordered = lambda m: sorted((r.shard, r.slot, r.at, r.doc_id, r.start, r.length) for r in m.pieces.collect())
    a = ordered(mix(rows_of(spark, rows), block_words=40, shard_blocks=5))
    b = ordered(mix(rows_of(spark, rows[::-1]).repartition(7), block_words=40, shard_blocks=5))
    assert a == b and a != ordered(mix(rows_of(spark, rows), seed=13, block_words=40, shard_blocks=5))


def test_mix_of_many_small_buckets(spark, monkeypatch):
    rows = mixed_rows(8, 120)
    monkeypatch.setattr(mx, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mx, "FAN_BITS", 1)
    monkeypatch.setattr(mx, "LEVELS_AT_ONCE", 1)
    monkeypatch.setattr(mx, "CHUNK", 2)
    m = mix(rows_of(spark, rows), block_words=30, shard_blocks=4)
    by = {r.source: (r.quota, r.taken) for r in m.taken().groupBy("source").agg(F.sum("taken").alias("taken")).alias("t").join(m.sources.select(F.col("source").alias("s"), "quota"), F.expr("t.source <=> s")).collect()}
    assert all(a == b for a, b in by.values()) and len(by) == 6


def test_mix_of_awkward_texts(spark):
    rows = [(i, t, "en", ("s", None)[k % 2]) for k, (i, t) in enumerate(awkward())] + [(1, awkward()[0][1], "en", "s"), (None, "four words of nobody", "en", "empty"), (70, None, "en", "void"), (71, " \n", "en", "void")]
    m = mix(rows_of(spark, rows), block_words=1000, shard_blocks=2)
    got = m.taken().collect()
    assert len(got) == len(rows)
    assert [(r.size, r.source_size, r.target, r.taken) for r in got if r.source == "void"] == [(0, 0, 0.0, 0)] * 2
    assert all(r.taken <= 3 * r.size for r in got)
    docs = rows_of(spark, rows)
    texts = m.texts(docs).collect()
    assert sum(size_of(r.text) for r in texts) == sum(r.taken for r in got)
    assert mix(docs.limit(0)).taken().count() == 0 and mix(docs.where("source = 'void'")).taken().count() == 2
    with pytest.raises(ValueError, match="1 or more"):
        mix(docs, cycle=(0, 1))


def test_mix_runs_no_python_and_no_large_window(spark):
    """Every window but those over the table of sources is by a bucket, a group of buckets or a shard."""
    m = mix(rows_of(spark, mixed_rows(9, 40)), block_words=40, shard_blocks=5)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (m.taken(), m.pieces, m.sources)]
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)
    windows = [line for line in "\n".join(plans).split("\n") if re.search(r"Window \[", line)]
    assert windows and all(re.search(r"\[no#\d+L?, pass#\d+L?, (bucket|group)#\d+L?\]|\[shard#\d+L?\]|\[no#\d+L?, pass#\d+L?, 0\]|\[no#\d+L?, pass#\d+L?\]", line) for line in windows), windows


def test_hypergeometric_draws_have_their_distribution(spark):
    """Against the exact probabilities, and at numbers that no table of them would fit."""
    from math import comb

    u = "cast(conv(substr(md5(cast(id as string)), 1, 13), 16, 10) as double) / 4503599627370496D"
    draw = lambda n, good, total, k: [r[0] for r in spark.range(n).select(F.expr(mx._hypergeometric(f"{good}L", f"{total}L", f"{k}L", u))).collect()]
    for good, total, k in ((3, 10, 4), (7, 9, 8), (20, 50, 25), (1, 40, 39)):
        seen = Counter(draw(4000, good, total, k))
        for x in range(max(0, k + good - total), min(good, k) + 1):
            p = comb(good, x) * comb(total - good, k - x) / comb(total, k)
            assert abs(seen[x] / 4000 - p) < 0.035
        assert set(seen) <= set(range(max(0, k + good - total), min(good, k) + 1))
    large = np.array(draw(400, 10**8, 10**9, 10**6))
    assert abs(large.mean() - 10**5) < 60 and 200 < large.std() < 400


def test_shard_quotas_split_every_source(spark):
    sources = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 5, 700, 33, 2])], "no int, blocks long")
    rows = mx.shard_quotas(Tables(spark, "quotas"), sources, 5, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.no].append((r.shard, r["first"], r.n))
    for no, n in ((1, 1), (2, 5), (3, 700), (4, 33), (5, 2)):
        parts = sorted(by[no])
        assert [f for _, f, _ in parts] == list(itertools.accumulate([0, *[x for _, _, x in parts][:-1]])) and sum(x for _, _, x in parts) == n
    shards = Counter()
    for r in rows:
        shards[r.shard] += r.n
    assert set(shards.values()) <= {16, 15} and 0 not in by
