"""Source divergence audit: how a source's use of words differs from other sources of its language.

Terms are runs of ASCII letters and characters beyond ASCII, A to Z lower-cased; each language
keeps those in at least MIN_DOCS of its documents. With c occurrences of a term in a group of N
occurrences of V kept terms, its probability is p = 1 + floor(SCALE * (c + 1) / (N + V)), and
the divergence of p from q is f = floor((p - q)**2 / q). All arithmetic is on integers.

Top terms come from an upper-bound search: a group's terms fall into buckets by their counts
there and in the language, and a bucket's f is at most that of its largest p and least q, as f
falls while q rises towards p. Buckets are evaluated best bound first; when those seen hold the
k terms asked for, only buckets whose bound is not below the k-th value are evaluated too.

Pairs of sources come from postings. What a pair would have if no term were in both is counted
from the sources' histograms of counts, as p is the same for all terms of a count; each term's
posting then adds what the sources in it change together. Sums stay within the tasks that read
the postings, so a task sends a number for each pair, not a row for each term and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm.arrays import releasing, text_slices, words
from docsift.llm.shared import Tables

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
CLASSES = 8  # count buckets for each doubling of a count
PAIRS_AT_ONCE = 1 << 20
PAIRS_HELD = 1 << 20
BYTES_AT_ONCE = 8 << 20
#: Bytes as they count: A to Z lower-cased, other ASCII than letters a separator.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
COUNTS = "lang string, source string, term string, c long, docs long"


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang, source) as rows (lang, source, term, occurrences, documents), and a row without a term for each group."""
    names = ["lang", "source", "term", "c", "docs"]
    for batch in batches:
        langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
        codes = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        _, first, group = np.unique(codes, return_index=True, return_inverse=True)
        lang, source = (batch.column(c).take(pa.array(first)) for c in (1, 2))
        none = pa.array(np.zeros(len(first), np.int64))
        yield pa.record_batch([lang, source, pa.nulls(len(first), pa.string()), none, none], names)
        for lo, _, data, offsets in text_slices(batch.column(0), BYTES_AT_ONCE):
            data = FOLDED[data]
            starts, ends, text = words(data, offsets)
            if not len(starts):
                continue
            cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[data != 32])]).dictionary_encode()
            kinds = len(found.dictionary)
            pairs, times = np.unique(text * kinds + found.indices.to_numpy(), return_counts=True)
            both, place = np.unique(group[lo + pairs // kinds] * kinds + pairs % kinds, return_inverse=True)
            order = np.argsort(place, kind="stable")
            c = np.add.reduceat(times[order], np.flatnonzero(np.diff(place[order], prepend=-1)))
            g, term = pa.array(both // kinds), found.dictionary.take(pa.array(both % kinds)).cast(pa.string())
            yield pa.record_batch([lang.take(g), source.take(g), term, pa.array(c), pa.array(np.bincount(place))], names)


def probability(c: str, size: str) -> Column:
    """1 + floor(SCALE * (c + 1) / size); where nothing is kept and size is 0, 1."""
    return F.expr(f"1L + coalesce(cast((cast({c} as decimal(19,0)) + 1) * {SCALE} div nullif(cast({size} as decimal(19,0)), 0) as bigint), 0L)")


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"  # the square is at most 1e18


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings ([(group, p, p of no occurrence)] of a term) as rows (a, b, value): what the terms that are in both a and b change, summed over a task."""
    held = (np.zeros(0, np.int64),) * 3

    def add(before, now):
        a, b, value = (np.concatenate(x) for x in zip(before, now, strict=True))
        order = np.lexsort((b, a))
        a, b, value = a[order], b[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.add.reduceat(value, first)

    for batch in batches:
        lists = batch.column(0)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        no, p, p0 = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
        width = np.repeat(sizes, sizes)  # of each entry, the entries of its posting, its own too
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        upto = np.cumsum(width)
        lo = 0
        while lo < len(no):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            w = width[lo:hi]
            left = np.repeat(np.arange(lo, hi), w)
            right = np.repeat(start[lo:hi] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            left, right = left[left != right], right[left != right]
            if len(left):
                value = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
                held = add(held, (no[left], no[right], value))
            if len(held[0]) > PAIRS_HELD:
                yield pa.record_batch([pa.array(x) for x in held], ["a", "b", "value"])
                held = (np.zeros(0, np.int64),) * 3
            lo = hi
    yield pa.record_batch([pa.array(x) for x in held], ["a", "b", "value"])


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both orders."""
    g = groups.select("no", "lang", "source", "p0", "kinds")
    other = g.select("lang", F.col("no").alias("o"), F.col("p0").alias("q0"))
    base = g.join(other, "lang").where("no <> o").select(F.col("no").alias("a"), F.col("o").alias("b"), F.expr(f"kinds * {divergence('p0', 'q0')}").alias("value"))
    counts = scored.groupBy("lang", "no", "p0", "p").agg(F.count("*").alias("n")).join(other, "lang").where("no <> o")
    ways = f"array(named_struct('a', no, 'b', o, 'value', n * ({divergence('p', 'q0')} - {divergence('p0', 'q0')})), named_struct('a', o, 'b', no, 'value', n * ({divergence('q0', 'p')} - {divergence('q0', 'p0')})))"
    alone = counts.select(F.inline(F.expr(ways)))
    postings = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "p0")).alias("posting")).where("size(posting) > 1").select("posting")
    both = postings.mapInArrow(releasing(shared_terms), "a long, b long, value long")
    sums = base.unionByName(alone).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = sums.join(g.select(F.col("no").alias("a"), "lang", "source"), "a")
    return named.join(g.select(F.col("no").alias("b"), F.col("source").alias("item")), "b").select(F.col("a").alias("no"), "lang", "source", "item", "value")


def _top_terms(tables: Tables, scored: DataFrame, top: int) -> DataFrame:
    """(no, lang, source, item, value, rank): of each group the ``top`` terms with p > q, by an upper-bound search over count buckets."""
    held = scored.where("p > q").withColumn("bucket", F.expr(f"1000 * cast(floor({CLASSES} * log2(c)) as int) + cast(floor({CLASSES} * log2(lang_c)) as int)"))
    bounds = held.groupBy("no", "bucket").agg(F.count("*").alias("n"), F.expr(divergence("max(p)", "min(q)")).alias("bound"))
    best = Window.partitionBy("no").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = tables.write(bounds.withColumn("seen", F.coalesce(F.sum("n").over(best), F.lit(0)) < top))
    order = Window.partitionBy("no").orderBy(F.desc("value"), "item")

    def ranked(buckets: DataFrame) -> DataFrame:
        rows = held.join(buckets, ["no", "bucket"], "left_semi").select("no", "lang", "source", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    kth = ranked(bounds.where("seen").select("no", "bucket")).where(F.col("rank") == top).select("no", F.col("value").alias("kth"))
    wanted = tables.write(bounds.join(kth, "no", "left").where("seen or kth is null or bound >= kth").select("no", "bucket"))
    return ranked(wanted)


def divergence_audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of ``docs``, a language and a source.

    Part ``pair``: each other source of the language, its divergence summed over all kept terms.
    Part ``term``: the terms more likely in the group than in its language, the ``top`` most
    divergent. rank goes by value, largest first, then by item in the order of its bytes.

    Null texts, languages and sources count as empty strings; a group without terms has pairs too.
    Repeated rows are documents of their own. Other columns are ignored, and an empty table gives
    an empty result.
    """
    tables = Tables(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col)])
    counts = tables.write(texts.mapInArrow(releasing(term_counts), COUNTS).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    held = counts.where("term is not null").withColumns({"lang_c": F.sum("c").over(term), "lang_docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    held = tables.write(held.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "c", "lang_c", "first"))
    sizes = held.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count_if("first").alias("firsts"))
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("kinds"))
    groups = counts.where("term is null").select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["n", "lang_n", "kinds"])
    # a row for each group is numbered in one task
    groups = tables.write(groups.withColumn("no", F.row_number().over(Window.orderBy("lang", "source")).cast("long")).withColumn("p0", probability("0", "n + kinds")))
    scored = held.join(groups, ["lang", "source"]).select("no", "lang", "source", "term", "c", "lang_c", "p0", probability("c", "n + kinds").alias("p"), probability("lang_c", "lang_n + kinds").alias("q"))
    scored = tables.write(scored)
    tables.drop(held)
    order = Window.partitionBy("no").orderBy(F.desc("value"), "item")
    pairs = _pairs(scored, groups).withColumn("rank", F.row_number().over(order))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", _top_terms(tables, scored, top)))]
    return parts[0].unionByName(parts[1])
