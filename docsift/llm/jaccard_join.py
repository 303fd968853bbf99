"""N-gram Jaccard self-join by chosen paths.

A text's set holds its runs of ``gram`` consecutive words. Its tokens are sampled by
min-hashes: under each of some random orders of all tokens, a set's sample is its first
token, and two sets have the same with a probability equal to their similarity. In each of
several independent runs a tree is grown whose root holds all sets. A node picks ``branch``
of the orders, and a set goes on to the children of its samples under each of them, so it
follows several paths at once. Nodes with one set end there. From level ``start`` on, a node
of at most ``bucket`` sets is a leaf. Larger ones are split on, down to ``depth``; one whose
sets nearly all came along from the node above (near copies, which no split parts) is a leaf
at once. Leaves are searched by brute force. A pair of similarity s survives the levels below
a node with probability q(d) = 1 - (1 - s * q(d + 1)) ** branch, and there are as many runs as
bring that of any pair at the threshold to ``recall``: 5 at the defaults.

Sets that are equal are searched once, and sets so small that no other set can be similar are
not searched. Leaves with the same members count as one, and a pair that meets in several
leaves is counted in the first. Leaves beyond a size are compared block by block in tasks of
bounded memory; no partner is left out, and pairs never leave a task: it returns counts of
links and one edge for each set. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import U, mix, releasing, text_slices, windows, word_hashes, words
from docsift.llm.components import components
from docsift.llm.shared import Tables, text_key

GRAM_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
BRANCH = 2
START = 2
DEPTH = 4
BUCKET = 512
ORDERS = 48
#: A node with more than this share of the node above is not worth splitting.
KEPT = 0.7
BLOCK_SHINGLES = 1 << 17
BLOCK_SETS = 512
COLUMNS = 2048
ROWS = 256


def runs_for(recall: float, similarity: float = SIMILARITY, branch: int = BRANCH, depth: int = DEPTH) -> int:
    """The number of runs in which a pair of that similarity meets at least once with the probability ``recall``."""
    met = 1.0
    for _ in range(depth):
        met = 1 - (1 - similarity * met) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def _sets(column: pa.Array, gram: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For runs of whole texts: each text's sorted distinct shingle hashes.

    A text with fewer words than a shingle has one shingle, of all its words; a text without words none.
    """
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, doc = words(data, offsets)
        h = word_hashes(data, starts, ends)
        first = np.searchsorted(doc, np.arange(hi - lo + 1)).tolist()
        grams = windows(h, gram)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= gram:
                out.append(np.unique(grams[a : b - gram + 1]))
            elif b > a:
                out.append(windows(h[a:b], b - a) ^ mix(np.array([b - a], U)))
            else:
                out.append(np.zeros(0, U))
        yield out


def _sketch(gram: int, orders: int):
    """For each text: the digest of its set, the set's size, its samples (min-hashes)."""
    factors = mix(np.arange(1, orders + 1, dtype=U)) | U(1)

    def run(batches):
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for sets in _sets(batch.column(2), gram):
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                sig = np.zeros((len(sets), orders), np.int32)
                if len(some):
                    joined, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    for k, f in enumerate(factors):
                        sig[some, k] = np.minimum.reduceat(((joined * f) >> U(32)).astype(np.uint32), at).view(np.int32)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sizes.append(n)
                sigs.append(sig)
            if sizes:
                flat = np.concatenate(sigs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int32)), lists], ["id", "th", "digest", "n", "sig"])

    return run


def _with_sets(gram: int):
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for part in _sets(batch.column(1), gram) for s in part]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], ["sid", "leaves", "shingles"])

    return run


def _similar_pairs(sets: list[np.ndarray], side: np.ndarray, across: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets with at least that Jaccard similarity, some rows at a time; only those of different sides, if across."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, row = (np.cumsum(times > 1) - 1)[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # as many sets as two blocks hold
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        held, at = np.unique(row[a:b], return_inverse=True)
        dense = np.zeros((len(held), min(COLUMNS, int(column[b - 1]) + 1 - lo)), np.float32)
        dense[at, column[a:b] - lo] = 1
        common[np.ix_(held, held)] += dense @ dense.T
    for lo in range(0, len(sets), ROWS):
        c = common[lo : lo + ROWS].astype(np.float64)
        # both counts are integers, so the comparison is exact up to the threshold's own rounding
        enough = c >= similarity * (n[lo : lo + ROWS, None] + n[None, :] - c) - 1e-9
        enough &= np.arange(len(sets))[None, :] > np.arange(lo, lo + len(c))[:, None]
        if across:
            enough &= side[lo : lo + ROWS, None] != side[None, :]
        i, j = np.nonzero(enough)
        if len(i):
            yield i + lo, j


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index is joined with by the pairs, besides what joined them before."""
    while True:
        least = np.minimum(root[i], root[j])
        fresh = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(fresh, at, least)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _search(similarity: float):
    """For each leaf (or two of its blocks): links of each set, and the least one that it is joined with."""

    def one(leaf: int, across: bool, rows: list[tuple]) -> list[tuple]:
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])  # by set
        if len(rows) < 2:
            return []
        side = np.array([r[1] for r in rows], bool)
        # the leaves that each set is in; two sets can meet only under the same path of orders
        of = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        paths, at = np.unique([x["path"] for r in rows for x in r[2]], return_inverse=True)
        met = np.zeros((len(rows), len(paths)), np.int64)
        met[of, at] = [x["leaf"] for r in rows for x in r[2]]
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for every_i, every_j in _similar_pairs([np.frombuffer(r[3], U) for r in rows], side, across, similarity):
            for lo in range(0, len(every_i), 1 << 14):
                i, j = every_i[lo : lo + (1 << 14)], every_j[lo : lo + (1 << 14)]
                a = met[i]
                first = ((a == met[j]) & (a != 0)).argmax(axis=1)
                mine = a[np.arange(len(a)), first] == leaf
                i, j = i[mine], j[mine]
                links += np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
                root = _joined(root, i, j)
        return [(rows[k][0], int(links[k]), rows[root[k]][0]) for k in np.flatnonzero(links)]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(3)]
            ids, sides, leaves, sets = (batch.column(k) for k in range(3, 7))
            for k, now in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if key:
                        out += one(key[0], key[1] != key[2], rows)
                    key, rows = now, []
                rows.append((ids[k].as_py(), sides[k].as_py(), leaves[k].as_py(), sets[k].as_py()))
            if out:
                yield _result(out)
        if key and (out := one(key[0], key[1] != key[2], rows)):
            yield _result(out)

    def _result(out):
        a, b, c = zip(*out, strict=True)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["sid", "links", "root"])

    return run


def _leaves(tables: Tables, reps: DataFrame, orders: int, runs: int, branch: int, start: int, depth: int, bucket: int) -> DataFrame:
    """(sid, n, path, leaf) for each leaf of two sets or more that a set comes to.

    path: which of the branches at each level lead there, the run first; leaf: that and the samples.
    """
    # the root of each run has orders of its own, and so has each level below; siblings have different ones
    roots = F.expr(f"transform(sequence(0, {runs * branch - 1}), j -> struct(cast(j as bigint) as path, xxhash64(j, sig[j]) as leaf))")
    each = (orders - runs * branch) // max(1, depth - 1)
    rows = reps.select("sid", "n", F.lit(None).cast("long").alias("above"), F.explode(roots).alias("at")).select("sid", "n", "above", "at.path", "at.leaf")
    found = None
    for level in range(1, depth + 1):
        sizes = tables.write(rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"))
        here = tables.write(rows.join(sizes, "leaf").select("sid", "n", "above", "path", "leaf", "size"))
        done = F.lit(True) if level == depth else (F.col("size") <= bucket) | F.coalesce(F.col("size") > KEPT * F.col("above"), F.lit(False))
        if level >= start:
            part = here.where(done).select("sid", "n", "path", "leaf")
            found = part if found is None else found.unionByName(part)
        if level == depth:
            break
        left = here.where(~done) if level >= start else here
        if level >= start and left.isEmpty():
            break
        picks = F.expr(f"transform(sequence(0, {branch - 1}), b -> path * {branch} + b + {runs * branch})")
        spread = left.select("sid", "n", F.col("size").alias("above"), "leaf", F.explode(picks).alias("path"))
        joined = spread.join(reps.select("sid", "sig"), "sid")
        rows = joined.select("sid", "n", "above", "path", F.expr(f"xxhash64(leaf, path, sig[cast({runs * branch + (level - 1) * each} + path % {each} as int)])").alias("leaf"))
    return found


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size, n_links, rep_id, n_shingles; see ``classes``."""
    out = classes(docs, id_col, text_col, **settings)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "rep_id", "n_shingles")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, branch: int = BRANCH, start: int = START, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, th, class, class_id, class_size, n_links, rep_id, n_shingles.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. th is the text's ``text_key``. rep_id is the least
    id with the same shingle set; n_links counts the other distinct sets at the similarity or
    above; class is a number that the rows reached by such links and equal sets have in common,
    class_id the least of their ids, class_size their number. ``recall`` is the least
    probability to find a given link at the threshold; it sets the number of runs.

    Null and wordless texts are alone in their class, whose number is null. Rows with a null id
    link to nothing but rows with an equal set, and have its class. Rows that repeat an id and its
    text count as one set and are each listed; where an id has several texts, each row is a
    document of its own, with the set, links and class of its own text. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "jaccard_join")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text_key(text).alias("th"), text.alias("text"))
    runs = runs_for(recall, similarity, branch, depth)
    orders = max(ORDERS, (runs + depth - 1) * branch)
    sketch = tables.write(source.mapInArrow(releasing(_sketch(gram, orders)), f"id {id_type}, th binary, digest binary, n int, sig array<int>"))
    # one row for each distinct set; which text stands for it is settled by id and digest
    own = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th"))).alias("own")
    sets = sketch.where("n > 0").groupBy("digest").agg(own, F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = tables.write(sets.select("digest", F.col("own.id").alias("rep"), F.col("own.th").alias("th"), "n", "sig", F.monotonically_increasing_id().alias("sid")))
    members = tables.write(sketch.where("n > 0").select("id", "th", "digest", "n").join(reps.select("digest", "rep", "sid"), "digest").select("id", "th", "n", "rep", "sid"))

    # a set of n tokens is at most n / (n + 1) similar to another one
    wanted = reps.where(f"rep is not null and n >= {similarity} * (n + 1) - 1e-9")
    leaves = tables.write(_leaves(tables, wanted, orders, runs, branch, start, depth, bucket))
    # leaves with the same members are one
    prints = leaves.groupBy("leaf").agg(F.count("*").alias("c"), F.sum(F.expr("xxhash64(sid) div 4294967296")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "sid")).alias("x"), F.sum("n").alias("shingles"))
    prints = tables.write(prints)
    same = prints.groupBy("c", "s", "x").agg(F.min("leaf").alias("canon"), F.max("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_SETS)).cast("int")
    canon = tables.write(prints.drop("shingles").join(same, ["c", "s", "x"]).select("leaf", "canon", blocks.alias("blocks")))
    lists = leaves.join(canon, "leaf").groupBy("sid").agg(F.collect_set(F.struct("path", F.col("canon").alias("leaf"), "blocks")).alias("leaves"))
    lists = lists.join(reps.select("sid", F.col("rep").alias("id"), "th"), "sid")
    held = source.join(lists, ["id", "th"]).dropDuplicates(["id", "th", "sid"]).select("sid", "text", "leaves")
    held = tables.write(held.mapInArrow(releasing(_with_sets(gram)), "sid long, leaves array<struct<path:bigint,leaf:bigint,blocks:int>>, shingles binary"), wide=True)

    # each set goes to its leaves; where a leaf has several blocks, to every two blocks with its own
    placed = held.select("sid", "leaves", "shingles", F.explode(F.expr("array_distinct(transform(leaves, x -> struct(x.leaf as leaf, x.blocks as blocks)))")).alias("at"))
    placed = placed.select("sid", "leaves", "shingles", F.col("at.leaf").alias("leaf"), F.expr("pmod(xxhash64(sid), at.blocks)").cast("int").alias("own"), F.explode(F.expr("sequence(0, at.blocks - 1)")).alias("other"))
    placed = placed.select("leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "sid", (F.col("own") > F.col("other")).alias("side"), "leaves", "shingles")
    placed = placed.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")
    found = tables.write(placed.mapInArrow(releasing(_search(similarity)), "sid long, links long, root long"), wide=True)

    roots = tables.write(components(tables, found.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid"))
    linked = tables.write(roots.join(reps.select("sid", "rep"), "sid"))
    names = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    links = found.groupBy("sid").agg(F.sum("links").alias("n_links"))
    known = tables.write(linked.join(names, "root").select("sid", "class_id", F.col("root").cast("long")).join(links, "sid", "left"))
    # a class is a component, or a set by itself
    classed = tables.write(members.join(known, "sid", "left").select("id", "th", "n", "rep", F.coalesce("root", "sid").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    counts = tables.write(classed.groupBy("root").agg(F.count("*").alias("class_size")))
    tables.drop(reps, members, leaves, prints, canon, held, found, roots, linked, known)
    out = classed.join(counts, "root").select("id", "th", F.col("root").alias("class"), "class_id", "class_size", "n_links", F.col("rep").alias("rep_id"), F.col("n").alias("n_shingles"))
    alone = sketch.where("n = 0").select("id", "th", F.lit(None).cast("long").alias("class"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("rep_id"), F.col("n").alias("n_shingles"))
    return out.unionByName(alone)
