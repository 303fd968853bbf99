"""Exact vector search: the inner product of every query with every vector, block by block.

A batch of at most QUERIES_AT_ONCE queries, and of QUERY_BYTES, is sent to all tasks, which scan the vectors where
they lie. Larger batches stay a table: its queries are dealt in blocks, the vectors in shards, and
every block meets every shard in one task, which holds the block and reads the vectors as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES_AT_ONCE = 4096
#: Bytes of the vectors of the queries that are held at once.
QUERY_BYTES = 64 << 20
ROWS_AT_ONCE = 2048
#: Vectors in a shard of the large batches' way, about.
SHARD_ROWS = 1 << 20


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_col: str = "embedding", allowed: DataFrame | None = None, embedder: str | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) of scores above 0, best first, ties in order of ``ordinal``.

    vectors: (chunk_id, ordinal, embedding, and source_file if sources are restricted); queries:
    (qid, embedding), and possibly ``sources``, the sources that a query is restricted to, null for all; or
    ``allowed``: the same as rows (qid, source_file), where a query without any finds nothing. A
    task carries each query's k best scores along and gives on only rows that reach the k-th so far, and ranks these
    before a shuffle. Null vectors take no part; one of another length than the query's is an error,
    and so is one that names another ``embedder`` than that of the queries, in a column of that name.
    """
    names = queries.schema
    if embedder is not None and "embedder" in vectors.columns:
        vectors = vectors.withColumn(vector_col, of_embedder(F.col(vector_col), F.col("embedder"), embedder))
    asked = queries.withColumn("v", F.col(vector_col).cast("array<double>"))
    if allowed is not None:
        lists = allowed.groupBy("qid").agg(F.collect_set("source_file").alias("sources"))
        asked = asked.select("qid", "v").join(lists, "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    elif "sources" not in asked.columns:
        asked = asked.withColumn("sources", F.lit(None).cast("array<string>"))
    asked = asked.select("qid", "v", F.col("sources").cast("array<string>").alias("sources"))
    source = F.col("source_file").cast("string") if "source_file" in vectors.columns else F.lit(None).cast("string")
    frame = vectors.select("chunk_id", "ordinal", F.col(vector_col).cast("array<double>").alias("v"), source.alias("source"))
    kinds = {"qid": names["qid"].dataType, **{c: vectors.schema[c].dataType for c in ("chunk_id", "ordinal")}}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double"

    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v") + F.coalesce(F.octet_length(F.array_join("sources", "")), F.lit(0))), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // QUERIES_AT_ONCE), -(-size["bytes"] // QUERY_BYTES))
    if blocks <= 1:
        found = frame.mapInArrow(_scan(Block(asked.toArrow()), k), schema)
    else:
        found = _dealt(frame, asked, blocks, k, schema, kinds)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ordinal")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")


def of_embedder(vector: Column, made_by: Column, embedder: str) -> Column:
    """The vector; an error where another embedder made it, or none is named."""
    other = F.concat(F.lit("the index holds vectors of "), F.coalesce(made_by, F.lit("nobody")), F.lit(f", the queries' are of {embedder}; build the index again"))
    return F.when(made_by.eqNullSafe(embedder), vector).otherwise(F.raise_error(other).cast("array<double>"))


class Block:
    """Some queries, and what they find in slices of the vectors."""

    def __init__(self, rows: pa.Table):
        """rows: qid, v, sources. Those without a vector take no part."""
        rows = rows.filter(pc.is_valid(rows.column("v")))
        self.qids, vectors = (rows.column(c).combine_chunks() for c in ("qid", "v"))
        lengths = set(vectors.value_lengths().to_pylist())
        if len(lengths) > 1:
            raise ValueError(f"query vectors have different lengths: {sorted(lengths)}")
        self.matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
        self.sources = [None if s is None else frozenset(s) for s in rows.column("sources").to_pylist()]

    def only(self, rows: np.ndarray) -> Block:
        """The block of some of its queries."""
        part = copy(self)
        part.qids, part.matrix, part.sources = self.qids.take(pa.array(rows)), self.matrix[rows], [self.sources[i] for i in rows]
        return part

    def allowed(self, source: pa.Array) -> np.ndarray | None:
        """Whether each query may find each row, by its source; None if all may."""
        if all(s is None for s in self.sources):
            return None
        coded = source.dictionary_encode()
        held = np.array([[s is None or name in s for name in (*coded.dictionary.to_pylist(), None)] for s in self.sources])
        return held[:, coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]

    def least(self, k: int) -> np.ndarray:
        """What ``hits`` carries from slice to slice: the k best scores of each query so far."""
        return np.full((len(self.qids), k), -np.inf)

    def hits(self, ids: pa.Array, ordinals: pa.Array, vectors: pa.Array, source: pa.Array, k: int, best: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Rows that may be among the k best of all slices that share ``best``: none below the k-th score so far."""
        valid = pc.is_valid(vectors)
        ids, ordinals, vectors, source = (c.filter(valid) for c in (ids, ordinals, vectors, source))
        best = self.least(k) if best is None else best
        for lo in range(0, len(ids) if len(self.qids) else 0, ROWS_AT_ONCE):
            at = places(ordinals.slice(lo, ROWS_AT_ONCE))
            id_, ordinal, v, s = (c.slice(lo, ROWS_AT_ONCE).take(at) for c in (ids, ordinals, vectors, source))
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            if (sizes != self.matrix.shape[1]).any():
                raise ValueError(f"the queries' vectors have {self.matrix.shape[1]} components, an indexed one has {sizes[sizes != self.matrix.shape[1]][0]}; build the index again")
            score = np.round(self.matrix @ v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).T, 9)  # so that equal vectors tie wherever they lie
            if (mask := self.allowed(s)) is not None:
                score[~mask] = -np.inf
            # the k best of each query, of this slice and those before
            top = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, -k:]
            if np.isnan(top).any():  # sorted last, so any is among these; such a score is none
                score[np.isnan(score)] = -np.inf
                top = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, -k:]
            best[:] = np.partition(np.concatenate([best, top], axis=1), top.shape[1], axis=1)[:, -k:]
            floor = best.min(axis=1, keepdims=True)
            # rows are in order, so of those that tie with the last the first ones
            q, r = np.nonzero((score >= floor) & (score > 0))
            value = score[q, r]
            even = value == floor[q, 0]
            ties = np.cumsum(even)
            begin = np.searchsorted(q, np.arange(len(self.qids)))  # where a query's rows begin
            before = np.concatenate([[0], ties])[begin]
            above = np.bincount(q, ~even, len(self.qids))
            keep = ~even | (ties - before[q] <= k - above[q])
            q, r, value = q[keep], r[keep], value[keep]
            if len(q):
                yield pa.record_batch([self.qids.take(pa.array(q)), id_.take(pa.array(r)), ordinal.take(pa.array(r)), pa.array(value)], ["qid", "chunk_id", "ordinal", "score"])


def places(ordinals: pa.Array) -> pa.Array:
    """The order of rows by ordinal, which may be a struct."""
    columns = [ordinals]
    while any(pa.types.is_struct(c.type) for c in columns):
        columns = [part for c in columns for part in (c.flatten() if pa.types.is_struct(c.type) else [c])]
    names = [f"c{i}" for i in range(len(columns))]
    return pc.sort_indices(pa.table(columns, names), [(n, "ascending") for n in names])


def _scan(block: Block, k: int):
    def run(batches):
        best = block.least(k)
        for batch in batches:
            yield from block.hits(batch.column(0), batch.column(1), batch.column(2), batch.column(3), k, best)

    return run


def _dealt(frame: DataFrame, asked: DataFrame, blocks: int, k: int, schema: str, kinds: dict) -> DataFrame:
    """Rows (shard, block, kind, ...): the queries of a block come first, then the vectors of a shard."""
    shards = max(1, -(-frame.count() // SHARD_ROWS))
    none = {c: F.lit(None).cast(t) for c, t in kinds.items()}
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    left = asked.select(each(shards).alias("shard"), own(blocks, "qid").alias("block"), F.lit(0).alias("kind"), "qid", none["chunk_id"].alias("chunk_id"), none["ordinal"].alias("ordinal"), "v", F.lit(None).cast("string").alias("source"), "sources")
    right = frame.select(own(shards, "chunk_id").alias("shard"), each(blocks).alias("block"), F.lit(1).alias("kind"), none["qid"].alias("qid"), "chunk_id", "ordinal", "v", "source", F.lit(None).cast("array<string>").alias("sources"))
    rows = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")

    def run(batches):
        key, held, block, best = None, [], None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = batch.slice(lo, hi - lo), tuple(place[:2, lo].tolist())
                if now != key:
                    key, held, block = now, [], None
                if place[2, lo] == 0:
                    held.append(part)
                elif held or block:
                    if block is None:
                        block, held = Block(pa.Table.from_batches(held)), []
                        best = block.least(k)
                    yield from block.hits(part.column("chunk_id"), part.column("ordinal"), part.column("v"), part.column("source"), k, best)

    return rows.mapInArrow(run, schema)
