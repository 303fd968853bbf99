"""Exact vector search that leaves out groups of vectors by their centres and radii.

Vectors are dealt to groups round centres that a bounded sample gives. A query's product with a
vector of a group is at most its product with the centre plus its own length times the group's
radius, so once k hits are known, groups whose bound is below the k-th score hold none and are not
read for this query. Where a sample groups badly more is read, but nothing is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.operators.vectors import QUERIES_AT_ONCE, Block, vector_search
from docsift.sources.scratch import written

#: The most groups, and the vectors sampled for each, of which the centres are made.
GROUPS = 1024
SAMPLED = 32
ROUNDS = 6
#: Bytes of centres and of queries that are sent to every task.
SENT_BYTES = 64 << 20


@dataclass(frozen=True)
class GroupedVectors:
    """rows(grp, chunk_id, ordinal, source_file, embedding), sorted by group within files; groups(grp, centre, radius, n): a row for each."""

    rows: DataFrame
    groups: DataFrame


def centres(sample: np.ndarray, groups: int) -> np.ndarray:
    """Means of the parts of a sample, by a few rounds from rows spread over it."""
    found = sample[np.linspace(0, len(sample) - 1, groups).astype(int)]
    for _ in range(ROUNDS):
        nearest = _nearest(sample, found)
        counts = np.bincount(nearest, minlength=groups)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def _nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return ((found * found).sum(axis=1) - 2 * (x @ found.T)).argmin(axis=1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def group_vectors(vectors: DataFrame, groups: int | None = None, vector_col: str = "embedding") -> GroupedVectors:
    """Groups vectors (chunk_id, ordinal, embedding, perhaps source_file) of one length; null ones take no part.

    The centres are made of at most SAMPLED vectors for each group, taken by a hash of the id, so
    they are the same again; every vector is dealt to the nearest one. About the square root of
    their number are the groups, GROUPS at most.
    """
    source = F.col("source_file").cast("string") if "source_file" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select("chunk_id", "ordinal", source.alias("source_file"), F.col(vector_col).cast("array<double>").alias("embedding")).where("embedding is not null")
    n = rows.count()
    groups = max(1, min(groups or int(n**0.5), GROUPS, n))
    most = groups * SAMPLED
    share = F.pmod(F.xxhash64(F.lit(17), "chunk_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2.0 * most / max(n, 1)))
    sample = rows.where(share).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("embedding").toArrow().column(0).combine_chunks()
    lengths = set(sample.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(lengths)}")
    held = centres(_matrix(sample), groups) if len(sample) else np.zeros((1, 0))
    if held.nbytes > SENT_BYTES:
        raise ValueError(f"{groups} centres of {held.shape[1]} components are too large to send; ask for fewer groups")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding")
            if pc.any(pc.not_equal(v.value_lengths(), held.shape[1])).as_py():
                raise ValueError(f"vectors have other lengths than {held.shape[1]}")
            x = _matrix(v)
            grp = _nearest(x, held)
            far = np.sqrt(((x - held[grp]) ** 2).sum(axis=1))
            yield pa.record_batch([pa.array(grp.astype(np.int32)), pa.array(far), *batch.columns], ["grp", "far", *batch.schema.names])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = written(rows.mapInArrow(deal, f"grp int, far double, {kinds}").repartition("grp").sortWithinPartitions("grp"), "groups")
    stats = dealt.groupBy("grp").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    spark = vectors.sparkSession
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held)], "grp int, centre array<double>")
    return GroupedVectors(dealt.drop("far"), stats.join(F.broadcast(named), "grp").select("grp", "centre", "radius", "n"))


class Visits:
    """Which groups each query of a block is still to visit, best bound first."""

    def __init__(self, block: Block, groups: list):
        self.block, self.ids = block, np.array([g["grp"] for g in groups], np.int64)
        self.n = np.array([g["n"] for g in groups], np.int64)
        middle = np.array([g["centre"] for g in groups])
        own = np.sqrt((block.matrix**2).sum(axis=1))
        radius = np.array([g["radius"] for g in groups])
        # a little more than the bound, for the rounding of sums
        self.bound = block.matrix @ middle.T + own[:, None] * radius[None, :]
        self.bound += 1e-9 * (1 + np.abs(self.bound) + own[:, None] * (radius + np.sqrt((middle**2).sum(axis=1)))[None, :])
        self.seen = np.zeros(self.bound.shape, bool)

    def first(self, k: int) -> np.ndarray:
        """For each query the best groups until they hold k vectors."""
        order = np.argsort(-self.bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        now = np.zeros_like(self.seen)
        np.put_along_axis(now, order, before < k, 1)
        return self._new(now)

    def reaching(self, kth: np.ndarray) -> np.ndarray:
        """All others whose bound reaches the query's k-th score, or 0."""
        return self._new(self.bound >= np.maximum(kth, 0)[:, None])

    def _new(self, now: np.ndarray) -> np.ndarray:
        now &= ~self.seen
        self.seen |= now
        return now

    def share(self) -> float:
        """The share of all pairs of a query and a vector that were or will be read."""
        return float((self.seen * self.n).sum() / max(1, self.seen.shape[0] * self.n.sum()))


def grouped_search(index: GroupedVectors, queries: DataFrame, k: int = 10, vector_col: str = "embedding", allowed: DataFrame | None = None) -> tuple[DataFrame, float]:
    """((qid, chunk_id, score, rank) as ``vector_search`` has it, the share of pairs of a query and a vector that are read).

    Each query visits its best groups first, and then those whose bound reaches its k-th score. More
    than QUERIES_AT_ONCE queries, or too long ones, are searched without bounds.
    """
    asked = queries.select("qid", F.col(vector_col).cast("array<double>").alias("v"), *([F.col("sources").cast("array<string>").alias("sources")] if "sources" in queries.columns else []))
    if allowed is not None:
        lists = allowed.groupBy("qid").agg(F.collect_set("source_file").alias("sources"))
        asked = asked.select("qid", "v").join(lists, "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    elif "sources" not in asked.columns:
        asked = asked.withColumn("sources", F.lit(None).cast("array<string>"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("c")).first()
    groups = index.groups.orderBy("grp").collect()  # GROUPS rows at most
    if size["n"] > QUERIES_AT_ONCE or 8 * size["c"] > SENT_BYTES or not groups or not size["n"]:
        return vector_search(index.rows, asked.withColumnRenamed("v", "embedding"), k), 1.0
    rows = asked.toArrow()
    # queries by number, whatever their keys are
    named = asked.sparkSession.createDataFrame(pa.table({"no": pa.array(np.arange(rows.num_rows)), "qid": rows.column("qid")}))
    block = Block(rows.set_column(0, "qid", pa.array(np.arange(rows.num_rows))))
    if block.matrix.shape[1] != len(groups[0]["centre"]) and len(block.qids):
        raise ValueError(f"the queries' vectors have {block.matrix.shape[1]} components, indexed ones {len(groups[0]['centre'])}; build the index again")
    visits = Visits(block, groups)
    schema = "qid long, " + ", ".join(f"{c} {index.rows.schema[c].dataType.simpleString()}" for c in ("chunk_id", "ordinal")) + ", score double"

    def found(now: np.ndarray) -> DataFrame:
        some = np.flatnonzero(now.any(axis=0))
        return index.rows.where(F.col("grp").isin(visits.ids[some].tolist())).mapInArrow(_visiting(block, {int(visits.ids[g]): np.flatnonzero(now[:, g]) for g in some}, k), schema)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ordinal")
    first = written(found(visits.first(k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
    at = {q: i for i, q in enumerate(block.qids.to_pylist())}  # queries without a vector are none of the block's
    kth = np.zeros(len(at))
    for row in first.where(F.col("rank") == k).collect():  # a row for each query
        kth[at[row["qid"]]] = row["score"]
    more = found(visits.reaching(kth))
    every = first.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(order))
    best = every.where(F.col("rank") <= k).select(F.col("qid").alias("no"), "chunk_id", "score", "rank")
    return best.join(F.broadcast(named), "no").select("qid", "chunk_id", "score", "rank"), visits.share()


def _visiting(block: Block, who: dict[int, np.ndarray], k: int):
    """Over rows sorted by group: each group's vectors meet the queries that visit it."""

    def run(batches):
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo and (asking := who.get(int(grp[lo]))) is not None:
                    part = batch.slice(lo, hi - lo)
                    yield from block.only(asking).hits(*(part.column(c) for c in ("chunk_id", "ordinal", "embedding", "source_file")), k)

    return run
