"""Approximate nearest neighbours by inner product, with robust-pruned directed graphs.

Vectors are dealt at random to shards of bounded size, which grow with the table so that there are few. In each, vectors enter a graph in
batches: a greedy beam search over the graph so far proposes neighbours, and relaxed distance
pruning keeps a few diverse ones: a candidate goes if a kept one is nearer to it, by the
factor ``alpha``, than the new vector is. Kept edges are also offered in reverse, and lists
that overflow are pruned again. A query is answered by a beam search over every shard.

The graph is built on directions: it joins vectors at small angles, and a query follows it by
inner product with the vectors themselves. A shard's lengths differ by a factor of two at most,
so that the vectors of large inner product lie close together in it. Every node can be reached
from the nodes where a search enters: some far from each other, and one of each part that
these do not reach. A search is repeated with twice the beam for as long as that improves what
is found. Equal vectors are one node, which holds the least of their ids: as many as a result
can name, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm.arrays import releasing
from docsift.llm.shared import Tables, small_batches

SHARD_VECTORS = 8192
SHARDS = 32  # beyond so many of the size above, shards grow in place of their number, up to the size below
MOST_VECTORS = 65536
QUERY_BLOCK = 65536
DEGREE = 32
BUILD_BEAM = 96
SEARCH_BEAM = 64
ALPHA = 1.2
BATCH = 256
STEP = 16
WALKS = 128  # queries that search a shard at a time, and the distances that they hold at most
WALK_CELLS = 1 << 22
ENTRIES = 16
BAND = 1  # a shard's lengths differ by at most so many powers of two
MOST_TASKS = 65536
INDEX_SCHEMA = "shard int, node int, ids array<long>, embedding array<double>, neighbors array<int>, entry boolean"


def _distances(x: np.ndarray, squares: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of q to the vectors in its row of ids."""
    return squares[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0] + (q * q).sum(axis=1)[:, None]


class Walk:
    """Best-first searches of one graph by several queries, that go on with a wider beam from what they have seen.

    A round follows the nearest nodes of each beam that are open. Only neighbours not seen before are measured.
    """

    def __init__(self, x: np.ndarray, squares: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray):
        self.x, self.squares, self.graph, self.entry, self.q = x, squares, graph, entry, q
        self.own = (q * q).sum(axis=1)
        self.gap = np.full((len(q), len(x) + 1), np.inf)  # squared distances of the nodes seen; the last column is for absent neighbours
        self.gap[:, -1] = 0
        self.gap[:, entry] = squares[entry] - 2 * (q @ x[entry].T) + self.own[:, None]
        self.done = np.zeros((len(q), len(x)), bool)  # nodes followed

    def _nearest_seen(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        some = self.entry if not self.done.any() else np.arange(len(self.x))
        far = self.gap[rows[:, None], some]
        if len(some) <= beam:
            return (np.pad(a, ((0, 0), (0, beam - len(some))), constant_values=c) for a, c in ((np.tile(some, (len(rows), 1)), 0), (far, np.inf)))
        best = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        return some[best], np.take_along_axis(far, best, 1)

    def _products(self, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out, cuts = np.empty(len(row)), [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            np.dot(self.x[node[lo:hi]], self.q[row[lo]], out=out[lo:hi])
        return out

    def on(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For the queries of these rows, in rising order: the nearest nodes found, nearest first, and their squared distances; -1 and inf where fewer."""
        n, step, gap, done = len(self.x), min(STEP, beam), self.gap.reshape(-1), self.done.reshape(-1)
        ids, far = self._nearest_seen(rows, beam)
        open_ = np.where(self.done[rows[:, None], ids], np.inf, far)  # the distance where a node is open
        worst, live = far.max(axis=1), np.arange(len(rows))
        while True:
            now = open_[live]
            pick = np.argpartition(now, step - 1, axis=1)[:, :step]
            some = np.take_along_axis(now, pick, 1) < np.inf
            has = some.any(axis=1)
            live, pick, some = live[has], pick[has], some[has]
            if not len(live):
                break
            r, c = np.nonzero(some)
            at, r = pick[r, c], live[r]
            node = ids[r, at]
            open_[r, at] = np.inf
            done[rows[r] * n + node] = True
            near, r = self.graph[node].reshape(-1), np.repeat(r, self.graph.shape[1])
            place = np.where(near < 0, n, near) + rows[r] * (n + 1)
            new = np.flatnonzero(gap[place] == np.inf)
            gap[place[new]] = new
            new = new[gap[place[new]] == new]  # once where several nodes have the neighbour
            r, near, place = r[new], near[new], place[new]
            d = self.squares[near] - 2 * self._products(rows[r], near) + self.own[rows[r]]
            gap[place] = d
            new = np.flatnonzero(d < worst[r])
            r, near, d = r[new], near[new], d[new]
            if not len(r):
                continue
            heads, first, times = np.unique(r, return_index=True, return_counts=True)
            slot = np.repeat(np.arange(len(heads)), times), np.arange(len(r)) - np.repeat(first, times)
            more_ids, more_far = np.zeros((len(heads), times.max()), np.int64), np.full((len(heads), times.max()), np.inf)
            more_ids[slot], more_far[slot] = near, d
            all_far = np.concatenate([far[heads], more_far], 1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[heads] = np.take_along_axis(all_far, best, 1)
            ids[heads] = np.take_along_axis(np.concatenate([ids[heads], more_ids], 1), best, 1)
            open_[heads] = np.take_along_axis(np.concatenate([open_[heads], more_far], 1), best, 1)
            worst[heads] = far[heads].max(axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(far < np.inf, np.take_along_axis(ids, order, 1), -1), far


def walks(x: np.ndarray, squares: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray) -> Iterator[tuple[slice, Walk]]:
    """The rows of q in blocks, each with its search, so that what one holds is bounded."""
    size = max(16, min(WALKS, WALK_CELLS // len(x)))
    for lo in range(0, len(q), size):
        rows = slice(lo, min(lo + size, len(q)))
        yield rows, Walk(x, squares, graph, entry, q[rows])


def beam_search(x: np.ndarray, squares: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q: the nearest nodes found, nearest first, and their squared distances; -1 and inf where fewer."""
    ids, far = np.empty((len(q), beam), np.int64), np.empty((len(q), beam))
    for rows, walk in walks(x, squares, graph, entry, q):
        ids[rows], far[rows] = walk.on(np.arange(len(walk.q)), beam)
    return ids, far


def robust_prune(x: np.ndarray, squares: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node the diverse neighbours kept among its row of candidates (-1: none)."""
    candidates = candidates.copy()
    candidates.sort(axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == nodes[:, None]] = -1
    safe = np.maximum(candidates, 0)
    far = _distances(x, squares, safe, x[nodes])
    far[candidates < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, safe, far = (np.take_along_axis(a, order, 1) for a in (candidates, safe, far))
    points, sq = x[safe], squares[safe]
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    alive, rows = candidates >= 0, np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1, np.int64)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, k] = candidates[rows[some], at[some]]
        alive &= alpha * alpha * between[rows, at] > far
        alive[rows, at] = False
    return out


def far_apart(x: np.ndarray, most: int) -> np.ndarray:
    """The first node, then again and again the one farthest from those chosen; at most so many."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def entry_nodes(graph: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``first`` and the least node of each part of the graph that no search from those before reaches."""
    entry, reached, front = first.tolist(), np.zeros(len(graph), bool), first
    while True:
        while len(front):
            reached[front] = True
            near = np.unique(graph[front])
            front = near[(near >= 0) & ~reached[near]]
        if reached.all():
            return np.array(entry)
        front = np.array([reached.argmin()])
        entry.append(int(front[0]))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each node, -1 where fewer; the entry nodes) of vectors in random order."""
    entry = far_apart(x, ENTRIES)
    order = np.concatenate([entry, np.setdiff1d(np.arange(len(x)), entry)])
    graph = _grown(x[order], len(entry), degree, beam, alpha)
    out = np.full_like(graph, -1)
    out[order] = np.where(graph >= 0, order[graph], -1)
    return out, entry_nodes(out, entry)


def _grown(x: np.ndarray, done: int, degree: int, beam: int, alpha: float) -> np.ndarray:
    """The graph of vectors that enter in their order, the first ``done`` of them being those where searches enter."""
    n = len(x)
    squares = (x * x).sum(axis=1)
    graph = np.full((n, degree), -1, np.int64)
    entry = np.arange(done)
    for alpha_now, redo in ((alpha, False), (alpha, True)):
        start = 0 if redo else done
        while start < n:
            size = min(BATCH if redo else max(1, min(BATCH, start)), n - start)
            nodes = np.arange(start, start + size)
            found, _ = beam_search(x, squares, graph, entry, x[nodes], beam)
            keep = robust_prune(x, squares, nodes, np.concatenate([found, graph[nodes]], 1), degree, alpha_now)
            graph[nodes] = keep
            source, target = np.repeat(nodes, degree)[keep.ravel() >= 0], keep.ravel()[keep.ravel() >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            heads, first, times = np.unique(target, return_index=True, return_counts=True)
            width = int(times.max()) if len(times) else 0
            offered = np.full((len(heads), width), -1, np.int64)
            offered[np.repeat(np.arange(len(heads)), times), np.arange(len(target)) - np.repeat(first, times)] = source
            for lo in range(0, len(heads), BATCH):
                h = heads[lo : lo + BATCH]
                both = np.concatenate([graph[h], offered[lo : lo + BATCH]], 1)
                both.sort(axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                fits = (both >= 0).sum(axis=1) <= degree
                packed = -np.sort(-both, axis=1)
                graph[h[fits]] = np.pad(packed[fits], ((0, 0), (0, max(0, degree - packed.shape[1]))), constant_values=-1)[:, :degree]
                if (~fits).any():
                    most = int((both[~fits] >= 0).sum(axis=1).max())
                    graph[h[~fits]] = robust_prune(x, squares, h[~fits], packed[~fits][:, :most], degree, alpha_now)
            start += size
    return graph


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def directions(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null, zero, empty or of null, NaN or infinite components."""
    v = f"`{vector_col}`"
    return vectors.where(f"{v} is not null and size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0)")


def _tasks(shards: int) -> int:
    """A number of tasks for so many shards, which are long work on few bytes: some to spare while they are few, so that hardly any task gets two."""
    return min(max(shards, min(4 * shards, 1024)), MOST_TASKS)


def shards_of(vectors: int, least: int) -> int:
    """The number of shards for so many vectors: a query visits each, so it stands still from SHARDS until the size of one reaches the largest."""
    return -(-vectors // max(least, min(-(-vectors // SHARDS), MOST_VECTORS)))


def build_index(vectors: DataFrame, k: int, tables: Tables, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, int, int]:
    """(index table, shards, dimensions) over every usable vector.

    Only vectors of the commonest number of components are indexed; of equally common ones, the least.
    """
    good = usable(vectors, vector_col).where(f"`{id_col}` is not null").select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
    if not sizes:
        return tables.write(tables.spark.createDataFrame([], INDEX_SCHEMA)), 0, 0
    dimensions = sizes[0]["d"]
    good = good.where(F.size("v") == dimensions).withColumn("h", F.xxhash64("v"))
    least = Window.partitionBy("h", "v").orderBy("id")
    nodes = good.withColumn("rn", F.dense_rank().over(least)).where(F.col("rn") <= k + 1)
    nodes = nodes.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("most", F.expr("array_max(transform(v, x -> abs(x)))"))
    length = "log2(most) + log2(aggregate(v, 0D, (s, x) -> s + (x / most) * (x / most))) / 2"  # no squares of the components themselves, which overflow
    nodes = tables.write(nodes.withColumn("band", F.expr(f"cast(round(({length}) / {BAND}) as int)")).drop("most"))
    shards, of, first = 0, [], []
    for band, n in sorted(nodes.groupBy("band").count().collect()):  # as many as a double's exponent has bands
        some = shards_of(n, shard_vectors)
        of += [F.lit(band), F.lit(some)]
        first += [F.lit(band), F.lit(shards)]
        shards += some

    def build(key, group):
        h = group.column("h").to_numpy()
        group = group.take(pa.array(np.argsort(h, kind="stable")))  # the same order at every attempt
        graph, entry = build_graph(directions(_matrix(group.column("v"))))
        n = group.num_rows
        lists = pa.array([row[row >= 0].astype(np.int32) for row in graph], pa.list_(pa.int32()))
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), group.column("ids"), group.column("v"), lists, pa.array(np.isin(np.arange(n), entry))], ["shard", "node", "ids", "embedding", "neighbors", "entry"])

    placed = nodes.withColumn("shard", (F.create_map(*first)[F.col("band")] + F.pmod(F.xxhash64("h"), F.create_map(*of)[F.col("band")])).cast("int")).drop("band")
    return tables.write(placed.repartition(_tasks(shards), "shard").groupBy("shard").applyInArrow(build, INDEX_SCHEMA), wide=True), shards, dimensions


class Shard:
    """One shard's graph, vectors and ids, in memory."""

    def __init__(self, parts: list[pa.RecordBatch]):
        nodes = pa.Table.from_batches(parts)
        self.original, self.ids = _matrix(nodes.column("embedding")), nodes.column("ids").to_pylist()
        self.entry = np.flatnonzero(nodes.column("entry").to_numpy(zero_copy_only=False))
        self.graph = np.full((len(self.original), DEGREE), -1, np.int64)
        for row, near in enumerate(nodes.column("neighbors").to_pylist()):
            self.graph[row, : len(near)] = near
        # products are summed with the exponents taken off, so that no sum of large ones is inf - inf
        self.exponents = np.frexp(np.abs(self.original).max(axis=1))[1]
        self.original = np.ldexp(self.original, -self.exponents[:, None])
        self.x = np.ldexp(self.original, (self.exponents - self.exponents.max())[:, None])
        self.longest = (self.x * self.x).sum(axis=1).max()

    def found(self, q: np.ndarray, k: int, beam: int) -> np.ndarray:
        """For each row of q the k nodes of largest product found, those that may tie with the last, and maybe more; -1 where fewer: by a beam that doubles while the k best get better."""
        parts = [self._found(walk, k, max(beam, k)) for _, walk in walks(self.x, np.zeros(len(self.x)), self.graph, self.entry, q)]
        wide = max(p.shape[1] for p in parts)
        return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=-1) for p in parts])

    def _found(self, walk: Walk, k: int, wide: int) -> np.ndarray:
        live = np.arange(len(walk.q))
        out, far = walk.on(live, wide)
        while len(live) and wide < len(self.x):
            wide = min(2 * wide, len(self.x))
            now, gap = walk.on(live, wide)
            better = (gap[:, :k] < far[live, :k]).any(axis=1)
            out, far = (np.pad(a, ((0, 0), (0, wide - a.shape[1])), constant_values=c) for a, c in ((out, -1), (far, np.inf)))
            out[live], far[live] = now, gap
            live = live[better]
        # products are summed anew in another order, by far less than this apart
        near = far <= far[:, k - 1 : k] + 1e-9 * np.sqrt(walk.own * self.longest)[:, None]
        return out[:, : max(1, int(near.sum(axis=1).max()))]

    def search(self, asked: list[int], q: np.ndarray, k: int, beam: int) -> tuple[list, list, list]:
        """(query ids, vector ids, scores): of each query the k best nodes' ids, without its own; of scores that tie with the last, the smaller ids."""
        power = np.frexp(np.abs(q).max(axis=1))[1]
        q = np.ldexp(q, -power[:, None])
        out_q, out_v, out_s = [], [], []
        for lo in range(0, len(q), BATCH):
            found = self.found(q[lo : lo + BATCH], k + 1, beam)
            safe = np.maximum(found, 0)
            with np.errstate(over="ignore", under="ignore"):
                score = np.ldexp((self.original[safe] * q[lo : lo + BATCH, None, :]).sum(axis=2), self.exponents[safe] + power[lo : lo + BATCH, None])
            score[found < 0] = -np.inf
            last = np.sort(score, axis=1)[:, max(0, score.shape[1] - k - 1)]
            for row, own in enumerate(asked[lo : lo + BATCH]):
                best = np.flatnonzero((score[row] >= last[row]) & (found[row] >= 0))
                hits = sorted((-score[row, j], i) for j in best for i in self.ids[found[row, j]] if i != own)[:k]
                out_q += [own] * len(hits)
                out_v += [i for _, i in hits]
                out_s += [-s for s, _ in hits]
        return out_q, out_v, out_s


def _answer(k: int, beam: int):
    """Over rows sorted by shard and block, the nodes before the queries: holds one shard at a time, and queries as they come."""

    def run(batches):
        key, held, shard = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = batch.slice(lo, hi - lo), tuple(place[:2, lo].tolist())
                if now != key:
                    key, held, shard = now, [], None
                if place[2, lo] == 0:
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = Shard(held), []
                q, v, s = shard.search([x[0] for x in part.column("ids").to_pylist()], _matrix(part.column("embedding")), k, beam)
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, shards: int, dimensions: int, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each usable query, without its own id.

    Every query visits every shard. A shard's nodes go once to each of its tasks, as many as there are
    blocks of QUERY_BLOCK queries, and the queries stream through.
    """
    spark = index.sparkSession
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    small_batches(spark)
    asked = usable(queries, vector_col).where(F.col(id_col).isNotNull()).where(F.size(vector_col) == dimensions)
    asked = asked.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    nothing = F.array().cast("array<int>")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("node"), F.array("query_id").alias("ids"), F.col("v").alias("embedding"), nothing.alias("neighbors"), F.lit(False).alias("entry"))
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "node", "ids", "embedding", "neighbors", "entry")
    rows = held.unionByName(asked).repartition(_tasks(shards * blocks), "shard", "block").sortWithinPartitions("shard", "block", "kind", "node")
    hits = rows.mapInArrow(releasing(_answer(k, beam)), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of ``vectors`` by inner product for each row of ``queries``; see ``build_index`` and ``search``.

    Unusable vectors and null ids take no part, on either side. Ties go to the smaller id.
    A repeated row is found once and asked once; an id with several vectors is found by the
    best of them, and asks with all. Vectors may be of any finite lengths. score is the inner product of the original
    vectors in double precision. Empty tables give an empty result.
    """
    tables = Tables(vectors.sparkSession, "graph_index")
    index, shards, dimensions = build_index(vectors, k, tables, id_col, vector_col)
    return search(index, shards, dimensions, queries, k, id_col, vector_col)
