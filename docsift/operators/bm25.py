"""BM25 over an inverted index of tables: postings, document lengths, term and corpus statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import tokenize
from docsift.functions.udfs import token_arrays
from docsift.operators.vectors import places
from docsift.sources.scratch import written

K1 = 1.5
B = 0.75
#: Queries up to which the postings are reduced to the queries' terms first.
QUERIES_AT_ONCE = 16384
BROADCAST_BYTES = 16 << 20
#: Bytes of the queries that one task holds, about.
QUERY_BYTES = 32 << 20
#: Queries of a task whose terms are Python objects at a time.
QUERIES_READ = 1024
ROWS_AT_ONCE = 1024
#: Chunks of a shard and of a block, about.
SHARD_CHUNKS = 8192
BLOCK_CHUNKS = 4
#: Chunks of a shard at most, about, where there are so many queries that their copies for all shards would outweigh the postings.
SHARD_MOST = 131072
#: Queries of a block at most, and terms of the queries in a row, about.
BLOCK_QUERIES = 131072
TERMS_IN_A_ROW = 1024
#: Terms up to which a query's blocks are bounded; the bounds of longer ones are sums of so many maxima that no block falls below the k-th score.
BOUNDED_TERMS = 8


@dataclass(frozen=True)
class BM25Index:
    """postings(term, chunk_id, tf, dl, and of the chunk ordinal and source_file if it has them), terms(term, df, idf), stats(n, avgdl): one row."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    chunks: DataFrame | None = None  # of an index being built: what is counted
    counted: bool = False  # whether ``terms`` is no table, but counted from all postings wherever it is read

    def only(self, asked: DataFrame) -> BM25Index:
        """The index of the terms in ``asked`` (term), which are sent to all tasks: others are neither counted nor shuffled. The corpus's statistics stay."""
        postings = self.postings.join(F.broadcast(asked), "term", "left_semi")
        return replace(self, postings=postings, terms=_terms(postings, self.stats) if self.counted else self.terms)

    def written(self, compression: str = "snappy") -> BM25Index:
        """The index with its tables written to the shared folder: the statistics come from the postings, and a search reads no texts."""
        spark, postings = self.postings.sparkSession, written(self.postings, "postings", compression)
        tokens = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()["tokens"]
        n = self.chunks.count()
        stats = spark.range(0, 1, 1, 1).select(F.lit(n).cast("long").alias("n"), F.lit(tokens / max(n, 1)).alias("avgdl"))  # needs no Python worker
        return BM25Index(postings, _terms(postings, stats), stats, counted=True)


def lengths(chunks: DataFrame, text_col: str = "index_text") -> DataFrame:
    """(chunk_id, dl): the number of tokens of each text."""
    return chunks.select("chunk_id", F.size(tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("dl"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lower-case text, other columns) as rows (term, tf, dl, other columns): the distinct tokens of all rows of a batch counted together."""
    for batch in batches:
        for part in (batch.slice(lo, ROWS_AT_ONCE) for lo in range(0, batch.num_rows, ROWS_AT_ONCE)):
            sizes, tokens = token_arrays(part.column(0))
            coded = tokens.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pairs // kinds
            others = [part.column(c).take(pa.array(row)) for c in range(1, part.num_columns)]
            yield pa.record_batch([coded.dictionary.take(pa.array(pairs % kinds)).cast(pa.string()), pa.array(counts), pa.array(sizes[row].astype(np.int32)), *others], ["term", "tf", "dl", *part.schema.names[1:]])


def build_bm25(chunks: DataFrame, text_col: str = "index_text") -> BM25Index:
    """Statistics over all chunks: later filters restrict candidates only.

    Terms are counted within a batch of chunks, so building shuffles no postings; a frequent
    term costs the statistics one row for each task.
    """
    carried = [c for c in ("chunk_id", "ordinal", "source_file") if c in chunks.columns]
    tokens = chunks.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), *carried)
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in carried)
    postings = tokens.mapInArrow(_counted, f"term string, tf long, dl int, {kinds}")
    return of_postings(postings, chunks)


def of_postings(postings: DataFrame, chunks: DataFrame) -> BM25Index:
    """The index of postings that are there already, of ``chunks``, which are only counted: texts are read once where postings are persisted or saved."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    stats = chunks.agg(F.count("*").alias("n")).join(F.broadcast(total), how="cross").select("n", (F.col("tokens") / F.greatest("n", F.lit(1))).alias("avgdl"))
    return BM25Index(postings, _terms(postings, stats), stats, chunks, counted=True)


def _terms(postings: DataFrame, stats: DataFrame) -> DataFrame:
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats), how="cross")
    return terms.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(all key columns, term, qtf): a term counts as often as the query has it."""
    keys = [c for c in queries.columns if c != text_col]
    return queries.select(*keys, F.explode(tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("qtf"))


def impact(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What an occurrence of a term adds to a chunk's score, but for the term's weight in the query."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(dl, F.lit(1)) / F.greatest(avgdl, F.lit(1e-9))))


def bm25_scores(index: BM25Index, queries: DataFrame, text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key columns of queries, chunk_id, ordinal, source_file, score) of every chunk that shares a term with a query.

    All of them, for those who want more than the best; see ``bm25_search`` for these.
    """
    keys = [c for c in queries.columns if c != text_col]
    wanted = query_terms(queries, text_col).join(index.terms, "term")
    postings, carried = index.postings, [c for c in ("ordinal", "source_file") if c in index.postings.columns]
    hits = postings.join(wanted, "term").join(F.broadcast(index.stats), how="cross")
    part = F.col("qtf") * F.col("idf") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    # rounded beyond any meaning: sums in another order must not part texts that tie
    return hits.groupBy(*keys, "chunk_id", *carried).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def top_k(scored: DataFrame, keys: list[str], k, order: list) -> DataFrame:
    """The first k rows of each key, with their rank; k is a number or a column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_search(index: BM25Index, queries: DataFrame, k: int = 10, text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """(keys, chunk_id, score, rank), best first, ties in chunk order; of scores above 0.

    ``allowed``: (keys, source_file) that a query is restricted to. A column ``sources`` of the queries
    does the same, null for all. Chunks are dealt to shards and queries to blocks, and a task
    has the postings of one shard and the queries of one block, so no term is one task, however
    many chunks have it. A shard passes over what can't be among its k best; see ``Shard``.
    """
    keys = [c for c in queries.columns if c not in (text_col, "sources")]
    asked = queries if "sources" in queries.columns else queries.withColumn("sources", F.lit(None).cast("array<string>"))
    if allowed is not None:
        lists = allowed.groupBy(*keys).agg(F.collect_set("source_file").alias("sources"))
        asked = asked.drop("sources").join(lists, keys, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    asked = asked.select(F.struct(*keys).alias("q"), F.col(text_col).alias("text"), F.col("sources").cast("array<string>").alias("sources"))
    # what is sent is bounded by the queries' number and by the length of all of them
    sent = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("bytes"))
    size = sent.join(F.broadcast(index.stats.select(F.col("n").alias("chunks"), "avgdl")), how="cross").first()
    terms = query_terms(queries.select(text_col), text_col).select("term").distinct()
    if size["n"] <= QUERIES_AT_ONCE and size["bytes"] <= BROADCAST_BYTES:
        index = index.only(terms)
    postings = index.postings
    shards = shards_of(size["chunks"], size["chunks"] * size["avgdl"], size["bytes"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * queries.sparkSession.sparkContext.defaultParallelism)
    # more blocks make more even tasks, and are taken as far as the postings' copies weigh no more than the queries'
    more = 1 if size["n"] <= QUERIES_AT_ONCE else min(3, int(size["bytes"] * shards / max(1, 4 * size["chunks"] * size["avgdl"])))
    blocks = max(1, more, -(-size["n"] // BLOCK_QUERIES), -(-size["bytes"] // QUERY_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kinds = {c: postings.schema[c].dataType if c in postings.columns else None for c in ("chunk_id", "ordinal", "source_file")}
    long = postings.join(F.broadcast(index.stats), how="cross").select(
        "term", impact(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("impact"), "chunk_id",
        (F.col("ordinal") if kinds["ordinal"] else F.col("chunk_id")).alias("ordinal"), (F.col("source_file").cast("string") if kinds["source_file"] else F.lit(None).cast("string")).alias("source"))
    place = f"chunk_id {kinds['chunk_id'].simpleString()}, ordinal {long.schema['ordinal'].dataType.simpleString()}"
    held = long.mapInArrow(_packed, f"term string, impact array<double>, {place}, source string").select(dealt(shards, "chunk_id").alias("shard"), each(blocks).alias("block"), "*")
    # texts travel, which are shorter than their terms and weights; the weights of all terms asked for go to each shard once
    left = asked.select(each(shards).alias("shard"), dealt(blocks, "q").alias("block"), "q", F.lower(F.coalesce("text", F.lit(""))).alias("text"), "sources", F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<double>").alias("idf"))
    rows = max(1, size["bytes"] // (8 * TERMS_IN_A_ROW))
    weights = index.terms.join(terms, "term").groupBy(F.pmod(F.xxhash64("term"), F.lit(rows)).alias("row")).agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf"))
    weights = weights.select(each(shards).alias("shard"), "terms", "idf").withColumn("block", each(blocks))
    left = left.unionByName(weights, allowMissingColumns=True)
    schema = f"q {asked.schema['q'].dataType.simpleString()}, {place}, score double"

    def run(_, asked: pa.Table, posted: pa.Table) -> pa.Table:
        return Shard(posted).of_texts(asked, k)

    found = left.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "ordinal"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q.*", "chunk_id", "score", "rank")


def shards_of(chunks: int, tokens: float, query_bytes: int, partitions: int, slots: int) -> int:
    """The number of shards: small ones, one for each partition at least, unless the copies of the queries' texts, one for each shard, would be
    over half of what the postings are, which take some four bytes a token; then as few as that asks for, down to shards of SHARD_MOST chunks and to ``slots``."""
    small, fitting = max(-(-chunks // SHARD_CHUNKS), partitions), int(2 * tokens / max(1, query_bytes))
    return max(1, min(small, max(fitting, -(-chunks // SHARD_MOST), min(partitions, slots))))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, one row for each run of a chunk's in a batch: its columns travel once, not with each term, and its terms as lines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("chunk_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        terms, impacts = (pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows).astype(np.int32)), batch.column(c)) for c in ("term", "impact"))
        others = [batch.column(c).take(pa.array(first)) for c in ("chunk_id", "ordinal", "source")]
        yield pa.record_batch([pc.binary_join(terms, "\n"), impacts, *(loosened(c) for c in others)], ["term", "impact", "chunk_id", "ordinal", "source"])


class Shard:
    """The postings of some chunks, and what a query finds in them.

    Chunks are numbered in their order, so that ties go to the smaller number, and lie in blocks of
    a few. Of each term and block the largest impact is held: a block's chunks score at most the sum of these
    over a query's terms. Blocks are scored best bound first, and the search ends where no bound
    reaches the k-th score so far, so it leaves out no chunk that belongs to the k best. For a query of
    many terms all its postings are added up at once, which costs less than ordering its blocks.
    """

    def __init__(self, posted: pa.Table):
        """posted: rows of a posting each, or of terms as lines and the list of their impacts."""
        named, impacts, times = posted.column("term").combine_chunks(), posted.column("impact").combine_chunks(), 1
        if pa.types.is_list(impacts.type):
            times, named, impacts = pc.list_value_length(impacts).to_numpy(zero_copy_only=False), pc.split_pattern(named, "\n").flatten(), impacts.flatten()
            posted = posted.drop_columns(["term", "impact"])
        ids = posted.column("chunk_id").combine_chunks().dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False)
        _, first = np.unique(code, return_index=True)
        heads = posted.take(pa.array(first))
        order = places(heads.column("ordinal").combine_chunks()).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.chunks = heads.take(pa.array(order))
        self.source = self.chunks.column("source").combine_chunks().dictionary_encode()
        coded = named.dictionary_encode()
        self.terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        term, chunk, impacts = coded.indices.to_numpy(zero_copy_only=False), np.repeat(number[code].astype(np.int32), times), impacts.to_numpy(zero_copy_only=False)
        at = np.argsort(term.astype(np.int64) * (len(order) + 1) + chunk, kind="stable")
        self.chunk, self.impact = chunk[at], impacts[at]
        cells = term[at].astype(np.int64) * (len(order) // BLOCK_CHUNKS + 1) + self.chunk // BLOCK_CHUNKS
        self.cell = np.flatnonzero(np.diff(cells, prepend=-1))  # where the postings of a term in a block begin
        self.most = np.maximum.reduceat(self.impact, self.cell) if len(at) else self.impact
        self.cell_block = self.chunk[self.cell] // BLOCK_CHUNKS
        self.of_term = np.searchsorted(term[at][self.cell], np.arange(len(self.terms) + 1))
        self.cell = np.append(self.cell, len(at))
        self.begin = self.cell[self.of_term]  # where the postings of a term begin
        self.scored = self.matched = 0  # postings

    def every(self, terms: list[int], weights: np.ndarray, k: int, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What ``best`` finds, from the scores of all chunks."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        total = np.bincount(np.concatenate([self.chunk[s] for s in spans]), np.concatenate([w * self.impact[s] for s, w in zip(spans, weights, strict=True)]), len(self.chunks))
        postings = sum(s.stop - s.start for s in spans)
        self.scored, self.matched = self.scored + postings, self.matched + postings
        if mask is not None:
            total[~mask] = 0
        # those that may tie with the k-th score once rounded belong to it
        floor = np.partition(total, len(total) - k)[len(total) - k] - 1e-8 if k < len(total) else 0
        found = np.flatnonzero((total > 0) & (total >= floor))
        scores = np.round(total[found], 9)
        found, scores = found[scores > 0], scores[scores > 0]
        first = np.lexsort((found, -scores))[:k]
        return found[first], scores[first]

    def best(self, terms: list[int], weights: np.ndarray, k: int, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, scores) of the k best, best first; mask: whether a chunk may be found."""
        blocks = len(self.chunks) // BLOCK_CHUNKS + 1
        cells = np.concatenate([np.arange(self.of_term[t], self.of_term[t + 1]) for t in terms])
        weight = np.repeat(weights, [self.of_term[t + 1] - self.of_term[t] for t in terms])
        block = self.cell_block[cells]
        bound = np.bincount(block, weight * self.most[cells], blocks)
        if mask is not None:
            bound[~np.logical_or.reduceat(np.append(mask, [False] * (-len(mask) % BLOCK_CHUNKS + BLOCK_CHUNKS)), np.arange(blocks) * BLOCK_CHUNKS)] = 0
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        place = np.full(blocks, blocks)
        place[order] = np.arange(len(order))
        by_place = np.argsort(place[block], kind="stable")  # a query's cells, block by block in that order
        cells, weight, upto = cells[by_place], weight[by_place], np.searchsorted(place[block][by_place], np.arange(len(order) + 1))
        found, scores, lo, step = np.zeros(0, np.int64), np.zeros(0), 0, max(4, -(-2 * k // BLOCK_CHUNKS))
        while lo < len(order) and (len(scores) < k or bound[order[lo]] + 1e-8 >= scores[k - 1]):
            hi = min(lo + step, len(order))
            some, w = cells[upto[lo] : upto[hi]], weight[upto[lo] : upto[hi]]
            sizes = self.cell[some + 1] - self.cell[some]
            at = np.repeat(self.cell[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            self.scored += len(at)
            chunk, slot = np.unique(self.chunk[at], return_inverse=True)
            score = np.round(np.bincount(slot, np.repeat(w, sizes) * self.impact[at]), 9)
            keep = score > 0 if mask is None else (score > 0) & mask[chunk]
            found, scores = np.concatenate([found, chunk[keep]]), np.concatenate([scores, score[keep]])
            first = np.lexsort((found, -scores))[:k]
            found, scores = found[first], scores[first]
            lo, step = hi, 2 * step
        self.matched += int((self.cell[cells + 1] - self.cell[cells]).sum())
        return found, scores

    def of_texts(self, asked: pa.Table, k: int) -> pa.Table:
        """What ``top`` finds for the rows (q, lower-case text, sources); other rows have lists of terms and idf, the weights of terms in the texts."""
        given = pc.is_valid(asked.column("terms"))
        known = asked.filter(given).select(["terms", "idf"]).combine_chunks()
        names, idf = ([x for c in known.column(n).chunks for x in c.flatten().to_pylist()] for n in ("terms", "idf"))
        weight = {t: w for t, w in zip(names, idf, strict=True) if t in self.terms}
        asked = asked.filter(pc.invert(given)).select(["q", "text", "sources"])
        parts = []
        for some in (asked.slice(lo, QUERIES_READ) for lo in range(0, max(1, asked.num_rows), QUERIES_READ)):
            sizes, tokens = token_arrays(some.column("text").combine_chunks())
            tokens, ends, terms, weights = tokens.to_pylist(), np.cumsum(sizes).tolist(), [], []
            for lo, hi in zip([0, *ends[:-1]], ends, strict=False):
                times = Counter(t for t in tokens[lo:hi] if t in weight)
                terms.append(list(times))
                weights.append([n * weight[t] for t, n in times.items()])
            parts.append(self.top(pa.table([some.column("q"), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64())), some.column("sources")], ["q", "terms", "weights", "sources"]), k))
        return pa.concat_tables(parts)

    def top(self, asked: pa.Table, k: int) -> pa.Table:
        """(q, chunk_id, ordinal, score) of the k best of each row of (q, terms, weights, sources)."""
        rows, chunks, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        names = self.source.dictionary.to_pylist() if len(self.chunks) else []
        code = self.source.indices.fill_null(len(names)).to_numpy(zero_copy_only=False) if len(self.chunks) else None
        some = (asked.slice(lo, QUERIES_READ) for lo in range(0, asked.num_rows, QUERIES_READ))
        for row, (terms, weights, sources) in enumerate(q for part in some for q in zip(*(part.column(c).to_pylist() for c in ("terms", "weights", "sources")), strict=True)):
            # always in the same order, so that sums do not depend on how terms were gathered
            known = sorted((t, w) for t, w in zip(terms, weights, strict=True) if t in self.terms)
            if not known:
                continue
            held = None if sources is None else set(sources)
            mask = None if held is None else np.array([*(n in held for n in names), False])[code]
            search = self.best if len(known) <= BOUNDED_TERMS else self.every
            found, score = search([self.terms[t] for t, _ in known], np.array([w for _, w in known]), k, mask)
            rows.append(np.full(len(found), row))
            chunks.append(found)
            scores.append(score)
        at = pa.array(np.concatenate(chunks))
        held = self.chunks.take(at)
        return pa.table([loosened(c.combine_chunks()) for c in (asked.column("q").take(pa.array(np.concatenate(rows))), held.column("chunk_id"), held.column("ordinal"))] + [pa.array(np.concatenate(scores))], ["q", "chunk_id", "ordinal", "score"])


def loosened(values: pa.Array) -> pa.Array:
    """The same with all fields of structs nullable, as the schemas of results name them."""
    if not pa.types.is_struct(values.type):
        return values
    parts = [loosened(x) for x in values.flatten()]
    return pa.StructArray.from_arrays(parts, fields=[pa.field(f.name, x.type) for f, x in zip(values.type, parts, strict=True)], mask=values.is_null())
