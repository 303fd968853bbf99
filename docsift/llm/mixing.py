"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target number of words. Its documents are permuted anew for each pass over
them and laid end to end; the words up to the target are cut into blocks of BLOCK_WORDS, the
source's block quota. A tree halves the range of output shards again and again; how many blocks
of each source go left is drawn from the multivariate hypergeometric distribution, so the leaves
hold what a uniform shuffle of all blocks would have given them, while each shard's and each
source's number of blocks is exact. A shard draws its blocks of a source, no two shards the
same, from a permuted order, and shuffles them locally.

Only DataFrame functions are used, and documents travel as rows of some 60 bytes. No task holds
a source: positions are running sums within small buckets of the permutation's keys, then over
buckets, then over buckets of buckets. Only the table of sources, a row of numbers for each, is
ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm.shared import Tables

BLOCK_WORDS = 4096
SHARD_BLOCKS = 1024
BUCKET_ROWS = 128
FAN_BITS = 8
CHUNK = 256  # sources in one fold of a draw; more are drawn for chunks first, then within each
LEVELS_AT_ONCE = 6
PRIME = (1 << 61) - 1  # above any number of blocks, so without a factor in common
WORD = r"[^\x20\x09-\x0D]+"
_NAMES = count()


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """``sources`` with ``no``, the place by code point, null last, and ``weight``, the cycle's value there."""
    places = sources.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    return places.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("no") % len(cycle) + 1).cast("int")).cast("long"))


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (no, source_size, weight > 0, ...) with ``target``: all words, split by weight, each source at most ``most`` times its size.

    What is above goes to the others by weight, until none is above: in the order of how much a
    unit of weight may take, sources are full up to the first that isn't, which settles the rest.
    """
    order = Window.orderBy(F.col("full") / F.col("weight"), "no")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    exact = "decimal(38,0)"
    all_size = F.sum(F.col("source_size").cast("decimal(28,0)")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = sources.withColumn("full", (F.col("source_size").cast("decimal(20,0)") * most).cast("decimal(24,0)"))
    rows = rows.withColumns({"left_size": (all_size - F.coalesce(F.sum("full").over(before), F.lit(0))).cast(exact), "left_weight": F.sum(F.col("weight").cast("decimal(12,0)")).over(rest).cast("decimal(14,0)")})
    open_ = F.col("full").cast("decimal(24,0)") * F.col("left_weight") > F.col("left_size").cast("decimal(26,0)") * F.col("weight").cast("decimal(12,0)")
    rows = rows.withColumn("at", F.first(F.when(open_, F.struct("left_size", "left_weight")), ignorenulls=True).over(order))
    share = (F.col("at.left_size").cast("decimal(26,0)") * F.col("weight").cast("decimal(12,0)")).cast("double") / F.col("at.left_weight").cast("double")
    return rows.withColumn("target", F.when(F.col("at").isNull(), F.col("full").cast("double")).otherwise(share)).drop("full", "left_size", "left_weight", "at")


def _let(values: dict[str, str], body) -> str:
    """SQL of ``body`` over a name that holds the values, each computed once."""
    name = f"v{next(_NAMES)}"
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"transform(array(named_struct({fields})), {name} -> {body(name)})[0]"


def _hypergeometric(good: str, total: str, draws: str, uniform: str) -> str:
    """SQL: how many of ``draws`` out of ``total`` are among the ``good``, by inversion from the mode outwards.

    Outcomes over 12 standard deviations and 32 from the mode have less than 1e-20 of the
    probability, far below the resolution of the uniform number.
    """

    def ratios(b: str) -> tuple[str, str]:
        up = f"double({b}.g - {b}.m - i + 1) * double({b}.n - {b}.m - i + 1) / (double({b}.m + i) * double({b}.t - {b}.g - {b}.n + {b}.m + i))"
        down = f"double({b}.m - i + 1) * double({b}.t - {b}.g - {b}.n + {b}.m - i + 1) / (double({b}.g - {b}.m + i) * double({b}.n - {b}.m + i))"
        return up, down

    def mass(steps: str, ratio: str) -> str:
        return f"aggregate({steps}, named_struct('p', 1D, 's', 0D), (a, i) -> if(i = 0, a, named_struct('p', a.p * {ratio}, 's', a.s + a.p * {ratio})), a -> a.s)"

    def walk(start: str, steps: str, ratio: str, sign: str, b: str, goal: str) -> str:
        step = f"named_struct('p', a.p * {ratio}, 's', a.s + a.p * {ratio}, 'k', {b}.m {sign} i)"
        return f"aggregate({steps}, {start}, (a, i) -> if(i = 0 or a.s > {goal}, a, {step}))"

    def drawn(c: str, b: str) -> str:
        up, down = ratios(b)
        ups, downs = f"sequence(0L, {c}.up)", f"sequence(0L, {c}.down)"

        def found(d: str) -> str:
            first = walk(f"named_struct('p', 1D, 's', 1D, 'k', {b}.m)", ups, up, "+", b, f"{d}.goal")
            return _let({"x": first}, lambda e: walk(f"named_struct('p', 1D, 's', {e}.x.s, 'k', {e}.x.k)", downs, down, "-", b, f"{d}.goal") + ".k")

        return _let({"goal": f"{uniform} * (1D + {mass(ups, up)} + {mass(downs, down)})"}, found)

    def ranged(a: str) -> str:
        low, high = f"greatest(0L, {a}.n + {a}.g - {a}.t)", f"least({a}.g, {a}.n)"
        spread = f"cast(ceil(12 * sqrt(double({a}.n) * {a}.g / {a}.t * ({a}.t - {a}.g) / {a}.t * ({a}.t - {a}.n) / greatest({a}.t - 1, 1))) as bigint) + 32"
        mode = f"least(greatest(cast(floor(({a}.g + 1D) * ({a}.n + 1D) / ({a}.t + 2D)) as bigint), {low}), {high})"
        return _let({"m": mode, "g": f"{a}.g", "t": f"{a}.t", "n": f"{a}.n", "low": low, "high": high, "w": spread}, lambda b: _let({"up": f"least({b}.w, {b}.high - {b}.m)", "down": f"least({b}.w, {b}.m - {b}.low)"}, lambda c: drawn(c, b)))

    return _let({"g": good, "t": total, "n": draws}, ranged)


def _draw(parts: str, total: str, draws: str, node: str) -> str:
    """SQL: of an array of (no, n) the same array with ``k``, how many of each are drawn; one source after another, given those before."""
    x, s = f"x{next(_NAMES)}", f"s{next(_NAMES)}"
    uniform = f"cast(conv(substr(md5(concat_ws('|', {node}, {x}.no)), 1, 13), 16, 10) as double) / {float(1 << 52)}D"
    taken = f"case when {s}.m = 0 then 0L when {s}.t = {x}.n then {s}.m else {_hypergeometric(f'{x}.n', f'{s}.t', f'{s}.m', uniform)} end"
    step = _let({"k": taken}, lambda v: f"named_struct('m', {s}.m - {v}.k, 't', {s}.t - {x}.n, 'out', concat({s}.out, array({v}.k)))")
    return f"aggregate({parts}, named_struct('m', {draws}, 't', {total}, 'out', cast(array() as array<bigint>)), ({s}, {x}) -> {step}, {s} -> {s}.out)"


def _split(parts: str, draws: str, node: str) -> str:
    """SQL: how many of each of the parts (no, n, ...) a multivariate hypergeometric draw takes; over chunks of parts first."""
    chunks = f"transform(sequence(0, cast((size({parts}) - 1) div {CHUNK} as int)), c -> slice({parts}, c * {CHUNK} + 1, {CHUNK}))"

    def outer(v: str) -> str:
        sums = f"transform({v}.chunks, (c, i) -> named_struct('no', -1 - i, 'n', aggregate(c, 0L, (z, y) -> z + y.n)))"
        return _let({"sums": sums}, lambda u: _let({"drawn": _draw(f"{u}.sums", f"aggregate({u}.sums, 0L, (z, y) -> z + y.n)", draws, node)}, lambda w: f"flatten(transform({v}.chunks, (c, i) -> {_draw('c', f'{u}.sums[i].n', f'{w}.drawn[i]', node)}))"))

    return _let({"chunks": chunks}, outer)


def shard_quotas(tables: Tables, sources: DataFrame, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, no, n, first) of sources (no, blocks): how many blocks each shard has of each source, and the number that shards before it have."""
    held = sources.where("blocks > 0")
    blocks = held.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    shards = -(-blocks // shard_blocks)
    parts = F.array_sort(F.collect_list(F.struct("no", F.col("blocks").alias("n"), F.lit(0).cast("long").alias("first"))))
    nodes = held.agg(parts.alias("parts")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "parts")
    start = "cast(floor(cast({0} as decimal(20,0)) * cast({1} as decimal(18,0)) / {2}) as bigint)"
    mid = "((lo + hi) div 2)"
    draws = f"{start.format(mid, blocks, shards)} - {start.format('lo', blocks, shards)}" if shards else "0L"
    for level in range(max(0, shards - 1).bit_length()):
        if level and level % LEVELS_AT_ONCE == 0:
            nodes = tables.write(nodes.repartition("lo"))
        cut = nodes.withColumn("k", F.expr(f"if(hi - lo > 1, {_split('parts', draws, f"'{seed}', lo, hi")}, transform(parts, x -> x.n))"))
        left = "transform(zip_with(parts, k, (x, y) -> named_struct('no', x.no, 'n', y, 'first', x.first)), x -> x)"
        right = "zip_with(parts, k, (x, y) -> named_struct('no', x.no, 'n', x.n - y, 'first', x.first + y))"
        halves = f"if(hi - lo > 1, array(named_struct('lo', lo, 'hi', {mid}, 'parts', {left}), named_struct('lo', {mid}, 'hi', hi, 'parts', {right})), array(named_struct('lo', lo, 'hi', hi, 'parts', parts)))"
        nodes = cut.select(F.explode(F.expr(halves)).alias("h")).select("h.lo", "h.hi", F.expr("filter(h.parts, x -> x.n > 0)").alias("parts"))
    return tables.write(nodes.select(F.col("lo").alias("shard"), F.inline("parts")).select("shard", "no", "n", "first"))


def _before(sums: DataFrame, levels: int) -> DataFrame:
    """(no, pass, bucket, before) of sums (no, pass, bucket, size), a row each: the sizes of a pass's buckets before it, level by level."""
    group = F.expr(f"shiftright(bucket, {FAN_BITS})") if levels else F.lit(0).cast("long")
    rows = sums.withColumn("group", group)
    order = Window.partitionBy("no", "pass", "group").orderBy("bucket")
    rows = rows.withColumn("before", F.sum("size").over(order) - F.col("size"))
    if levels:
        above = _before(sums.groupBy("no", "pass", group.alias("bucket")).agg(F.sum("size").alias("size")), levels - 1)
        above = above.select("no", "pass", F.col("bucket").alias("group"), F.col("before").alias("offset"))
        rows = rows.join(above, ["no", "pass", "group"]).withColumn("before", F.col("before") + F.col("offset"))
    return rows.select("no", "pass", "bucket", "before")


@dataclass(frozen=True)
class Mixture:
    """documents(row, doc_id, digest, source, size, no), sources(no, source, source_size, weight, target, quota, ...), pieces(shard, slot, at, row, doc_id, digest, pass, start, length)."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken): a row for each document, with the words that the shards drew of it."""
        rows = self.documents.select("row", "doc_id", "source", "size", "no", F.lit(0).cast("long").alias("length"))
        drawn = self.pieces.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("no"), "length")
        rows = rows.unionByName(drawn).groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "source", "size", "no")], F.sum("length").alias("taken"))
        return rows.join(self.sources.select("no", "source_size", "target"), "no").select("doc_id", "source", "size", "source_size", "target", "taken")

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(shard, slot, at, doc_id, text): what the shards hold, in their order by (slot, at); a document that a block cuts as its words with one space between."""
        body = docs.select(_digest(F.col(id_col), F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).dropDuplicates(["digest"])
        part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
        whole = self.documents.select("row", "size")
        rows = self.pieces.join(whole, "row").join(body, "digest")
        return rows.select("shard", "slot", "at", "doc_id", F.when(F.col("length") == F.col("size"), F.col("text")).otherwise(part).alias("text"))


def _digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 12, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> Mixture:
    """Mixes ``docs``: sources in code-point order, null last, weigh as ``cycle`` says, repeating, and take as many words in all as there are.

    A source's pieces add up to the whole words of its target; each document is taken as often as
    the source is passed over, and one of the last pass may be cut. Null and empty texts have no
    words and no pieces. Rows that repeat an id and text count each. The same rows give the same
    mixture, whatever their order. Other columns are ignored; an empty table gives empty results.
    """
    if not cycle or min(cycle) < 1 or most < 1:
        raise ValueError("weights and the limit must be 1 or more")
    tables = Tables(docs.sparkSession, "mixing")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(id_col), F.col(text_col)).alias("digest"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    own = tables.write(own.withColumn("row", F.monotonically_increasing_id()))
    sources = with_targets(cycled(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cycle), most)
    sources = sources.withColumn("quota", F.floor("target").cast("long")).withColumn("blocks", F.expr(f"cast(ceil(quota / {block_words}D) as bigint)"))
    sources = tables.write(sources.withColumn("bits", F.expr(f"greatest(0, cast(ceil(log2(n / {BUCKET_ROWS}D)) as int))")))
    documents = own.alias("d").join(sources.select("source", "no").alias("s"), F.expr("d.source <=> s.source")).select("d.*", "no")

    # a row for each pass over a document, at its place in that pass's permutation
    passes = F.expr("sequence(0, cast(ceil(quota / double(source_size)) as int) - 1)")
    asked = own.where("size > 0").alias("d").join(sources.where("quota > 0").alias("s"), F.expr("d.source <=> s.source"))
    items = asked.select("row", "doc_id", "digest", "size", "no", "bits", "source_size", "quota", F.explode(passes).alias("pass"))
    items = items.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), "pass", "digest"))).withColumn("bucket", F.expr("shiftright(cast(conv(substr(key, 1, 15), 16, 10) as bigint), 60 - bits)"))
    levels = -(-(sources.agg(F.max("bits")).first()[0] or 0) // FAN_BITS)
    before = _before(items.groupBy("no", "pass", "bucket").agg(F.sum("size").alias("size")), levels)
    order = Window.partitionBy("no", "pass", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = items.withColumn("within", F.sum("size").over(order) - F.col("size")).join(before, ["no", "pass", "bucket"])
    placed = placed.withColumn("a", F.expr("pass * source_size + before + within")).withColumn("b", F.expr("least(a + size, quota)")).where("a < b")
    block = F.explode(F.expr(f"sequence(a div {block_words}, (b - 1) div {block_words})"))
    pieces = placed.select("row", "doc_id", "digest", "no", "pass", "a", "b", block.alias("block"))
    pieces = pieces.withColumns({"from": F.expr(f"greatest(a, block * {block_words})"), "to": F.expr(f"least(b, (block + 1) * {block_words})")})

    quotas = shard_quotas(tables, sources, seed, shard_blocks)
    drawn = quotas.select("shard", "no", F.explode(F.expr("sequence(first, first + n - 1)")).alias("x")).join(sources.select("no", "blocks"), "no")
    step = f"cast((cast(x as decimal(19,0)) * cast({PRIME} % blocks as decimal(19,0)) + no) % blocks as bigint)"
    drawn = drawn.withColumn("block", F.expr(step))
    local = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "shard", "no", "block")), "no", "block")
    drawn = drawn.select("shard", "no", "block", (F.row_number().over(local) - 1).alias("slot"))
    pieces = pieces.join(drawn, ["no", "block"]).select("shard", "slot", F.expr(f"from - block * {block_words}").alias("at"), "row", "doc_id", "digest", "pass", F.expr("from - a").alias("start"), F.expr("to - from").alias("length"))
    return Mixture(documents, sources, pieces)
