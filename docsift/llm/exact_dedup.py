"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Blocks are sorted and get integers
as names, equal names for equal blocks only. Adjacent names are then paired, the pairs
sorted and named likewise, until each document has one name. With the number of blocks
that name is the document's identity; contents are compared, so no collision is possible.

For scale, blocks are sorted by (xxhash64, content). A document with a block whose hash
occurs nowhere else is alone in its class, so only 8-byte hashes of its blocks travel. The
content of the others travels once to find the candidates, and then once per distinct block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.shared import Tables

BLOCK_BYTES = 16384


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. keep_id is the
    largest id of the class, group_size the number of its rows. Rows with a null id take
    part and are kept only if the whole class has no id. Rows that repeat an id and text
    count each, and have the same result; an id with several texts counts for each of them.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "exact_dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), text.alias("bytes"))
    cut = f"transform(sequence(0, cast(greatest(ceil(length(bytes) / {block_bytes}D), 1) as int) - 1), i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))"
    signed = tables.write(base.select("id", F.sha2("bytes", 256).alias("sha"), F.expr(f"transform({cut}, b -> xxhash64(b))").alias("hashes")))

    hashes = signed.select("id", "sha", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    shared = tables.write(hashes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    # all blocks occur elsewhere; rows: how often this id has this text
    candidates = tables.write(hashes.join(shared, "h").groupBy("id", "sha", "n").agg(F.count("*").alias("c")).where("c % n = 0").select("id", "sha", "n", (F.col("c") / F.col("n")).cast("long").alias("rows")))
    # always by a merge join, so that the plan is the same at every size
    texts = base.select("id", F.sha2("bytes", 256).alias("sha"), "bytes").alias("a").join(candidates.alias("b").hint("merge"), F.expr("a.id <=> b.id and a.sha = b.sha"), "left_semi")
    blocks = tables.write(texts.select("id", "sha", F.posexplode(F.expr(cut)).alias("i", "block")).withColumn("h", F.xxhash64("block")), wide=True)

    names = _named(tables, blocks, ["h", "block"], ["h"])
    first = tables.write(blocks.join(names, ["h", "block"]).select("id", "sha", "i", "name").distinct())
    # a document that has come down to one name is done; the number of blocks tells names of different levels apart
    done, stale = [], [shared, blocks, names, candidates]
    level = tables.write(first.alias("a").join(candidates.alias("b"), F.expr("a.id <=> b.id and a.sha = b.sha")).select("a.id", "a.sha", "i", "name", "n", "rows"))
    stale += [first, level]
    most = level.agg(F.max("n")).first()[0] or 1
    done.append(level.where("n = 1").select("id", "sha", "n", "name", "rows"))
    left = 1
    while left < most:
        open_ = level.where(f"n > {left}")
        left *= 2
        pairs = open_.groupBy("id", "sha", "n", "rows", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = tables.write(pairs)
        names = _named(tables, pairs, ["left", "right"], ["left", "right"])
        level = tables.write(pairs.join(names, ["left", "right"]).select("id", "sha", "i", "name", "n", "rows"))
        stale += [pairs, names, level]
        done.append(level.where(f"n <= {left}").select("id", "sha", "n", "name", "rows"))
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    named = tables.write(named)
    classes = tables.write(named.groupBy("n", "name").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size")).where("group_size > 1"))
    tables.drop(*stale)
    found = named.join(classes, ["n", "name"]).select("id", "sha", "keep_id", "group_size")
    out = signed.select("id", "sha").alias("a").join(found.alias("b"), F.expr("a.id <=> b.id and a.sha = b.sha"), "left")
    keep = F.coalesce("keep_id", "a.id")
    return out.select(F.col("a.id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("a.id").eqNullSafe(keep).alias("kept"), F.col("a.sha").alias("text_sha256"))


def _named(tables: Tables, rows: DataFrame, keys: list[str], ranged: list[str]) -> DataFrame:
    """Distinct keys in sorted order with an integer name each; written, so a name never changes.

    ranged: the first keys, by which rows are dealt; Spark samples these on the driver, so they are short.
    """
    distinct = tables.write(rows.select(*keys).distinct())
    return tables.write(distinct.repartitionByRange(*ranged).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))
