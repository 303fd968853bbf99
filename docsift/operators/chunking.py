"""Multi-granularity chunks: leaves of blocks, and five families built from the leaves.

Every chunk has a file, pages, a section, a type, its own text, a prefix that says where it
is from, and ``index_text``, prefix and text together, which is what gets indexed. ``ordinal``
is its place among all chunks as (family, sort key), which ties in rankings fall back on.

Groups are pages, sections or titles of one file, so what a task collects is bounded by a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import clean, cut_at_word, page_label, squeeze, stable_id
from docsift.functions.udfs import split_at_punctuation
from docsift.sources.scratch import written

MIN_CHARS = 20
#: Types kept however short they are. Fixed values.
SHORT_TYPES = ("table_body", "table", "image_footnote", "image_caption")
COLUMNS = ("chunk_id", "source_file", "page_start", "page_end", "section", "block_type", "raw_text", "contextual_prefix", "index_text", "display_text", "image_refs", "family", "order_key")


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Adds block_index, the place of each block among all files in order of (doc_key, block_pos).

    Places come from counts by file and their running sum over files, so no task sees all blocks.
    """
    counts = written(blocks.groupBy("doc_key").agg(F.count("*").alias("n")), "counts")  # so that ranges are sampled from these, not from the blocks
    # running sums over ranges of files, then over the ranges; written, so that a task that runs again finds the same ranges
    ranges = written(counts.repartitionByRange("doc_key").withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = ranges.groupBy("part").agg(F.sum("n").alias("t"))
    # one row for each range: as many as shuffle partitions, however many files there are
    offsets = totals.withColumn("offset", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(F.broadcast(offsets.select("part", "offset")), "part").select("doc_key", (F.col("before") + F.col("offset")).alias("start"))
    at = F.row_number().over(Window.partitionBy("doc_key").orderBy("block_pos")) - 1
    # not broadcast, however few files there are: blocks stay dealt by file, in as many tasks as their work needs
    return blocks.withColumn("at", at).join(starts.hint("merge"), "doc_key").withColumn("block_index", F.col("start") + F.col("at")).drop("at", "start")


def leaf_prefix(source: Column, page: Column, section: Column, kind: Column) -> Column:
    # fixed value
    where = F.when(section != "", F.concat(F.lit("，章节/栏目为“"), section, F.lit("”"))).otherwise(F.lit(""))
    # the words of the prefix are fixed values
    return F.concat(F.lit("该片段来自《"), source, F.lit("》"), page_label(page, page), where, F.lit("，内容类型为 "), kind, F.lit("。"))


def _chunk(df: DataFrame, chunk_id: Column, kind: Column, prefix: Column, body: Column, family: int, key: Column) -> DataFrame:
    refs = F.col("image_refs") if "image_refs" in df.columns else F.array().cast("array<string>")
    return df.select(chunk_id.alias("chunk_id"), "source_file", "page_start", "page_end", "section", kind.alias("block_type"), body.alias("raw_text"), prefix.alias("contextual_prefix"), F.concat(prefix, F.lit("\n"), body).alias("index_text"), body.alias("display_text"), refs.alias("image_refs"), F.lit(family).alias("family"), key.alias("order_key"))


def leaf_chunks(blocks: DataFrame) -> DataFrame:
    """Leaves of numbered blocks: overlapping parts of their clean texts, short ones of most types dropped."""
    # a column of its own: within the split, the text would be cleaned for each use
    parts = blocks.withColumn("clean", clean(F.col("text"))).select("source_file", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.coalesce("section", F.lit("")).alias("section"), "block_type", F.coalesce("image_refs", F.array().cast("array<string>")).alias("image_refs"), "block_index", F.posexplode(split_at_punctuation("clean")).alias("part", "body"))
    parts = parts.where((F.length("body") >= MIN_CHARS) | F.col("block_type").isin(*SHORT_TYPES))
    prefix = leaf_prefix(F.col("source_file"), F.col("page_start"), F.col("section"), F.col("block_type"))
    key = F.struct(F.lit("").alias("a"), F.col("block_index").cast("long").alias("b"), F.col("part").cast("long").alias("c"), F.lit("").alias("d"))
    ids = stable_id(F.col("source_file"), F.col("page_start"), F.col("section"), F.col("block_index"), F.col("part"))
    return _chunk(parts, ids, F.col("block_type"), prefix, F.col("body"), 0, key)


def _ordered(column: str = "display_text") -> Column:
    """The group's texts in chunk order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("order_key", F.col(column).alias("x")))), lambda s: s["x"])


def compact_join(texts: Column, size: int) -> Column:
    return cut_at_word(squeeze(F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), " ")), size)


def _key(a: Column, b: Column, d: Column | None = None) -> Column:
    return F.struct(a.alias("a"), b.cast("long").alias("b"), F.lit(0).cast("long").alias("c"), (F.lit("") if d is None else d).alias("d"))


def page_chunks(leaves: DataFrame) -> DataFrame:
    """One chunk for each page with two leaves or more and 80 characters or more, under the commonest section."""
    # dealt by page once, for both aggregations, so that leaves are made once
    dealt = leaves.select("source_file", "page_start", "section", "order_key", "display_text").repartition("source_file", "page_start")
    parts = dealt.groupBy("source_file", "page_start", "section").agg(F.count("*").alias("c"), F.min("order_key").alias("k"), F.collect_list(F.struct("order_key", F.col("display_text").alias("x"))).alias("held"))
    section = F.expr("min_by(section, struct(-c, k)) FILTER (WHERE section <> '')")
    pages = parts.groupBy("source_file", "page_start").agg(F.sum("c").alias("n"), F.coalesce(section, F.lit("")).alias("section"), F.flatten(F.collect_list("held")).alias("held")).where("n >= 2")
    pages = pages.withColumn("texts", F.transform(F.array_sort("held"), lambda s: s["x"]))
    # exploded, so that the filter follows the joining of texts and does not join them once more
    pages = pages.withColumn("body", F.explode(F.array(compact_join(F.col("texts"), 1800)))).where("length(body) >= 80").withColumn("page_end", F.col("page_start"))
    main = F.when(F.col("section") != "", F.concat(F.lit("，主要章节/栏目为“"), F.col("section"), F.lit("”"))).otherwise(F.lit(""))
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》第 "), F.col("page_start").cast("string"), F.lit(" 页的自动页面聚合块"), main, F.lit("。"))
    return _chunk(pages, stable_id(F.lit("page"), F.col("source_file"), F.col("page_start")), F.lit("page_summary"), prefix, F.col("body"), 1, _key(F.col("source_file"), F.col("page_start")))


def section_chunks(leaves: DataFrame) -> DataFrame:
    """One chunk for each section with two leaves or more and 120 characters or more."""
    groups = leaves.where("section <> ''").groupBy("source_file", "section").agg(F.count("*").alias("n"), F.min("page_start").alias("first"), F.max("page_start").alias("last"), _ordered().alias("texts")).where("n >= 2")
    groups = groups.withColumn("body", F.explode(F.array(compact_join(F.col("texts"), 2200)))).where("length(body) >= 120").withColumnsRenamed({"first": "page_start", "last": "page_end"})
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》"), page_label(F.col("page_start"), F.col("page_end")), F.lit(" 章节/栏目“"), F.col("section"), F.lit("”的自动章节聚合块。"))
    ids = stable_id(F.lit("section"), F.col("source_file"), F.col("section"), F.col("page_start"), F.col("page_end"))
    return _chunk(groups, ids, F.lit("section_summary"), prefix, F.col("body"), 2, _key(F.col("source_file"), F.lit(0), F.col("section")))


def _titles(leaves: DataFrame) -> DataFrame:
    return leaves.where("block_type = 'title'").select("source_file", "page_start", "page_end", "section", "display_text", F.struct("page_start", "section", "display_text", "order_key").alias("at"))


def _lines(line: Column) -> Column:
    """The group's lines in order of titles, each once."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("x")))), lambda s: s["x"]))


def _title_line() -> Column:
    return F.concat(F.lit("第 "), F.col("page_start").cast("string"), F.lit(" 页："), F.when(F.col("section") != "", F.col("section")).otherwise(F.col("display_text")))


def heading_chunks(leaves: DataFrame, window: int = 8, step: int = 4) -> DataFrame:
    """Titles of ``window`` pages, from the first title's page every ``step`` pages; three titles or more."""
    titles = _titles(leaves)
    spans = titles.groupBy("source_file").agg(F.min("page_start").alias("first"), F.max("page_start").alias("last"))
    # each title knows the few windows it lies in, so there is no range join
    low = F.greatest(F.ceil((F.col("page_start") - F.col("first") - window + 1) / step), F.lit(0)).cast("int")
    high = F.floor((F.col("page_start") - F.col("first")) / step).cast("int")
    placed = titles.join(spans, "source_file").withColumn("w", F.explode(F.sequence(low, high)))
    groups = placed.groupBy("source_file", "w").agg(F.count("*").alias("n"), F.min("page_start").alias("p"), F.max("page_end").alias("q"), _lines(_title_line()).alias("lines")).where("n >= 3")
    groups = groups.withColumnsRenamed({"p": "page_start", "q": "page_end"}).withColumn("section", F.lit("局部标题索引"))
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》第 "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" 页的局部标题索引，用于回答有哪些文章、有哪些案例、涉及哪些主题等导航型问题。"))
    ids = stable_id(F.lit("local_heading_index"), F.col("source_file"), F.col("w"), F.col("page_start"), F.col("page_end"))
    return _chunk(groups, ids, F.lit("local_heading_index"), prefix, F.array_join("lines", "\n"), 3, _key(F.col("source_file"), F.col("w")))


def graph_chunks(leaves: DataFrame) -> DataFrame:
    """Title paths under one top section, with pages; 80 characters or more."""
    titles = _titles(leaves).where("section <> ''").withColumn("root", F.trim(F.substring_index("section", " > ", 1))).where("root <> ''")
    line = F.concat(F.lit("第 "), F.col("page_start").cast("string"), F.lit(" 页："), F.replace(F.col("section"), F.lit(" > "), F.lit(" -> ")))
    groups = titles.groupBy("source_file", "root").agg(F.min("page_start").alias("p"), F.max("page_start").alias("q"), _lines(line).alias("lines")).withColumnsRenamed({"p": "page_start", "q": "page_end"})
    groups = groups.withColumn("body", F.array_join("lines", "\n")).where("length(body) >= 80").withColumn("section", F.concat(F.lit("结构图索引："), F.col("root")))
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》围绕“"), F.col("root"), F.lit("”的轻量结构图索引，列出栏目、文章、案例、产品或子主题之间的层级关系和页码。"))
    ids = stable_id(F.lit("section_graph_index"), F.col("source_file"), F.col("root"), F.col("page_start"), F.col("page_end"))
    return _chunk(groups, ids, F.lit("graph_index"), prefix, F.col("body"), 4, _key(F.col("source_file"), F.lit(0), F.col("root")))


def outline_chunks(leaves: DataFrame, size: int = 30) -> DataFrame:
    """Every ``size`` titles of a file."""
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("at"))
    titles = _titles(leaves).withColumn("w", F.floor((place - 1) / size).cast("int"))
    groups = titles.groupBy("source_file", "w").agg(F.min("page_start").alias("p"), F.max("page_end").alias("q"), _lines(_title_line()).alias("lines")).withColumnsRenamed({"p": "page_start", "q": "page_end"}).withColumn("section", F.lit("文档大纲"))
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》第 "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" 页的自动文档大纲块，列出该范围内的标题、栏目和文章线索。"))
    ids = stable_id(F.lit("outline"), F.col("source_file"), F.col("w"), F.col("page_start"), F.col("page_end"))
    return _chunk(groups, ids, F.lit("outline"), prefix, F.array_join("lines", "\n"), 5, _key(F.col("source_file"), F.col("w")))


def build_chunks(blocks: DataFrame) -> DataFrame:
    """All six families of numbered blocks. The leaves are written once, with their text once: every family reads them."""
    lean = written(leaf_chunks(blocks).drop("raw_text", "index_text"), "leaves", "zstd")
    leaves = lean.withColumns({"raw_text": F.col("display_text"), "index_text": F.concat("contextual_prefix", F.lit("\n"), "display_text")}).select(*COLUMNS)
    out = leaves
    for family in (page_chunks, section_chunks, heading_chunks, graph_chunks, outline_chunks):
        out = out.unionByName(family(leaves))
    return out
