"""Parsed document layouts as blocks: discovery, two JSON formats, section paths.

Files are read by Spark (``wholetext``), so any file system that Spark reads will do, and
JSON is parsed on the executors with a fixed schema. Fields that may hold several types are
read as text and checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import clean, known_source

#: Types of blocks that hold text, and those that never do. Fixed values.
CONTENT_TYPES = ("text", "title", "table", "table_body", "table_caption", "table_footnote", "image_caption", "image_footnote")
DISCARDED_TYPES = ("header", "footer", "page_number", "aside_text")
#: Headings that recur under every product; marks of products and of categories. Fixed values.
GENERIC_SUBHEADINGS = ("主要功能", "主要设备", "应用场景", "产品介绍", "主要技术指标", "远程指挥调度功能")
PRODUCT_MARKS = "设备|装置|终端|接收机|系统|服务"
CATEGORY_MARKS = "——|类"
BLOCK_COLUMNS = ("doc_key", "source_file", "block_pos", "page", "block_type", "text", "section", "level", "image_refs", "raw")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(doc_key, file, path) of the files in child folders with a full.md and a layout file; by folder name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs, listed = at.getFileSystem(conf), []
    # names only, by the file system's own listing: Spark's sources leave out empty files
    for folder in fs.listStatus(at):
        if folder.isDirectory():
            listed += [(folder.getPath().getName(), f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(folder.getPath()) if f.isFile()]
    return layout_files(spark.createDataFrame(listed, "doc_key string, file string, path string").withColumn("path", plain_path(F.col("path"))))


def layout_files(rows: DataFrame) -> DataFrame:
    """Of (doc_key, file, ...) the layout and origin files of the folders that have a full.md and a layout file."""
    layout = F.col("file").endswith("_content_list.json") | (F.col("file") == "block_list.json") | F.col("file").endswith("_content_list_v2.json")
    dirs = rows.groupBy("doc_key").agg(F.max((F.col("file") == "full.md").cast("int")).alias("full"), F.max((F.col("file").endswith("_content_list.json") | (F.col("file") == "block_list.json")).cast("int")).alias("has"))
    return rows.where(layout | F.col("file").endswith("_origin.pdf")).join(dirs.where("full = 1 and has = 1").select("doc_key"), "doc_key")


def plain_path(path: Column) -> Column:
    """A path without scheme and percent-encoding, which Spark's listings use to different degrees."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(decoded, "^[a-z0-9]+:/*", "/")


def source_name(doc_key: Column, origin: Column) -> Column:
    """A folder's document: what stands before the last ``.pdf-``; without one, the origin file's name where there is one."""
    prefix = F.regexp_extract(doc_key, "^(.*)\\.pdf-", 1)
    marked = doc_key.contains(".pdf-") & (prefix != "")
    name = F.when(marked, F.concat(prefix, F.lit(".pdf"))).when(origin.isNotNull(), origin).when(doc_key.startswith(".pdf-"), doc_key).otherwise(F.concat(doc_key, F.lit(".pdf")))
    return known_source(clean(name))


TEXT_FIELDS = ("text", "table_body", "table_caption", "table_footnote")


def json_type(parsed: Column, field: str) -> Column:
    """The type of a field of a JSON object that is parsed as a variant: STRING, BIGINT and so on; null without it."""
    return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))


def first_text(parsed: Column) -> Column:
    """The first of the text fields, which are columns, that is a string of the parsed object and not blank, as it stands; else the empty text."""
    return F.coalesce(*[F.when(F.col(f).rlike("(?U)\\S") & F.coalesce(json_type(parsed, f) == "STRING", F.lit(False)), F.col(f)) for f in TEXT_FIELDS], F.lit(""))


def title_level(title: Column, level: Column) -> Column:
    """A title's depth: the parser's (2 if it has none), bounded by what the words tell."""
    compact = F.replace(title, F.lit(" "), F.lit(""))
    raw = F.coalesce(level, F.lit(2))
    product = compact.rlike(PRODUCT_MARKS) & (F.length(compact) >= 6)
    category = compact.rlike(CATEGORY_MARKS) & (F.length(compact) >= 8)
    return F.when(compact.isin(*GENERIC_SUBHEADINGS), F.greatest(raw, F.lit(2))).when(product | category, F.least(raw, F.lit(1))).otherwise(raw)


def section_paths(blocks: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Adds ``section``: the names of the open titles above each block, joined by `` > ``.

    blocks: (doc_key, block_pos, title, title_level), the last two null for other blocks. A
    title closes those of its level and below. With known ``levels``, running maxima for each are
    enough: the last title of a level is open unless a title of a smaller level came after it.
    Otherwise one pass over each document's blocks, in order, carries the open titles, however many levels there are.
    """
    if levels is None:
        place = blocks.withColumn("section", F.lit("")).repartition("doc_key").sortWithinPartitions("doc_key", "block_pos")
        return place.mapInArrow(_sections, place.schema)
    running = Window.partitionBy("doc_key").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, 0)
    named, open_ = blocks, []
    for i, level in enumerate(sorted(levels)):
        last = F.max(F.when(F.col("title_level") == level, F.struct("block_pos", "title"))).over(running)
        above = F.max(F.when(F.col("title_level") < level, F.col("block_pos"))).over(running)
        named = named.withColumn(f"_last{i}", last).withColumn(f"_above{i}", above)
        open_.append(F.when(F.col(f"_above{i}").isNull() | (F.col(f"_last{i}.block_pos") > F.col(f"_above{i}")), F.col(f"_last{i}.title")))
    section = F.concat_ws(" > ", *open_) if open_ else F.lit("")
    return named.withColumn("section", section).drop(*[f"_{k}{i}" for i in range(len(levels)) for k in ("last", "above")])


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks sorted by document and place: fills ``section``."""
    key, names, depths, section = None, [], [], ""
    for batch in batches:
        out = []
        for doc, title, level in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "title", "title_level")), strict=True):
            if doc != key:
                key, names, depths, section = doc, [], [], ""
            if level is not None:
                while depths and depths[-1] >= level:
                    depths.pop()
                    names.pop()
                depths.append(level)
                names.append(title)
                section = " > ".join(n for n in names if n is not None)
            out.append(section)
        yield batch.set_column(batch.schema.get_field_index("section"), "section", pa.array(out, pa.string()))


def blocks_of_items(items: DataFrame, flat: bool) -> DataFrame:
    """Blocks of (doc_key, source_file, priority, block_pos, item): one JSON object each, of a flat or a nested layout.

    In a flat layout a text with a whole number as its level is a title; in a nested one
    discarded blocks are left out.
    """
    depth = "text_level" if flat else "level"
    # an item is parsed twice, once for all values and once for their types, however many fields are read
    fields = ("type", "page_idx", "is_discarded", depth, *TEXT_FIELDS)
    rows = items.select("doc_key", "source_file", "priority", "block_pos", "item", F.json_tuple("item", *fields).alias(*fields))
    rows = rows.withColumn("kind", F.coalesce("type", F.lit(""))).where(F.col("kind").isin(*CONTENT_TYPES))
    if not flat:
        dropped = F.coalesce("is_discarded", F.lit("false")).isin("false", "0", "", "null")
        rows = rows.where(dropped & ~F.col("kind").isin(*DISCARDED_TYPES))
    rows = rows.withColumn("parsed", F.try_parse_json("item"))
    level = F.when(json_type(F.col("parsed"), depth) == "BIGINT", F.col(depth).try_cast("int"))
    rows = rows.withColumn("raw_text", first_text(F.col("parsed"))).withColumn("found_level", level)
    # exploded, so that the filter follows the cleaning; a plain column's would be cleaned once more for the filter
    rows = rows.select("doc_key", "source_file", "priority", "block_pos", "item", "kind", "page_idx", F.col("found_level").alias("level"), F.explode(F.array(clean(F.col("raw_text")))).alias("text")).where("text <> ''")
    if flat:
        rows = rows.withColumn("kind", F.when((F.col("kind") == "text") & F.col("level").isNotNull(), F.lit("title")).otherwise(F.col("kind")))
    title = F.when(F.col("kind") == "title", F.trim(F.regexp_replace("text", "^#+", "")))
    return rows.select("doc_key", "source_file", "priority", "block_pos", (F.coalesce(F.col("page_idx").try_cast("int"), F.lit(0)) + 1).alias("page"), F.col("kind").alias("block_type"), "text", "level", F.array().cast("array<string>").alias("image_refs"), F.col("item").alias("raw"), title.alias("title")).withColumn("title_level", F.when(F.col("title").isNotNull(), title_level(F.col("title"), F.col("level"))))


def load_blocks(spark: SparkSession, root: str) -> DataFrame:
    """All blocks below a root: of each folder, those of its first layout file that has any.

    Flat files come first, of these the ``_v2`` ones last, then the nested file.
    """
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", plain_path(F.input_file_name()).alias("path"))
    return assemble(discover(spark, root).join(texts, "path", "left"))


def assemble(files: DataFrame) -> DataFrame:
    """Blocks of (doc_key, file, value): ``layout_files`` with the contents of those that are JSON."""
    origin = files.where("file like '%\\\\_origin.pdf'").groupBy("doc_key").agg(F.min("file").alias("origin"))
    found = files.where("file not like '%\\\\_origin.pdf' and value is not null").join(origin, "doc_key", "left")
    flat = F.col("file") != "block_list.json"
    rank = F.when(~flat, F.lit("3")).when(F.col("file").contains("_v2"), F.concat(F.lit("2"), F.col("file"))).otherwise(F.concat(F.lit("1"), F.col("file")))
    rows = found.select("doc_key", source_name(F.col("doc_key"), F.col("origin")).alias("source_file"), "value", flat.alias("flat"), rank.alias("priority"))
    one = rows.where("flat").select("doc_key", "source_file", "priority", F.posexplode(F.from_json("value", "array<string>")).alias("block_pos", "item"))
    pages = rows.where("not flat").select("doc_key", "source_file", "priority", F.posexplode(F.from_json("value", "pdfData array<array<string>>")["pdfData"]).alias("a", "page_items"))
    two = pages.select("doc_key", "source_file", "priority", "a", F.posexplode("page_items").alias("b", "item")).select("doc_key", "source_file", "priority", (F.col("a").cast("long") * 1_000_000 + F.col("b")).alias("block_pos"), "item")
    every = blocks_of_items(one, True).unionByName(blocks_of_items(two, False))
    first = F.min("priority").over(Window.partitionBy("doc_key"))
    chosen = every.withColumn("first", first).where("priority = first").drop("first")
    return section_paths(chosen).select(*BLOCK_COLUMNS)
