"""Keyed upserts of chunks, and the choice of chunks to summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions.text import stable_id
from docsift.sources.scratch import delete, exists

SUMMARY_TYPES = ("section_summary", "page_summary")
SUMMARY_MIN_CHARS = 160


def upsert(*layers: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """Rows of all layers by key: the last layer's values, the first layer's place.

    Within a layer the row with the largest order counts, and the least order is its place.
    The result's order column is (layer, order) of the first occurrence.
    """
    every = None
    for i, layer in enumerate(layers):
        rows = layer.select(F.lit(i).alias("layer"), F.col(order).alias("at"), F.struct(*[c for c in layer.columns if c != order]).alias("row"), F.col(key).alias("k"))
        every = rows if every is None else every.unionByName(rows)
    merged = every.groupBy("k").agg(F.max_by("row", F.struct("layer", "at")).alias("row"), F.min(F.struct("layer", "at")).alias("place"))
    return merged.select("row.*", F.col("place").alias(order))


def upsert_buckets(path: str, changes: DataFrame, buckets: int = 64, key: str = "chunk_id", order: str = "ordinal") -> list[int]:
    """Upserts ``changes`` into the table at ``path``, which lies in buckets of its keys; only buckets with a changed key are written anew.

    Values and places are those of ``upsert``: the changes' values, the place that a key has already. The
    merged buckets are written beside the table first and copied from there, so a run that is
    stopped on the way loses nothing: the next one copies them once more before it begins. One
    writer at a time; the columns and the number of buckets stay those of the first call. Returns the buckets written.
    """
    spark, table, staged = changes.sparkSession, f"{path}/table", f"{path}/staged"
    schema = changes.schema
    held = lambda at: spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(at)

    def copy() -> None:
        held(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        delete(spark, staged)

    spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).write.mode("append").partitionBy("bucket").parquet(table)
    if exists(spark, f"{staged}/_SUCCESS"):
        copy()
    fresh = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # as many as there are buckets
    if touched:
        merged = upsert(held(table).where(F.col("bucket").isin(touched)), fresh, key=key, order=order)
        merged.withColumn(order, F.col(f"{order}.at")).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        copy()
    return touched


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/table").drop("bucket")


def summary_candidates(chunks: DataFrame, limit: int = 0) -> DataFrame:
    """Page and section chunks of 160 characters or more without a summary yet; the first ``limit`` in order, all for 0."""
    done = chunks.where("block_type = 'llm_summary'").select(F.col("chunk_id").alias("summary_id"))
    wanted = chunks.where(F.col("block_type").isin(*SUMMARY_TYPES) & (F.length("display_text") >= SUMMARY_MIN_CHARS)).withColumn("summary_id", stable_id(F.lit("llm_summary"), F.col("chunk_id")))
    left = wanted.join(done, "summary_id", "left_anti")
    return left.orderBy("ordinal").limit(limit) if limit else left


def summary_chunks(summaries: DataFrame) -> DataFrame:
    """Chunks of summaries: rows of ``summary_candidates`` with a ``summary`` text."""
    # the words of the prefix are fixed values
    prefix = F.concat(F.lit("该片段是《"), F.col("source_file"), F.lit("》第 "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(" 页章节“"), F.col("section"), F.lit("”的 LLM 生成摘要索引。"))
    text = F.trim("summary")
    rows = summaries.where(text != "")
    return rows.select(F.col("summary_id").alias("chunk_id"), "source_file", "page_start", "page_end", "section", F.lit("llm_summary").alias("block_type"), text.alias("raw_text"), prefix.alias("contextual_prefix"), F.concat(prefix, F.lit("\n"), text).alias("index_text"), text.alias("display_text"), "image_refs", "ordinal")
