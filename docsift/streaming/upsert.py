"""Incremental upserts of chunks from a stream: an extension, with the batch semantics of ``operators.merge``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docsift.operators.merge import upsert


def current(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table's last complete version, or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.schema(schema).parquet(f"{path}/v{done[-1]}") if done else None


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each batch into the table at ``path``; ``chunks`` has chunk_id and ordinal.

    Each batch writes a new version named by its number, so a batch that runs again after a
    failure gives the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("ordinal", F.struct(F.lit(number).cast("long").alias("batch"), F.col("ordinal").cast("string").alias("at")))
        old = current(spark, path, fresh.schema)
        merged = fresh if old is None else old.unionByName(fresh)
        # first place kept, last values win
        rows = upsert(merged).withColumn("ordinal", F.col("ordinal.at"))
        rows.select(*fresh.columns).write.mode("overwrite").parquet(f"{path}/v{number}")

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
