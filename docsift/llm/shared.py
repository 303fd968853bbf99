"""What the operators share: tables in the shared folder, and reading the input tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.plans.ship import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one in local mode (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows and bytes in an Arrow batch, and rows in a batch of the Parquet reader. What a batch
#: holds is in memory several times over, and long texts make batches of the default size large.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
READER_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches, unless they are bounded lower; ships the package to its workers."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        digits = spark.conf.get(key).rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


class Tables:
    """Intermediate tables, as Parquet in the shared folder.

    A written table cuts lineage and survives the loss of executors. What one run writes
    lies in one folder, which is deleted when the driver ends; ``drop`` deletes earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/docsift/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, wide: bool = False) -> DataFrame:
        """The rows, written and read again. What is not wide (texts, or much work a byte) goes to few files."""
        self.n += 1
        path, key = f"{self.root}/{self.n}", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, before if wide else "false")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docsift_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no DataFrame yet to run reads."""
        for table in tables:
            self._delete(table._docsift_path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; files that stay do no harm
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """What tells the texts of an id apart: the digest of the bytes, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
