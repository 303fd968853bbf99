"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; deleted when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/docsift/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; files that stay do no harm
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, written once and read again: lineage is cut, and what reads them several times computes them once."""
    path = fresh(rows.sparkSession, name)
    rows.write.parquet(path, compression=compression)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._docsift_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that no DataFrame yet to run reads."""
    for table in tables:
        delete(table.sparkSession, table._docsift_path)
