"""Ships this package to the Python workers of a session, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import docsift

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for an application."""
    sc, root = spark.sparkContext, Path(docsift.__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    # Spark copies the file to its own file server and from there to the executors
    path = Path(tempfile.mkdtemp(prefix="docsift-")) / "docsift.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
