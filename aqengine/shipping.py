"""Brings this package to the executors' Python workers, where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context; nothing if it already runs from an archive."""
    context, root = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_aqengine_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-"), "aqengine.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._aqengine_shipped = True
