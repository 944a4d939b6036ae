"""Ships this package to Python workers, so that a cluster needs no installation of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

__all__ = ["ship"]


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lociflow_shipped", False):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lociflow-")) / "lociflow-sources.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(str(path))
    context._lociflow_shipped = True
