"""Make this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once; Spark's file server hands them to the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone_src.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(top.rglob("*.py")):
            packed.write(path, str(path.relative_to(top.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
