"""Sends the package to the executors, once per application, where they don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    with tempfile.NamedTemporaryFile(prefix="tessella-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(out.name)
    _sent.add(context.applicationId)
