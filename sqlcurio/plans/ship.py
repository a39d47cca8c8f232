"""The package's code for the executors, where they can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a Python file of the application, once."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="sqlcurio-code-"), "sqlcurio.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / "sqlcurio").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    context.addPyFile(target)
    _done.add(context.applicationId)
