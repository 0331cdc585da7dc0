"""Making the package known to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the session's executors, once for each application.

    Spark serves the archive itself, so executors need neither an installed
    copy nor the driver's folders.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="kinloom-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
