"""Makes this package importable on executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources once to each application; later calls do nothing."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="thicket-", suffix=".zip")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as packed:
            for source in sorted(top.rglob("*.py")):
                packed.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(name)
        _sent.add(app)
    return spark
