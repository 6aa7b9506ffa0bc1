"""Give the executors this package, wherever the session runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application; Spark's file server hands the archive out."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="palimpsest-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/palimpsest", "zip", package.parent, package.name))
    return spark
