"""Makes this package importable on executors where it isn't installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources along with the application, once, as ``spark-submit --py-files`` does."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="bazaarlens-")
        sources = Path(folder, "sources", package.name)
        shutil.copytree(package, sources, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", sources.parent))
        _shipped.add(application)
