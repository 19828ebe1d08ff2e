"""Send this package to the executors, where the cluster has not installed it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="reelgauge-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that join later fetch it too
    copied = Path(folder, "tree", package.name)
    shutil.copytree(package, copied, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, package.name)), "zip", copied.parent))
    _shipped.add(context.applicationId)
