"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def deploy(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="stratafold-sources-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = Path(folder, "stage", package.name)
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    # the driver serves this file for as long as the application runs
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(folder, f"{package.name}-sources")), "zip", staged.parent))
    _shipped.add(app)


def deployed(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that sends the package first."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        deploy(spark)
        return query(spark, folder)

    return run
