"""Making the package known to executors that were started without it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the session's executors once, unless they run here and find it by themselves.

    Spark's own file server delivers it; nothing is read from the driver's disk by executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    known = set()
    if context.master.startswith("local"):  # workers inherit the driver's environment, and in one process its folder
        known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
        if not context.master.startswith("local-cluster"):
            known.add(Path.cwd())
    if package.parent in known:
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = Path(folder) / "staged"
    shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", staged))
