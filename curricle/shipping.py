"""Brings this package to Python workers that would not find it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application once, as a zip that Spark itself hands to executors; not if PYTHONPATH names its folder."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    named = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in named or not os.path.isdir(package):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="curricle-"), "curricle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
