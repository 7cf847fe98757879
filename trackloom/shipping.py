"""Gives this package to the Python workers of a session's executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per session, wherever its executors run; needless, but harmless, where the package is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_trackloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="trackloom-"), "trackloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(package)))
    sc.addPyFile(path)
    sc._trackloom_shipped = True
