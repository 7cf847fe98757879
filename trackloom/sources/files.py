"""The folder that driver and executors share, for tables and files that a run writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without one, a temporary folder that becomes it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def made(spark: SparkSession) -> list[str]:
    """Folders that this session's runs have made below the shared root."""
    sc = spark.sparkContext
    if not hasattr(sc, "_trackloom_made"):
        sc._trackloom_made = []
    return sc._trackloom_made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``cleanup`` removes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Remove all that this session's runs have written in the shared folder, and say how many folders that was.

    For when no result is read any more: results read from there are lost.
    """
    paths = made(spark)
    for p in paths:
        remove(spark, p)
    n = len(paths)
    paths.clear()
    return n
