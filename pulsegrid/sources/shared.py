"""The folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a temporary folder, in local sessions only.

    On a cluster no folder can be fallen back on: each machine would see its own. A
    ValueError says what to set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is there goes when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    for used in (path, f"{path}-state"):
        atexit.register(remove, spark, used)
    return path


def remove(spark: SparkSession, pattern: str) -> None:
    """Delete what a path or pattern of paths names, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(pattern)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        for found in files.globStatus(at) or ():
            files.delete(found.getPath(), True)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that there are."""
    context = spark.sparkContext
    each = [context._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, at in zip(paths, each, strict=True) if at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)]
