"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only if the session names no shared folder: on a single machine.
LOCAL = "file:///tmp/checkpoints/foldmill"

_left: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; it stays until ``clear``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or LOCAL).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove all folders given out in this process; results that read them end here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = list(_left)
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _left.discard(path)
    return len(paths)
