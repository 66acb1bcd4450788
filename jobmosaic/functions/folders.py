"""A folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode without that setting, under one temporary folder of the session.
    It is removed by discard, or when the driver's Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        folder = _LOCAL[app]
    if not _MADE:
        atexit.register(_remove_all)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def remove(path: str) -> None:
    """Removes a path that scratch gave, and what was written there."""
    spark = _MADE.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _remove_all() -> None:
    if SparkContext._gateway is None or SparkContext._gateway.proc is None or SparkContext._gateway.proc.poll() is None:
        for path in list(_MADE):
            remove(path)
