"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """All timestamps in this library are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Clusters set ``spark.checkpoint.dir``. Only where it is unset and everything runs on one
    machine a temporary folder is made and recorded in the session; executors elsewhere
    would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach (master {master!r})")
        folder = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    _SCRATCH.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Remove what this process has written under ``scratch_path``, once results that read from it are stored elsewhere."""
    removed = 0
    while _SCRATCH:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return removed


def ship_module(name: str) -> None:
    """Send a module's functions to Python workers by value.

    Workers then need no installed copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])
