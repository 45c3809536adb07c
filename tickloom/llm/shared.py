"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: short lineage, stable rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """From now on, Arrow batches of the session that go to Python end after about ``most_bytes``.

    By default they end after 64 MB; buffers of that size, one in the executor and one in the worker, stay for every running task.
    No result depends on where batches end.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    # Read back as the session shows it: a number, with a unit or without.
    now = spark.conf.get(setting)
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}
    found = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", now.strip().lower())
    if not found or not 0 < int(found[1]) << units[found[2] or "b"] <= most_bytes:
        spark.conf.set(setting, str(most_bytes))


def crc32_of_id(column: str):
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none has more than ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
