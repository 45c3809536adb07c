"""Parquet and JSON-line tables: scans, sinks and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import from_epoch_seconds
from tickloom.operators.ordered import time_slice
from tickloom.schemas import BARS, TICKS

_DATE = T.StructField("date", T.DateType(), True)
ROWS_PER_FILE = 20_000_000


def _with_date(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, _DATE])


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Tick table as ``write_ticks`` lays it out; symbol and date prune folders."""
    return spark.read.schema(_with_date(TICKS)).parquet(path)


def read_bars(spark: SparkSession, path: str, timeframe: str = "M1") -> DataFrame:
    return spark.read.schema(_with_date(BARS)).parquet(path).filter(F.col("timeframe") == timeframe)


def write_ticks(ticks: DataFrame, path: str, slice_seconds: int = 3600) -> None:
    """Overwrite a tick table: folders by symbol and date, rows in time order inside a file.

    Rows are shuffled by (symbol, slice), not by symbol, so a hot symbol is written by
    many tasks; the order makes row-group statistics on ``time`` selective.
    """
    (
        ticks.withColumns({"date": F.to_date("time"), "_slice": time_slice(slice_seconds)})
        .repartition("symbol", "_slice")
        .sortWithinPartitions("symbol", "date", "time", "tick_id")
        .drop("_slice")
        .write.mode("overwrite").partitionBy("symbol", "date")
        .option("compression", "snappy").option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def write_bars(bars: DataFrame, path: str) -> None:
    (
        bars.withColumn("date", F.to_date("time"))
        .repartition("timeframe", "symbol", "date")
        .sortWithinPartitions("timeframe", "symbol", "date", "time")
        .write.mode("overwrite").partitionBy("timeframe", "symbol", "date")
        .option("compression", "snappy")
        .parquet(path)
    )


def file_sizes(table: DataFrame) -> DataFrame:
    """Megabytes of the files each symbol's rows lie in."""
    files = table.select("symbol", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy("symbol").agg((F.sum("file_size") / F.lit(1024 * 1024)).alias("file_size_mb"))


def write_messages(lines: DataFrame, path: str) -> None:
    """JSON documents, one per line, from the column ``value``."""
    lines.select("value").write.mode("overwrite").text(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_ticks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Ticks as they land in a folder; ``files_per_batch`` bounds one intake, nothing is dropped."""
    reader = spark.readStream.schema(_with_date(TICKS))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Any Parquet table as its files land."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# --- raw terminal dumps -----------------------------------------------------------------

#: What a terminal's dump of one symbol holds; the symbol is in the path alone.
RAW_TICKS = T.StructType([
    T.StructField("time", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "last")],
    T.StructField("volume", T.LongType()), T.StructField("time_msc", T.LongType()), T.StructField("flags", T.IntegerType()),
    T.StructField("volume_real", T.DoubleType()),
])


def read_raw_ticks(spark: SparkSession, path: str, symbol_pattern: str = r"/symbol=([^/]+)/") -> DataFrame:
    """Dumps of a folder as the tick table: time from epoch seconds, symbol from the path, ids in order of arrival.

    Files come in order of their paths and rows in the order of their file. A row's id is its place in the file
    plus the rows of all files before it: one count for each file, which Parquet keeps, is all that is ever ordered, and it is
    joined back by the file's path. Nothing is sorted, and the ids are the same at every reading.
    """
    rows = spark.read.schema(RAW_TICKS).option("recursiveFileLookup", "true").parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    # One row a file.
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_file", F.coalesce(before, F.lit(0)).alias("_offset"))
    symbol = F.regexp_extract(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), symbol_pattern, 1)
    return rows.join(offsets, "_file").select(
        (F.col("_offset") + F.col("_place")).alias("tick_id"), F.nullif(symbol, F.lit("")).alias("symbol"),
        from_epoch_seconds(F.col("time")).alias("time"), "bid", "ask", "last", "volume", "time_msc", "flags", "volume_real")


# --- small tables that are replaced -------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    """File system and complete versions of a table, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    return files, sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found)


def replace_version(table: DataFrame, path: str, version: int) -> None:
    """Write a version of a small table; once it is complete, all but it and the one before go.

    A version counts from its success mark on, which the writer's commit sets last: a reader, or a batch that runs again, always
    finds a whole one.
    """
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}/version={version}")
    files, complete = _versions(spark, path)
    for old in [v for v in complete if v < version][:-1]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


def read_version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The last complete version, or the last below a number."""
    complete = [v for v in _versions(spark, path)[1] if below is None or v < below]
    if not complete:
        raise FileNotFoundError(f"no complete version in {path}")
    return spark.read.parquet(f"{path}/version={complete[-1]}")
