"""Live ingestion: bars, statistics, sinks, late rows, bad rows and messages by kind.

Every job takes ``trigger`` as the keyword arguments of ``DataStreamWriter.trigger``.
Sinks written per batch use one folder per batch id and overwrite it, so a batch
that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions import scalar as S
from tickloom.operators import messages as M
from tickloom.operators.bars import minute_bar_columns
from tickloom.schemas import MESSAGE
from tickloom.sources.tables import read_version, replace_version

# Flush and statistics cadence.
HOURLY: Mapping[str, object] = {"processingTime": "1 hour"}
EACH_SECOND: Mapping[str, object] = {"processingTime": "1 second"}
CATCH_UP: Mapping[str, object] = {"availableNow": True}
DEFAULT_DELAY = "10 minutes"


def live_bars(ticks: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """One bar per (symbol, minute), emitted once the watermark has passed its end."""
    return (
        ticks.withWatermark("time", delay)
        .groupBy("symbol", F.window("time", "1 minute").alias("w"))
        .agg(*minute_bar_columns())
        .select("symbol", F.col("w.start").alias("time"),
                "open", "high", "low", "close", "volume", "tick_count", "mean_mid")
    )


def live_stats(ticks: DataFrame) -> DataFrame:
    """Per symbol: ticks, last tick time, mean spread since the start."""
    return ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_ticks"), F.max("time").alias("last_tick_time"),
        F.avg(S.spread(F.col("bid"), F.col("ask"))).alias("avg_spread"),
    )


def unique_ticks(ticks: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Drop repeated (symbol, time, bid, ask) within the watermark."""
    return ticks.withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "time", "bid", "ask"])


def _each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    trigger: Mapping[str, object], mode: str = "append",
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**trigger).foreachBatch(write).start()
    )


def write_live_ticks(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = HOURLY
) -> StreamingQuery:
    return (
        ticks.withColumn("date", F.to_date("time")).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .option("compression", "snappy").partitionBy("symbol", "date")
        .trigger(**trigger).start()
    )


def write_live_bars(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = HOURLY,
    delay: str = DEFAULT_DELAY,
) -> StreamingQuery:
    return (
        live_bars(ticks, delay).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .option("compression", "snappy").partitionBy("symbol")
        .trigger(**trigger).start()
    )


def write_live_stats(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = EACH_SECOND
) -> StreamingQuery:
    """The statistics of every symbol as a table that each batch replaces; ``latest_stats`` reads it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        replace_version(batch, path, batch_id)

    return _each_batch(live_stats(ticks), write, checkpoint, trigger, "complete")


def latest_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of the last batch that was written to its end."""
    return read_version(spark, path)


def split_late_rows(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = HOURLY, delay: str = DEFAULT_DELAY
) -> StreamingQuery:
    """Ticks that a bar can still take to the folder ``used``, the others to ``late``.

    A tick is late where the watermark, ``delay`` before the latest time of all earlier batches, has reached the end of its minute:
    a stream of bars would drop it without a word. The latest time is a table of one row that each batch replaces. ``live_bars``
    over ``used`` loses nothing, and used and late rows are all rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = f"{path}/seen"
        before = read_version(spark, seen, batch_id) if batch_id else spark.createDataFrame([(None,)], "seen timestamp")
        latest = before.first()["seen"]
        end = F.timestamp_seconds((F.floor(F.unix_micros("time") / 60_000_000) + 1) * 60)
        late = F.lit(False) if latest is None else F.coalesce(end <= F.lit(latest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        marked = batch.withColumn("late", late).persist()
        for folder, wanted in (("used", ~F.col("late")), ("late", F.col("late"))):
            marked.filter(wanted).drop("late").write.mode("overwrite").parquet(f"{path}/{folder}/batch_id={batch_id}")
        replace_version(marked.agg(F.max("time").alias("seen")).unionByName(before).agg(F.max("seen").alias("seen")), seen, batch_id)
        marked.unpersist()

    return _each_batch(ticks, write, checkpoint, trigger)


def flush(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = HOURLY
) -> StreamingQuery:
    """Two sinks in one pass: the batch's ticks and its statistics."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/ticks/batch_id={batch_id}")
        live_stats(kept).write.mode("overwrite").parquet(f"{path}/stats/batch_id={batch_id}")
        kept.unpersist()

    return _each_batch(ticks, write, checkpoint, trigger)


def is_valid_tick() -> Column:
    """A tick that can be processed: symbol, time and both prices are there and are numbers."""
    price = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("bid", "ask")]
    return F.col("symbol").isNotNull() & F.col("time").isNotNull() & price[0] & price[1]


def split_bad_rows(
    ticks: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = HOURLY
) -> StreamingQuery:
    """Valid and invalid rows to two folders; the invalid ones are the error count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("valid", F.coalesce(is_valid_tick(), F.lit(False))).persist()
        for folder, wanted in (("valid", F.col("valid")), ("invalid", ~F.col("valid"))):
            marked.filter(wanted).drop("valid").write.mode("overwrite").parquet(
                f"{path}/{folder}/batch_id={batch_id}")
        marked.unpersist()

    return _each_batch(ticks, write, checkpoint, trigger)


def route_messages(
    lines: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] = EACH_SECOND
) -> StreamingQuery:
    """JSON lines to one table of each message kind.

    A batch is decoded once and written in one job, into folders by kind under that of the batch, so either all kinds have the batch
    or none. Lines that cannot be read, and unknown types, go to the kind ``unknown`` with their text.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kinds = M.decode(batch).select(M.type_label(F.col("m.type")).alias("kind"), "m.*", F.col("value").alias("line"))
        kinds.withColumn("line", F.when(F.col("kind") == "unknown", F.col("line"))).write.mode("overwrite").partitionBy("kind").parquet(
            f"{path}/batch_id={batch_id}")

    return _each_batch(lines, write, checkpoint, trigger)


def routed_messages(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``route_messages`` by kind; each reads its own folders alone."""
    schema = T.StructType([*MESSAGE.fields, T.StructField("line", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("batch_id", T.LongType())])
    return M.route(spark.read.schema(schema).parquet(path))
