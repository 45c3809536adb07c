"""Tick, bar and message tables that Spark derives from the ``events`` table.

The rules give a market-like tape: five symbols, several ticks in one second,
prices on a grid with some outliers, a long tail of volumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators import bars as bar_ops
from tickloom.session import configure

# Start of the session (2024-01-01 UTC, microseconds), time compression.
BASE_US = 1_704_067_200_000_000
COMPRESSION = 100


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    # Files carry zoneless times; cast once, as watermarks need instants.
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _session_micros() -> F.Column:
    return F.expr(f"{BASE_US} + (unix_micros(ts) - {BASE_US}) div {COMPRESSION}")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"us": _session_micros(), "k": _k()})
    last = (
        F.lit(1000.0) + F.lit(0.5) * (F.col("k") % 20)
        + F.when(F.col("event_id") % 7 == 0, 0.25).otherwise(0.0)
    )
    volume = F.lit(1).cast("long") + F.floor("value")
    return e.select(
        F.col("event_id").alias("tick_id"),
        F.col("event_type").alias("symbol"),
        F.timestamp_seconds(F.expr("us div 1000000")).alias("time"),
        (last - F.lit(0.5) * (1 + F.col("event_id") % 3)).alias("bid"),
        (last + F.lit(0.5)).alias("ask"),
        last.alias("last"),
        volume.alias("volume"),
        F.expr("us div 1000").alias("time_msc"),
        (F.col("event_id") % 8).cast("int").alias("flags"),
        volume.cast("double").alias("volume_real"),
    )


def duplicated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with every eleventh tick delivered a second time."""
    base = ticks(spark, sf_dir)
    again = base.filter(F.col("tick_id") % 11 == 0).withColumn("tick_id", F.col("tick_id") + 10_000_000)
    return base.unionByName(again)


def ticks_with_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape where every tenth row lacks its symbol, its time or its id; ``row_id`` keeps the id."""
    part = F.col("tick_id") % 30
    return ticks(spark, sf_dir).withColumn("row_id", F.col("tick_id")).withColumns({
        "symbol": F.when(part != 0, F.col("symbol")), "time": F.when(part != 10, F.col("time")),
        "tick_id": F.when(part != 20, F.col("tick_id")),
    })


def ticks_with_bad_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape where every 101st tick has a price that is infinite, no number, missing or huge; some also lack the volume."""
    kind = F.when(F.col("tick_id") % 101 == 0, F.expr("tick_id div 101 % 8"))
    bad = lambda column, values: F.coalesce(
        *[F.when(kind == k, F.lit(v)) for k, v in values.items() if v is not None],
        F.when(~F.coalesce(kind.isin(*[k for k, v in values.items() if v is None]), F.lit(False)), F.col(column)))
    inf, nan = float("inf"), float("nan")
    return ticks(spark, sf_dir).withColumns({
        "bid": bad("bid", {0: inf, 4: None, 6: 1e12}), "ask": bad("ask", {1: nan, 5: -inf}),
        "last": bad("last", {2: inf, 3: nan, 5: None, 7: 1e12}), "volume": bad("volume", {4: None}),
    })


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.minute_bars(ticks(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows: id, instant, message type and the fields that type carries."""
    kind = F.col("event_type")
    code = (
        F.when(kind == "click", 1).when(kind == "purchase", 2).when(kind == "signup", 3)
        .when(kind == "view", 6).when(kind == "error", 99)
    )
    return (
        events(spark, sf_dir)
        .withColumns({"us": _session_micros(), "k": _k()})
        .select(
            F.col("event_id").alias("msg_id"),
            F.timestamp_micros("us").alias("time"),
            code.alias("type"),
            F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
            (F.col("k") % 3 - 1).alias("direction"),
            (F.col("k") / F.lit(100.0)).alias("confidence"),
            F.col("value"),
        )
    )
