"""Queries that write tables or run streams and read the result back.

Each run writes under a fresh path of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.checks import sql as Q
from tickloom.checks.registry import query
from tickloom.checks.report_queries import MATCH_SQL, expected_symbols, message_fields, seconds
from tickloom.checks.tape_queries import SENT_SQL, SQL_BAR_ROWS, bar_rows, rounded, t
from tickloom.operators import messages as M
from tickloom.operators.ticks import concat
from tickloom.plans.collection import collect_history
from tickloom.session import scratch_path
from tickloom.sources import fixtures as fx
from tickloom.sources import tables
from tickloom.streaming import keyed, live
from tickloom.streaming.matching import match_signal_streams

def tick_columns() -> list:
    return ["tick_id", "symbol", t(), "bid", "ask", "last", "volume", "time_msc", "flags", "volume_real"]
_TICK_SQL = f"""WITH {Q.TICKS} SELECT tick_id, symbol, t, bid, ask, last, volume, time_msc, flags, volume_real FROM ticks"""


def landed(spark: SparkSession, sf: str) -> str:
    """Write the tape as a tick table and give its path."""
    path = scratch_path(spark, "ticks")
    tables.write_ticks(fx.ticks(spark, sf), path)
    return path


@query("scan_ticks", _TICK_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_ticks(spark, landed(spark, sf)).select(*tick_columns())


@query("scan_bars", f"WITH {Q.BARS} SELECT {SQL_BAR_ROWS} FROM bars")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bars")
    tables.write_bars(fx.bars(spark, sf), path)
    return bar_rows(tables.read_bars(spark, path, "M1"))


@query("collection_file_sizes", f"""WITH {Q.TICKS} SELECT symbol, true AS has_bytes FROM ticks GROUP BY symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The sizes themselves are compared with the file system in a test."""
    sizes = tables.file_sizes(tables.read_ticks(spark, landed(spark, sf)))
    return sizes.select("symbol", (F.col("file_size_mb") > 0).alias("has_bytes"))


@query("read_messages", f"""WITH {Q.MESSAGES} SELECT CAST(type AS INTEGER) AS type,
  CASE WHEN type IN (1, 2, 3) THEN symbol END AS symbol, CASE WHEN type = 2 THEN msg_id END AS request_id,
  CASE WHEN type = 1 THEN msg_id END AS volume, CASE WHEN type IN (1, 3) THEN CAST(direction AS INTEGER) END AS direction
FROM messages WHERE type <> 99""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    fields = message_fields(fx.messages(spark, sf))
    lines = [M.encode(fields.filter(F.col("type") == code), code).select("value") for code in (1, 2, 3, 6)]
    tables.write_messages(concat(lines), path)
    read = M.decode(tables.read_messages(spark, path))
    return read.select("m.type", "m.symbol", "m.request_id", F.col("m.volume").cast("long").alias("volume"), "m.direction")


@query("collect_history", f"""WITH {Q.TICKS}, dup AS (SELECT symbol, t, bid, ask, min(tick_id) AS tick_id FROM ticks GROUP BY symbol, t, bid, ask),
b AS (SELECT symbol, t // 60 * 60 AS t FROM dup GROUP BY symbol, t // 60),
s AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT DISTINCT 'missing_' || symbol FROM ticks)
SELECT s.symbol, (SELECT count(*) FROM dup WHERE dup.symbol = s.symbol) AS tick_rows,
  (SELECT min(t) FROM dup WHERE dup.symbol = s.symbol) AS tick_from, (SELECT max(t) FROM dup WHERE dup.symbol = s.symbol) AS tick_to,
  (SELECT count(*) FROM b WHERE b.symbol = s.symbol) AS bar_rows,
  (SELECT min(t) FROM b WHERE b.symbol = s.symbol) AS bar_from, (SELECT max(t) FROM b WHERE b.symbol = s.symbol) AS bar_to FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = collect_history(
        fx.duplicated_ticks(spark, sf), expected_symbols(spark, sf),
        scratch_path(spark, "ticks"), scratch_path(spark, "bars"))
    return out.select("symbol", "tick_rows", *seconds("tick_from", "tick_to"), "bar_rows", *seconds("bar_from", "bar_to"))


# --- streams --------------------------------------------------------------------------


def finish(stream) -> None:
    stream.awaitTermination()


@query("stream_ticks", _TICK_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "live-ticks")
    source = tables.stream_ticks(spark, landed(spark, sf))
    finish(live.write_live_ticks(source, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return tables.read_ticks(spark, out).select(*tick_columns())


@query("stream_bounded_intake", _TICK_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "live-ticks")
    source = tables.stream_ticks(spark, landed(spark, sf), files_per_batch=2)
    finish(live.write_live_ticks(source, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return tables.read_ticks(spark, out).select(*tick_columns())


# A bar is closed when the watermark (latest tick - 10 minutes) has reached its end.
@query("stream_minute_bars", f"""WITH {Q.BARS} SELECT {SQL_BAR_ROWS} FROM bars
WHERE t + 60 <= (SELECT max(t) FROM ticks) - 600""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "live-bars")
    source = tables.stream_ticks(spark, landed(spark, sf))
    finish(live.write_live_bars(source, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return bar_rows(spark.read.parquet(out))


@query("stream_symbol_stats", f"""WITH {Q.TICKS} SELECT symbol, count(*) AS total_ticks, max(t) AS last_tick_time,
  round(avg(ask - bid), 6) AS avg_spread FROM ticks GROUP BY symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "live-stats")
    source = tables.stream_ticks(spark, landed(spark, sf), files_per_batch=3)
    finish(live.write_live_stats(source, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return live.latest_stats(spark, out).select(
        "symbol", "total_ticks", *seconds("last_tick_time"), *rounded(["avg_spread"]))


@query("stream_unique_ticks", f"""WITH {Q.TICKS} SELECT DISTINCT symbol, t, bid, ask FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, out = scratch_path(spark, "ticks"), scratch_path(spark, "unique-ticks")
    tables.write_ticks(fx.duplicated_ticks(spark, sf), path)
    unique = live.unique_ticks(tables.stream_ticks(spark, path))
    finish(live.write_live_ticks(unique, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return tables.read_ticks(spark, out).select("symbol", t(), "bid", "ask")


@query("stream_flush", f"""WITH {Q.TICKS} SELECT symbol, count(*) AS stored, count(*) AS counted FROM ticks GROUP BY symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "flush")
    source = tables.stream_ticks(spark, landed(spark, sf), files_per_batch=3)
    finish(live.flush(source, out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    stored = spark.read.parquet(f"{out}/ticks").groupBy("symbol").agg(F.count(F.lit(1)).alias("stored"))
    counted = spark.read.parquet(f"{out}/stats").groupBy("symbol").agg(F.sum("total_ticks").alias("counted"))
    return stored.join(counted, "symbol")


@query("stream_bad_rows", f"""WITH {Q.TICKS} SELECT count(*) FILTER (tick_id % 13 <> 0) AS valid_rows,
  count(*) FILTER (tick_id % 13 = 0) AS errors FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, out = scratch_path(spark, "ticks"), scratch_path(spark, "routed")
    spoiled = F.when(F.col("tick_id") % 13 != 0, F.col("bid"))
    tables.write_ticks(fx.ticks(spark, sf).withColumn("bid", spoiled), path)
    finish(live.split_bad_rows(tables.stream_ticks(spark, path), out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    count = {name: spark.read.parquet(f"{out}/{name}").withColumn("kind", F.lit(name)) for name in ("valid", "invalid")}
    both = count["valid"].select("kind").unionAll(count["invalid"].select("kind"))
    return both.agg(
        F.count_if(F.col("kind") == "valid").alias("valid_rows"), F.count_if(F.col("kind") == "invalid").alias("errors"))


def land_in_steps(rows: DataFrame, step: F.Column, steps: range, path: str) -> None:
    """One file for each step, the first one oldest; its rows are read and chosen in all tasks."""
    for i in steps:
        rows.filter(step == i).repartition(1).write.mode("append").parquet(path)


@query("stream_sent_ticks", SENT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches in order of arrival, with a restart after the second."""
    path, out, state = scratch_path(spark, "ticks"), scratch_path(spark, "sent"), scratch_path(spark, "ckpt")
    ticks = fx.ticks(spark, sf).withColumn("date", F.to_date("time"))
    last = ticks.agg(F.max("tick_id")).first()[0]
    step = F.floor(F.col("tick_id") * 4 / F.lit(last + 1))
    for half in (range(2), range(2, 4)):
        land_in_steps(ticks, step, half, path)
        finish(keyed.send_ticks(tables.stream_ticks(spark, path, files_per_batch=1), out, state, live.CATCH_UP))
    return spark.read.parquet(f"{out}/sent").select("tick_id", "symbol", t(), "direction")


# --- messages as they come ------------------------------------------------------------------

_STEP_US = 6_480_000_000  # a quarter of the session
_END = "~end"  # a last message of each kind, two days later, so that time passes the others


def landed_messages(spark: SparkSession, sf: str) -> tuple[str, T.StructType]:
    """The message log in four files by time, and a fifth with the last messages."""
    path = scratch_path(spark, "message-rows")
    rows = fx.messages(spark, sf)
    land_in_steps(rows, F.expr(f"least((unix_micros(time) - {Q.BASE_US}) div {_STEP_US}, 3)"), range(4), path)
    ends = spark.range(2, 7).filter("id in (2, 3, 6)").select(
        (-F.col("id")).alias("msg_id"), F.timestamp_micros(F.lit(Q.BASE_US + 2 * 86_400_000_000)).alias("time"), F.col("id").cast("int").alias("type"),
        F.lit(_END).alias("symbol"))
    rows.limit(0).unionByName(ends, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def _message_stream(spark: SparkSession, landed_at: tuple[str, T.StructType], kind: int) -> DataFrame:
    return tables.stream_table(spark, *landed_at, files_per_batch=1).filter(F.col("type") == kind)


def _kept(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has written when it has caught up."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession, name)
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ckpt"))
           .trigger(**live.CATCH_UP).start())
    return spark.read.schema(stream.schema).parquet(out).filter(F.col("symbol") != _END)


@query("stream_match_signals", MATCH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    landed_at = landed_messages(spark, sf)
    found = match_signal_streams(_message_stream(spark, landed_at, 2), _message_stream(spark, landed_at, 3), "10 seconds")
    return _kept(found, "matched").drop("time")


_LIVE_SQL = f"""WITH {Q.MESSAGES}, beats AS (SELECT msg_id, symbol, us FROM messages WHERE type = 6),
g AS (SELECT *, lead(us) OVER o - us AS gap, us - lag(us) OVER o <= 60000000 AS goes_on FROM beats WINDOW o AS (PARTITION BY symbol ORDER BY us, msg_id)),
n AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY us, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM g)
"""


def _liveness(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Each symbol is a connection here."""
    beats = _message_stream(spark, landed_messages(spark, sf), 6)
    return _kept(keyed.liveness(beats, ["symbol"], "10 seconds"), "liveness").filter(F.col("kind") == kind)


@query("stream_heartbeat_gaps", _LIVE_SQL + """SELECT symbol, msg_id, round(CAST(gap / 1e6 AS DOUBLE), 6) AS gap_seconds, gap > 60000000 AS lost
FROM g WHERE gap IS NOT NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _liveness(spark, sf, "gap").select("symbol", "msg_id", *rounded(["gap_seconds"]), (F.col("gap_seconds") > 60).alias("lost"))


@query("stream_heartbeat_alarms", _LIVE_SQL + "SELECT symbol, msg_id, us AS last_us FROM g WHERE gap > 60000000 OR gap IS NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _liveness(spark, sf, "alarm").select("symbol", "msg_id", F.unix_micros("time").alias("last_us"))


@query("stream_live_spans", _LIVE_SQL + "SELECT symbol, min(us) AS since, max(us) AS until, count(*) AS beats FROM n GROUP BY symbol, span")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _liveness(spark, sf, "span").select("symbol", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "beats")


# Every 17th tick comes two steps late.
@query("stream_late_rows", f"""WITH {Q.TICKS}, d AS (SELECT tick_id, t, least((t - {Q.BASE_US // 1_000_000}) // {_STEP_US // 1_000_000}, 3) + CASE WHEN tick_id % 17 = 0 THEN 2 ELSE 0 END AS step FROM ticks),
seen AS (SELECT s.step, (SELECT max(t) FROM d WHERE d.step < s.step) - 600 AS mark FROM (SELECT DISTINCT step FROM d) s)
SELECT tick_id, coalesce((t // 60 + 1) * 60 <= mark, false) AS late FROM d JOIN seen USING (step)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, out = scratch_path(spark, "ticks"), scratch_path(spark, "split")
    ticks = fx.ticks(spark, sf).withColumn("date", F.to_date("time"))
    own = F.expr(f"least((unix_micros(time) - {Q.BASE_US}) div {_STEP_US}, 3)")
    land_in_steps(ticks, own + F.when(F.col("tick_id") % 17 == 0, 2).otherwise(0), range(6), path)
    finish(live.split_late_rows(tables.stream_ticks(spark, path, files_per_batch=1), out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    parts = [spark.read.schema(ticks.schema).parquet(f"{out}/{name}").select("tick_id", F.lit(name == "late").alias("late")) for name in ("used", "late")]
    return parts[0].unionByName(parts[1])


@query("stream_route_messages", f"""WITH {Q.MESSAGES} SELECT CASE type WHEN 1 THEN 'tick_data' WHEN 2 THEN 'signal_request' WHEN 3 THEN 'signal_response'
  WHEN 6 THEN 'status_update' ELSE 'unknown' END AS kind, CASE WHEN type IN (1, 2, 3) THEN symbol END AS symbol,
  CASE WHEN type IN (1, 2) THEN msg_id END AS id, CASE WHEN type = 99 THEN 'unreadable #' || msg_id END AS line FROM messages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of four kinds and unreadable ones, landed in three parts and taken in as many batches, to tables by kind."""
    path, out = scratch_path(spark, "messages"), scratch_path(spark, "routed")
    fields = message_fields(fx.messages(spark, sf))
    lines = concat([M.encode(fields.filter(F.col("type") == code), code).select("msg_id", "value") for code in (1, 2, 3, 6)] + [
        fields.filter("type = 99").select("msg_id", F.concat(F.lit("unreadable #"), F.col("msg_id").cast("string")).alias("value"))])
    for i in range(3):
        # In as many files as there are tasks: no task reads or writes a whole part.
        lines.filter(F.col("msg_id") % 3 == i).select("value").write.mode("append").text(path)
    batch = -(-len(tables.read_messages(spark, path).inputFiles()) // 3)
    finish(live.route_messages(tables.stream_messages(spark, path, files_per_batch=batch), out, scratch_path(spark, "ckpt"), live.CATCH_UP))
    return concat([
        table.select(F.lit(kind).alias("kind"), "symbol", F.coalesce(F.col("request_id"), F.col("volume").cast("long")).alias("id"), "line")
        for kind, table in live.routed_messages(spark, out).items()])


# --- raw dumps ---------------------------------------------------------------------------------


@query("raw_ticks", f"""WITH {Q.TICKS}, raw AS (SELECT *, row_number() OVER (ORDER BY symbol, t // 7200, tick_id) - 1 AS arrival FROM ticks)
SELECT arrival AS tick_id, symbol, t, bid, ask, last, volume, time_msc, flags, volume_real FROM raw""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Dumps by symbol and two hours, without ids, symbols or times but for epoch seconds."""
    path = scratch_path(spark, "raw")
    dumps = fx.ticks(spark, sf).withColumn("time", F.unix_seconds("time")).withColumn("part", F.expr("time div 7200"))
    dumps.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "tick_id").drop("tick_id").write.partitionBy("symbol", "part").parquet(path)
    return tables.read_raw_ticks(spark, path).select(*tick_columns())
