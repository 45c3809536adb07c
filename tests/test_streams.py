"""Streams over several batches, restarts, late and odd rows; raw dumps; small replaced tables."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_windows import frame, tape
from tickloom import session
from tickloom.operators import joins as J
from tickloom.operators import messages as M
from tickloom.operators import ticks as K
from tickloom.operators.ordered import by_arrival
from tickloom.session import scratch_path
from tickloom.sources import tables
from tickloom.streaming import keyed, live
from tickloom.streaming.matching import match_signal_streams

T0 = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def land(spark, parts, schema, path):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(**live.CATCH_UP).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


# --- sent ticks --------------------------------------------------------------------------


def test_sent_ticks_over_batches_and_a_restart(spark):
    source, out, state = scratch_path(spark, "in"), scratch_path(spark, "sent"), scratch_path(spark, "ckpt")
    full = frame(spark, tape(11, 300, [0, 1000, 7000, 4_000_000])).withColumns({
        "time_msc": F.lit(0).cast("long"), "flags": F.lit(0), "volume_real": F.lit(1.0), "date": F.to_date("time")})
    for lo in range(0, 300, 60):
        full.filter(F.col("tick_id").between(lo, lo + 59)).coalesce(1).write.mode("append").parquet(source)
        if lo in (60, 180, 240):  # the stream stops and starts again where it was
            keyed.send_ticks(tables.stream_ticks(spark, source, files_per_batch=1), out, state, live.CATCH_UP).awaitTermination()
    want = K.sent_direction(K.newer_only(full, by_arrival()), by_arrival())
    assert rows(spark.read.parquet(f"{out}/sent"), "tick_id", "direction") == rows(want, "tick_id", "direction")


def test_ticks_without_keys_are_not_sent(spark):
    schema = "tick_id long, symbol string, time timestamp, last double"
    second = lambda n: T0 + dt.timedelta(seconds=n)
    path = scratch_path(spark, "in")
    land(spark, [
        [(1, "a", second(1), 5.0), (2, None, second(2), 5.0), (3, "a", None, 5.0), (None, "a", second(3), 5.0), (4, "a", second(1), 9.0)],
        [(5, "a", second(4), None), (6, "a", second(5), 4.0), (7, "a", second(5), 1.0), (8, "a", second(3), 1.0)],
    ], schema, path)
    sent = drain(keyed.sent_ticks(tables.stream_table(spark, path, spark.read.parquet(path).schema, 1)), scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert rows(sent, "tick_id", "direction") == [(1, 0), (5, 0), (6, 0)]


# --- liveness ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_liveness_equals_the_batch_forms(spark, seed):
    """Heartbeats out of order within the delay, in batches of any size."""
    draw = random.Random(seed)
    beats, at = [], {"a": 0.0, "b": 0.0}
    for i in range(240):
        who = draw.choice("aab")
        at[who] += draw.choice([1, 20, 59.999999, 60, 60.000001, 61, 200])
        beats.append((i, who, T0 + dt.timedelta(seconds=at[who])))
    beats.sort(key=lambda b: b[2] + dt.timedelta(seconds=draw.uniform(0, 25)))  # as they arrive
    parts = [beats[i:i + 50] for i in range(0, 240, 50)] + [[(-1, "end", T0 + dt.timedelta(days=3))]]
    schema, path = "msg_id long, who string, time timestamp", scratch_path(spark, "beats")
    land(spark, parts, schema, path)
    stream = tables.stream_table(spark, path, spark.read.parquet(path).schema, 1)
    got = drain(keyed.liveness(stream, ["who"], "30 seconds"), scratch_path(spark, "o"), scratch_path(spark, "c")).filter("who != 'end'")
    batch = spark.createDataFrame(beats, schema)
    gaps = M.heartbeat_gaps(batch, F.lit(T0 + dt.timedelta(days=3)), keys=["who"])
    known = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("who").orderBy(F.desc("time"), F.desc("msg_id"))))
    assert rows(got.filter("kind = 'gap'"), "who", "msg_id", F.round("gap_seconds", 6)) == rows(known.filter("rank > 1"), "who", "msg_id", F.round("gap_seconds", 6))
    assert rows(got.filter("kind = 'alarm'"), "who", "msg_id") == rows(gaps.filter("lost"), "who", "msg_id")
    spans = M.live_spans(batch, keys=["who"])
    assert rows(got.filter("kind = 'span'"), "who", "since", "until", "beats") == rows(spans, "who", "since", "until", "beats")


def test_an_alarm_needs_no_further_heartbeat():
    connection = keyed._Connection(60_000_000, None)
    connection.waiting = [(0, 1), (30_000_000, 2)]
    connection.settle(40_000_000)
    assert [e[0] for e in connection.events] == ["gap"] and connection.next_look(40_000_000) == 90_000_001
    connection.settle(90_000_000)
    assert len(connection.events) == 1
    connection.settle(90_000_001)
    assert [e[0] for e in connection.events] == ["gap", "alarm", "span"] and connection.next_look(90_000_001) is None
    again = keyed._Connection(60_000_000, connection.saved())
    again.waiting = [(200_000_000, 3)]
    again.settle(200_000_000)
    assert [(e[0], e[1], e[3]) for e in again.events] == [("gap", 2, 170.0)] and (again.since, again.beats) == (200_000_000, 1)


# --- requests and responses ----------------------------------------------------------------


def test_matched_streams_equal_the_batch_form(spark):
    draw = random.Random(9)
    schema = "msg_id long, symbol string, time timestamp, type int, direction int, confidence double"
    log = [(i, draw.choice("ab"), T0 + dt.timedelta(seconds=round(3590 + i * 0.11, 2)), draw.choice([2, 3]), draw.choice([-1, 0, 1]), 0.5) for i in range(400)]
    log += [(900, None, T0 + dt.timedelta(seconds=3600), 2, 0, 0.5), (901, "a", None, 2, 0, 0.5)]
    end = [(-2, "end", T0 + dt.timedelta(days=2), 2, 0, 0.0), (-3, "end", T0 + dt.timedelta(days=2), 3, 0, 0.0)]
    path = scratch_path(spark, "log")
    land(spark, [log[:150], log[150:], end], schema, path)
    of = lambda kind: tables.stream_table(spark, path, spark.read.parquet(path).schema, 1).filter(F.col("type") == kind)
    got = drain(match_signal_streams(of(2), of(3), "5 seconds"), scratch_path(spark, "o"), scratch_path(spark, "c"))
    batch = spark.createDataFrame(log, schema).filter("symbol is not null and time is not null")
    want = J.match_signals(batch.filter("type = 2"), batch.filter("type = 3"))
    columns = ("msg_id", "symbol", "time", F.coalesce("response_id", F.lit(-1)), F.coalesce("direction", F.lit(9)), "timed_out")
    assert rows(got, *columns) == rows(want, *columns) and want.filter("timed_out").count() > 0


def test_matched_streams_hold_short_slices(spark):
    """The join compares a request with all responses of its slice."""
    log = spark.readStream.format("rate").load().selectExpr(
        "value as msg_id", "'a' as symbol", "timestamp as time", "1 as direction", "1D as confidence")
    for seconds in (1, 5):
        plan = match_signal_streams(log, log, "5 seconds", seconds)._jdf.queryExecution().analyzed().toString()
        assert str(2_000_000 * seconds) in plan and "3600000000" not in plan


def test_landed_steps_and_messages_are_written_by_all_tasks(spark, monkeypatch):
    """No single task reads the whole table."""
    from tickloom.checks import stored_queries
    from tickloom.checks.registry import QUERIES
    table = spark.range(0, 3000, 1, 4).selectExpr(
        "id as msg_id", "timestamp_seconds(1704067200 + id) as time", "cast(case id % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 6 else 99 end as int) as type",
        "'a' as symbol", "cast(id % 3 - 1 as int) as direction", "0.5D as confidence", "1D as value")
    monkeypatch.setattr(stored_queries.fx, "messages", lambda spark, sf: table)
    folders = []
    monkeypatch.setattr(stored_queries, "scratch_path", lambda spark, label: folders.append(scratch_path(spark, label)) or folders[-1])
    out = QUERIES["stream_route_messages"].build(spark, "")
    assert out.count() == 3000 and len(spark.read.text(folders[0]).inputFiles()) > 3
    assert len(glob.glob(f"{folders[1]}/batch_id=*")) == 3


# --- sinks ---------------------------------------------------------------------------------


def test_statistics_are_one_table_however_many_batches(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    for batch in range(40):
        tables.replace_version(spark.createDataFrame([("a", batch)], "symbol string, n int").coalesce(1), path, batch)
    assert len(glob.glob(f"{tmp_path}/stats/version=*")) == 2
    assert tables.read_version(spark, path).collect() == [("a", 39)]
    # A version that was not written to its end does not count, and is overwritten when its batch runs again.
    os.makedirs(tmp_path / "stats" / "version=40")
    assert tables.read_version(spark, path).collect() == [("a", 39)]
    tables.replace_version(spark.createDataFrame([("a", 40)], "symbol string, n int"), path, 40)
    assert tables.read_version(spark, path).collect() == [("a", 40)] and tables.read_version(spark, path, below=40).collect() == [("a", 39)]
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, f"file://{tmp_path}/none")


def test_late_rows_are_those_a_bar_stream_drops(spark):
    """Bars over the used rows hold every one of them, and no row is lost."""
    schema = T._parse_datatype_string("tick_id long, symbol string, time timestamp, bid double, ask double, volume_real double")
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    tick = lambda i, when: (i, "a", when, 1.0, 2.0, 1.0)
    path, out = scratch_path(spark, "ticks"), scratch_path(spark, "split")
    land(spark, [
        [tick(1, at(0)), tick(2, at(15))], [tick(3, at(4.5)), tick(4, at(3.9)), tick(5, at(5)), tick(6, None)], [tick(7, at(40)), tick(8, at(6))], [tick(9, at(29)), tick(10, at(29.999))],
        [tick(11, at(300))],
    ], schema, path)
    live.split_late_rows(tables.stream_table(spark, path, schema, 1), out, scratch_path(spark, "c"), live.CATCH_UP).awaitTermination()
    read = lambda name: spark.read.schema(schema).parquet(f"{out}/{name}")
    # The watermark is 5 minutes in the second batch, 5 in the third, 30 in the fourth.
    assert [r[0] for r in rows(read("late"), "tick_id")] == [3, 4, 9, 10]
    assert read("used").count() + read("late").count() == 11
    assert len(glob.glob(out.removeprefix("file://") + "/seen/version=*")) == 2


def test_routing_keeps_every_line(spark):
    path, out = scratch_path(spark, "lines"), scratch_path(spark, "routed")
    lines = ['{"type":2,"symbol":"A","request_id":7}', "not json", '{"type":55,"symbol":"B"}', "", '{"type":99,"symbol":"C"}', '{"type":null}']
    for line in lines:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
    for _ in range(2):  # a second start finds nothing new
        live.route_messages(tables.stream_messages(spark, path, 2), out, out + "-state", live.CATCH_UP).awaitTermination()
    kinds = live.routed_messages(spark, out)
    assert {k: d.count() for k, d in kinds.items() if d.count()} == {"signal_request": 1, "unknown": 4, "error": 1}
    assert rows(kinds["signal_request"], "symbol", "request_id") == [("A", 7)]
    assert sorted(r["line"] for r in kinds["unknown"].collect()) == sorted([lines[1], lines[2], lines[3], lines[5]])


# --- files -----------------------------------------------------------------------------------


def test_raw_dumps_over_several_files(spark):
    path = scratch_path(spark, "raw")
    schema = tables.RAW_TICKS
    for symbol, name, n in (("B+1 x", "1", 3), ("A", "2", 4), ("A", "1", 2)):
        ticks = [(1_700_000_000 + i, 1.0, 2.0, 1.5, i, 0, 0, 1.0) for i in range(n)]
        spark.createDataFrame(ticks, schema).coalesce(1).write.parquet(f"{path}/symbol={symbol}/part={name}")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{path}/symbol=C/part=1")
    got = tables.read_raw_ticks(spark, path)
    assert rows(got, "tick_id", "symbol", "volume") == [(0, "A", 0), (1, "A", 1), *[(2 + i, "A", i) for i in range(4)], *[(6 + i, "B+1 x", i) for i in range(3)]]
    assert got.filter("tick_id = 0").select(F.unix_seconds("time")).first()[0] == 1_700_000_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_file_sizes_are_those_on_disk(spark):
    path = scratch_path(spark, "ticks")
    full = frame(spark, tape(11, 300, [0, 1000, 7000, 4_000_000])).withColumns({"time_msc": F.lit(0).cast("long"), "flags": F.lit(0), "volume_real": F.lit(1.0)})
    tables.write_ticks(full, path)
    want = {}
    for file in glob.glob(path.removeprefix("file://") + "/symbol=*/date=*/*.parquet"):
        symbol = file.split("symbol=")[1].split("/")[0]
        want[symbol] = want.get(symbol, 0) + os.path.getsize(file)
    got = {r["symbol"]: r["file_size_mb"] for r in tables.file_sizes(tables.read_ticks(spark, path)).collect()}
    assert got == {s: n / (1024 * 1024) for s, n in want.items()} and len(got) == 2


def test_scratch_is_removed_on_request(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])
    paths = [session.scratch_path(spark, "left") for _ in range(2)]
    for path in paths:
        spark.range(3).write.parquet(path)
    assert session.remove_scratch(spark) == 2 and session.remove_scratch(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
