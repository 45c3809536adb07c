"""Typed JSON messages as tables: encode, decode, route, count, liveness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators.ordered import (
    SLICE_SECONDS, Axis, by_time, position, previous, running, time_slice,
)
from tickloom.schemas import MESSAGE, SIGNAL

# Message type codes and the field order of each message kind.
MESSAGE_TYPES = {
    1: "tick_data", 2: "signal_request", 3: "signal_response", 4: "order_request",
    5: "order_response", 6: "status_update", 7: "config_update", 99: "error",
}
FIELDS = {
    1: ("symbol", "time", "bid", "ask", "last", "volume", "spread", "direction"),
    2: ("symbol", "request_id"),
    3: ("symbol", "direction", "confidence"),
    4: ("symbol", "operation", "volume", "price", "sl", "tp", "comment", "magic"),
    6: ("status", "details", "expert_id"),
    7: ("key", "value"),
}
DOUBLE_FORMAT = "%.8f"
ERROR_TYPE = 99
SENT_TYPES = (1, 2, 5, 6)
HEARTBEAT_LIMIT_SECONDS = 60


def _json_field(df: DataFrame, name: str) -> Column:
    """``"name":value``; doubles with eight decimals, strings escaped by ``to_json``."""
    kind = dict(df.dtypes)[name]
    if kind == "double":
        # JSON has no word for what is not a finite number.
        finite = F.abs(F.col(name)) < F.lit(float("inf"))
        text = F.when(finite, F.format_string(DOUBLE_FORMAT, F.col(name)))
    elif kind == "string":
        quoted = F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        text = F.when(F.col(name).isNotNull(), quoted)
    else:
        text = F.col(name).cast("string")
    return F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null")))


def encode(df: DataFrame, type_code: int) -> DataFrame:
    """Rows to JSON lines of one message kind in the column ``value``, other columns kept.

    ``sent_at`` gives the message timestamp. Nulls and doubles that are not finite are
    written as ``null``; the type is always there.
    """
    stamp = F.coalesce(F.concat(F.lit('"'), S.stamp(F.col("sent_at")), F.lit('"')), F.lit("null"))
    head = F.concat(F.lit(f'"type":{type_code},"timestamp":'), stamp)
    parts = [head, *[_json_field(df, n) for n in FIELDS[type_code]]]
    return df.withColumn("value", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def decode(lines: DataFrame) -> DataFrame:
    """Every line with its fields; unreadable lines give nulls."""
    return lines.withColumn("m", F.from_json("value", MESSAGE))


def decode_signals(lines: DataFrame) -> DataFrame:
    """Signal responses as (symbol, direction, confidence); other lines are left out."""
    parsed = F.from_json("value", SIGNAL)
    rest = [c for c in lines.columns if c != "value"]
    return (
        lines.withColumn("m", parsed).filter(F.col("m.type") == 3)
        .select(*rest, "m.symbol", "m.direction", "m.confidence")
    )


def type_label(code: Column) -> Column:
    pairs = [F.lit(x) for item in MESSAGE_TYPES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("unknown"))


def route(messages: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per message kind, and ``unknown``. Where the table has a ``kind``, that is what its folders are named by."""
    kind = F.col("kind") if "kind" in messages.columns else type_label(F.col("type"))
    return {label: messages.filter(kind == label) for label in (*MESSAGE_TYPES.values(), "unknown")}


def message_stats(messages: DataFrame) -> DataFrame:
    """Messages, sent and received ones and errors per type, and in total (``is_total``).

    What the library's side of the line sends (``SENT_TYPES``) counts as sent.
    """
    sent = F.coalesce(F.col("type").isin(*SENT_TYPES), F.lit(False))
    marked = messages.withColumns({"_sent": sent, "_error": F.coalesce(F.col("type") == ERROR_TYPE, F.lit(False))})
    return marked.rollup("type").agg(
        (F.grouping_id() == 1).alias("is_total"), F.count(F.lit(1)).alias("messages"), F.count_if("_sent").alias("sent"),
        F.count_if(~F.col("_sent")).alias("received"), F.count_if("_error").alias("errors"),
    )


def heartbeat_gaps(
    beats: DataFrame, as_of: Column, limit_seconds: int = HEARTBEAT_LIMIT_SECONDS,
    slice_seconds: int = SLICE_SECONDS, keys: Sequence[str] = (),
) -> DataFrame:
    """Each heartbeat with the seconds to the next one (the last one: to ``as_of``) and
    whether the connection counts as lost in between. ``keys`` names a connection; without, all are one."""
    # Newest first, so "the row before" is the next heartbeat.
    axis = Axis(
        -time_slice(slice_seconds), ("_back", "_back_id"), tuple(keys), position(F.col("_back"), F.col("_back_id")))
    keyed = beats.withColumns({
        "_back": -F.unix_micros("time"), "_back_id": -F.col("msg_id"), "_t": F.unix_micros("time")})
    out = previous(keyed, {"_after": F.col("_t")}, axis)
    gap = (F.coalesce(F.col("_after"), F.unix_micros(as_of)) - F.col("_t")) / F.lit(1e6)
    return out.withColumn("gap_seconds", gap).withColumn(
        "lost", F.col("gap_seconds") > limit_seconds).drop("_back", "_back_id", "_t", "_after")


def live_spans(
    beats: DataFrame, limit_seconds: int = HEARTBEAT_LIMIT_SECONDS, slice_seconds: int = SLICE_SECONDS, keys: Sequence[str] = ()
) -> DataFrame:
    """Spans of heartbeats with no gap beyond the limit.

    A keyless session window would run in one task; a running count of span starts
    does not.
    """
    axis = by_time(keys=keys, order=("time", "msg_id"), seconds=slice_seconds)
    spaced = previous(beats.select(*keys, "time", "msg_id"), {"_before": F.unix_micros("time")}, axis)
    starts = F.col("_before").isNull() | (F.unix_micros("time") - F.col("_before") > limit_seconds * 1_000_000)
    numbered = running(spaced.withColumn("_starts", starts.cast("long")), axis, sums={"span": F.col("_starts")})
    return numbered.groupBy(*keys, "span").agg(
        F.min("time").alias("since"), F.max("time").alias("until"), F.count(F.lit(1)).alias("beats"))
