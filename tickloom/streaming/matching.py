"""Requests and responses that come as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.joins import SIGNAL_TIMEOUT_SECONDS
from tickloom.operators.ordered import SLICE


def match_signal_streams(
    requests: DataFrame,
    responses: DataFrame,
    delay: str,
    timeout_seconds: int = SIGNAL_TIMEOUT_SECONDS,
    slice_seconds: int | None = None,
) -> DataFrame:
    """``joins.match_signals`` of two streams: each request once, with its first response or as timed out.

    An interval join keeps both sides until the watermarks (``delay`` behind the latest time of either) show that nothing can
    match any more; a request without a match comes out when its state expires, and an aggregation by request, closed by the same watermark,
    keeps the first of several. State is dealt by (symbol, slice), so a busy symbol spreads over tasks; a response close
    behind a slice boundary is also held in the slice before it. The join compares a request with every response of its slice, so slices
    are short: twice the time-out where nothing else is asked for. A request without symbol, time or id has no answer to wait
    for and is left out.
    """
    slot, span = (slice_seconds or 2 * timeout_seconds) * 1_000_000, timeout_seconds * 1_000_000
    placed = "symbol IS NOT NULL AND time IS NOT NULL AND msg_id IS NOT NULL"
    asked = requests.filter(placed).withWatermark("time", delay).select(
        "msg_id", "symbol", "time", F.floor(F.unix_micros("time") / slot).alias(SLICE))
    at = F.unix_micros("answered_at")
    answered = responses.filter(placed).select(
        F.col("symbol").alias("_symbol"), F.col("time").alias("answered_at"), F.col("msg_id").alias("_response"), "direction", "confidence",
    ).withWatermark("answered_at", delay).select("*", F.explode(F.array_distinct(
        F.array(F.floor(at / slot), F.floor((at - span) / slot)))).alias("_answer_slice"))
    pairs = asked.join(
        answered,
        (F.col("symbol") == F.col("_symbol")) & (F.col(SLICE) == F.col("_answer_slice")) & (F.col("answered_at") > F.col("time"))
        & (F.col("answered_at") <= F.col("time") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")), "left")
    first = F.min(F.when(F.col("_response").isNotNull(), F.struct(
        F.col("answered_at").alias("at"), F.col("_response").alias("id"), "direction", "confidence"))).alias("_first")
    return pairs.groupBy("msg_id", "symbol", "time").agg(first).select(
        "msg_id", "symbol", "time", F.col("_first.id").alias("response_id"), F.col("_first.direction").alias("direction"),
        F.col("_first.confidence").alias("confidence"), F.col("_first").isNull().alias("timed_out"))
