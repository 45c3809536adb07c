"""Joins on time, on keys and on small dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators.bars import ATR_PERIODS, with_atr
from tickloom.operators.ordered import SLICE, SLICE_SECONDS, Axis, last_known_cut, time_slice

# Suffixes a symbol may be listed under, in order of preference.
SYMBOL_SUFFIXES = ("", ".SIR", ".BMF", ".WDO")
SIGNAL_TIMEOUT_SECONDS = 1


def asof_bars(
    ticks: DataFrame,
    bars: DataFrame,
    columns: Sequence[str],
    closed_bars_only: bool = False,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Give each tick ``columns`` of its symbol's latest bar with time <= tick time.

    A left join: a tick without symbol or time stays and sees no bar. A bar carries its opening
    time, so a tick sees the minute it lies in;
    ``closed_bars_only`` lets a bar be seen only after its end. Union and running
    last value inside (symbol, slice); a slice starts from the last bar before it.
    """
    visible = F.col("time")
    if closed_bars_only:
        length = F.create_map(*[F.lit(x) for item in S.TIMEFRAME_SECONDS.items() for x in item])
        visible = F.timestamp_micros(F.unix_micros("time") + length[F.col("timeframe")] * 1_000_000)
    packed = F.struct(F.col("time").alias("bar_time"), *columns)
    right = bars.where("symbol IS NOT NULL AND time IS NOT NULL").select("symbol", visible.alias("time"), F.lit(0).alias("_side"), packed.alias("_bar"))
    left = ticks.withColumn("_side", F.lit(1))
    cut = time_slice(slice_seconds)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(SLICE, cut)

    # Last bar per slice: from the bars alone, with empty slices taken from the ticks.
    tails = (
        right.withColumn(SLICE, cut).select("symbol", SLICE, "time", "_bar")
        .unionByName(
            ticks.withColumn(SLICE, cut).select("symbol", SLICE).distinct(), allowMissingColumns=True)
        .groupBy("symbol", SLICE).agg(F.max_by("_bar", "time").alias("_l0"))
    )
    axis = Axis(cut, ("time", "_side", "tick_id"), ("symbol",), F.col("tick_id"))
    known = last_known_cut(both, {"_bar": F.col("_bar")}, axis, tails)
    return known.filter(F.col("_side") == 1).select(
        *ticks.columns, F.col("_bar.bar_time").alias("bar_time"), *[F.col("_bar")[c].alias(c) for c in columns]
    )


BAR_CONTEXT = (
    "ohlc_range", "ohlc_body", "upper_shadow", "lower_shadow", "price_position_in_range",
    *[f"atr_{p}" for p in ATR_PERIODS],
)


def with_bar_context(
    ticks: DataFrame, bars: DataFrame, closed_bars_only: bool = False, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Range, body, shadows, price position and mean true range of each tick's bar."""
    dressed = S.with_bar_geometry(with_atr(bars))
    columns = ["high", "low", "range", "body", "upper_shadow", "lower_shadow", *[f"atr_{p}" for p in ATR_PERIODS]]
    own = [c for c in ticks.columns]
    out = asof_bars(ticks, dressed, columns, closed_bars_only, slice_seconds)
    reach = F.when(F.col("range") == 0, F.lit(1.0)).otherwise(F.col("range"))
    return out.withColumn(
        "price_position_in_range", (F.col("last") - F.col("low")) / reach
    ).withColumnsRenamed({"range": "ohlc_range", "body": "ohlc_body"}).select(*own, *BAR_CONTEXT)


def join_features(base: DataFrame, *sets: DataFrame, key: str = "tick_id") -> DataFrame:
    """Left join of separately stored feature tables on the unique tick key."""
    out = base
    for features in sets:
        out = out.join(features.drop(*[c for c in ("symbol", "time") if c in features.columns]), key, "left")
    return out


def resolve_symbols(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """The first listed form of each wanted symbol; null where none is listed."""
    forms = wanted.select("symbol", F.posexplode(F.array(
        *[F.concat(F.col("symbol"), F.lit(s)) for s in SYMBOL_SUFFIXES])).alias("priority", "candidate"))
    listed = available.select(F.col("symbol").alias("candidate")).distinct()
    found = forms.join(listed, "candidate").groupBy("symbol").agg(
        F.min_by("candidate", "priority").alias("resolved"))
    return wanted.join(found, "symbol", "left")


def with_symbol_info(df: DataFrame, info: DataFrame) -> DataFrame:
    """Metadata lookup. No hint: Spark broadcasts the dimension when its size allows,
    and splits a hot symbol of a shuffled join otherwise."""
    return df.join(info, "symbol", "left")


def match_signals(
    requests: DataFrame,
    responses: DataFrame,
    timeout_seconds: int = SIGNAL_TIMEOUT_SECONDS,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """First response of the symbol after each request, within the timeout; else a timeout.

    Both sides need msg_id, symbol and time; responses also direction and
    confidence. No pairs are formed: rows of (symbol, slice) are read newest first and the
    last response seen is the next one. A response close behind a slice boundary is
    copied to the slice before it.
    """
    span = timeout_seconds * 1_000_000
    slot = slice_seconds * 1_000_000
    answer = F.struct(F.col("msg_id").alias("id"), F.col("time").alias("at"), "direction", "confidence")
    us = F.unix_micros("time")
    right = responses.select(
        "symbol", "time", "msg_id", F.lit(1).alias("_side"), answer.alias("_answer"),
        F.explode(F.array_distinct(F.array(F.floor(us / slot), F.floor((us - span) / slot)))).alias(SLICE),
    )
    left = requests.select(
        "symbol", "time", "msg_id", F.lit(0).alias("_side"), F.floor(us / slot).alias(SLICE))
    newest_first = Window.partitionBy("symbol", SLICE).orderBy(
        F.col("time").desc(), F.col("_side"), F.col("msg_id").desc())
    seen = F.last("_answer", ignorenulls=True).over(
        newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_next", seen)
    in_time = F.unix_micros("_next.at") <= F.unix_micros("time") + span
    return (
        both.filter(F.col("_side") == 0)
        .withColumn("_next", F.when(in_time, F.col("_next")))
        .select(
            "msg_id", "symbol", "time",
            F.col("_next.id").alias("response_id"), F.col("_next.direction").alias("direction"),
            F.col("_next.confidence").alias("confidence"), F.col("_next").isNull().alias("timed_out"),
        )
    )
