"""Scalar column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Timeframe code -> label; any other code reads as M1.
TIMEFRAME_LABELS = {
    1: "M1", 5: "M5", 15: "M15", 30: "M30", 16385: "H1", 16388: "H4", 16408: "D1",
}
DEFAULT_TIMEFRAME = "M1"

# Timeframe label -> bar length.
TIMEFRAME_SECONDS = {
    "M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400,
}

# The price grid, market opening and closing times, and text formats.
TICK_SIZE = 0.5
MARKET_OPEN = dt.time(9, 0, 0)
MARKET_CLOSE = dt.time(23, 59, 59)
FILE_STAMP = "yyyyMMdd_HHmmss"
MESSAGE_STAMP = "yyyy.MM.dd HH:mm:ss"


def epoch_micros(time: Column) -> Column:
    return F.unix_micros(time)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970 as double, fractions kept."""
    return F.unix_micros(time) / F.lit(1e6)


def whole_seconds(time: Column) -> Column:
    """Seconds since 1970 as long; the form query results carry."""
    return F.unix_seconds(time)


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def sign(change: Column) -> Column:
    """1, -1 or 0; 0 where there is nothing (or no number) to compare with."""
    return F.coalesce(F.signum(nan_to_null(change)), F.lit(0.0)).cast("int")


def directed_volume(volume: Column, direction: Column, side: int) -> Column:
    return F.when(direction == F.lit(side), volume).otherwise(volume * F.lit(0))


def timeframe_label(code: Column) -> Column:
    pairs = [F.lit(v) for item in TIMEFRAME_LABELS.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(DEFAULT_TIMEFRAME))


def normalize_price(price: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.round(price * scale) / scale


def finite_or_zero(value: Column) -> Column:
    return F.when(F.abs(value) == F.lit(float("inf")), F.lit(0.0)).otherwise(value)


def finite_or_null(value: Column) -> Column:
    """What is no finite number counts as missing."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def on_grid(change: Column, step: float = TICK_SIZE) -> Column:
    return (change % F.lit(step)) == F.lit(0.0)


def minute_floor(time: Column) -> Column:
    return F.date_trunc("minute", time)


def stamp(time: Column, pattern: str = MESSAGE_STAMP) -> Column:
    return F.date_format(time, pattern)


def market_date_range(as_of: dt.datetime, months: int = 6) -> tuple[dt.datetime, dt.datetime]:
    """From the market opening ``30 * months`` days back to the end of today."""
    first_day = (as_of - dt.timedelta(days=30 * months)).date()
    return (
        dt.datetime.combine(first_day, MARKET_OPEN),
        dt.datetime.combine(as_of.date(), MARKET_CLOSE),
    )


def market_range_columns(as_of: Column, months: int = 6) -> tuple[Column, Column]:
    """The same range where ``as_of`` is a timestamp column."""
    opening = MARKET_OPEN.hour * 3600 + MARKET_OPEN.minute * 60 + MARKET_OPEN.second
    closing = MARKET_CLOSE.hour * 3600 + MARKET_CLOSE.minute * 60 + MARKET_CLOSE.second
    midnight = F.unix_seconds(F.date_trunc("day", as_of))
    return (
        F.timestamp_seconds(midnight - F.lit(30 * months * 86400) + F.lit(opening)),
        F.timestamp_seconds(midnight + F.lit(closing)),
    )


def with_bar_geometry(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns({
        "typical_price": (h + l + c) / F.lit(3.0),
        "range": h - l,
        "body": F.abs(c - o),
        "upper_shadow": h - F.greatest(o, c),
        "lower_shadow": F.least(o, c) - l,
    })
