"""Tick cleaning and tick-level columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators.ordered import SLICE_SECONDS, Axis, by_time, previous, running


def fill_defaults(ticks: DataFrame) -> DataFrame:
    """Add ``last`` (mid price) and ``volume`` (1) where the table has no such column."""
    out = ticks
    if "last" not in ticks.columns:
        out = out.withColumn("last", S.mid_price(F.col("bid"), F.col("ask")))
    if "volume" not in ticks.columns:
        out = out.withColumn("volume", F.lit(1).cast("long"))
    return out


def with_prices(ticks: DataFrame) -> DataFrame:
    bid, ask = F.col("bid"), F.col("ask")
    return fill_defaults(ticks).withColumns({
        "spread": S.spread(bid, ask),
        "mid_price": S.mid_price(bid, ask),
        "timestamp": S.epoch_seconds(F.col("time")),
    })


def between(
    df: DataFrame,
    symbols: Sequence[str] | None,
    start: dt.datetime | Column,
    end: dt.datetime | Column,
    timeframe: str | None = None,
) -> DataFrame:
    """Rows with ``start <= time < end``; plain comparisons, so they reach the scan.

    A stored table also has the ``date`` its folders are named by.
    """
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    out = df.filter((F.col("time") >= start) & (F.col("time") < end))
    if "date" in df.columns:
        out = out.filter((F.col("date") >= F.to_date(start)) & (F.col("date") <= F.to_date(end)))
    if symbols is not None:
        out = out.filter(F.col("symbol").isin(*symbols))
    if timeframe is not None:
        out = out.filter(F.col("timeframe") == timeframe)
    return out


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def first_copies(ticks: DataFrame) -> DataFrame:
    """Keep the first arrival of each (symbol, time, bid, ask).

    An aggregation, not a window: copies are merged before the shuffle, so a tick
    repeated a billion times is one row per map task.
    """
    key = ["symbol", "time", "bid", "ask"]
    rest = [c for c in ticks.columns if c not in key]
    kept = [F.min_by(c, "tick_id").alias(c) for c in rest]
    return ticks.groupBy(*key).agg(*kept).select(*ticks.columns)


def with_direction(
    ticks: DataFrame,
    price: Column | str = "last",
    reset_by: str | None = None,
    axis: Axis | None = None,
    name: str = "direction",
) -> DataFrame:
    """Sign of the price change from the tick before (0 for the first one).

    ``reset_by`` names a column whose change makes a tick first again, such as the day
    of a day-wise collection.
    """
    axis = axis or by_time()
    price = F.col(price) if isinstance(price, str) else price
    values = {"_p": price}
    if reset_by:
        values["_g"] = F.col(reset_by)
    out = previous(ticks, values, axis)
    change = price - F.col("_p")
    if reset_by:
        change = F.when(F.col(reset_by) == F.col("_g"), change)
    return out.withColumn(name, S.sign(change)).drop(*values)


def with_return(ticks: DataFrame, axis: Axis | None = None) -> DataFrame:
    out = previous(ticks, {"_p": F.col("last")}, axis or by_time())
    return out.withColumn("ret", F.try_divide(F.col("last") - F.col("_p"), F.col("_p"))).drop("_p")


def with_running_stats(ticks: DataFrame, axis: Axis | None = None) -> DataFrame:
    """Tick count, last tick time and mean spread up to each tick."""
    out = running(
        ticks,
        axis or by_time(),
        sums={"running_ticks": F.lit(1).cast("long"), "_s": S.spread(F.col("bid"), F.col("ask"))},
        maxima={"last_tick_time": F.col("time")},
    )
    return out.withColumn("running_spread", F.col("_s") / F.col("running_ticks")).drop("_s")


def newer_only(ticks: DataFrame, axis: Axis, floor: Column | None = None) -> DataFrame:
    """In arrival order, drop a tick whose time is not later than every time before it.

    ``floor`` is the latest time known from before this table.
    """
    out = running(ticks, axis, maxima={"_seen": F.col("time")}, inclusive=False)
    seen = F.col("_seen") if floor is None else F.greatest("_seen", floor)
    return out.filter(seen.isNull() | (F.col("time") > seen)).drop("_seen")


def sent_direction(sent: DataFrame, axis: Axis, start: Column | None = None) -> DataFrame:
    """Sign of the change of ``last`` from the tick sent before; ``start`` is the last
    price known from before this table."""
    out = previous(sent, {"_p": F.col("last")}, axis)
    before = F.col("_p") if start is None else F.coalesce("_p", start)
    return out.withColumn("direction", S.sign(F.col("last") - before)).drop("_p")


def clean(ticks: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Historical cleaning: direction and spread on the raw tape, then first copies.

    Ticks without symbol or time stay, with direction 0; ``quality.check_ticks`` counts them.
    """
    raw = with_direction(fill_defaults(ticks), axis=by_time(seconds=slice_seconds))
    return first_copies(raw.withColumn("spread", S.spread(F.col("bid"), F.col("ask"))))


def in_order(df: DataFrame, columns: Sequence[str] = ("symbol", "time", "tick_id")) -> DataFrame:
    """Total order; a range-partitioned sort, so it scales with the executors."""
    return df.orderBy(*columns)
