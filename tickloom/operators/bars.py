"""Bars: from ticks, resampled, true range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators.ordered import SLICE_SECONDS, time_slice

ATR_PERIODS = (14, 20, 50)


def minute_bar_columns() -> list[F.Column]:
    """Aggregates of one bar over the ticks of (symbol, minute).

    Open and close follow arrival (``tick_id``), as a live bar is built. The
    ordering value is a plain long, so the aggregation stays a hash aggregation
    with map-side combine and a hot symbol or minute costs one row per map task.
    """
    mid = S.mid_price(F.col("bid"), F.col("ask"))
    return [
        F.min_by(mid, "tick_id").alias("open"),
        F.max(mid).alias("high"),
        F.min(mid).alias("low"),
        F.max_by(mid, "tick_id").alias("close"),
        F.sum(F.coalesce("volume_real", F.lit(1.0))).alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
        F.avg(mid).alias("mean_mid"),
    ]


def minute_bars(ticks: DataFrame) -> DataFrame:
    return (
        ticks.groupBy("symbol", S.minute_floor(F.col("time")).alias("time"))
        .agg(*minute_bar_columns())
        .withColumn("timeframe", F.lit("M1"))
    )


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Longer bars out of shorter ones; windows start at multiples of the length in UTC."""
    length = f"{S.TIMEFRAME_SECONDS[timeframe]} seconds"
    return (
        bars.groupBy("symbol", F.window("time", length).alias("w"))
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("tick_count").alias("tick_count"),
            (F.sum(F.col("mean_mid") * F.col("tick_count")) / F.sum("tick_count")).alias("mean_mid"),
        )
        .withColumn("time", F.col("w.start"))
        .withColumn("timeframe", F.lit(timeframe))
        .drop("w")
    )


def _per_symbol():
    # Bars per symbol are bounded by the calendar (1440 a day at most), whatever
    # the number of ticks, so a whole-symbol window over them fits in a task.
    return Window.partitionBy("symbol").orderBy("time")


def with_true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(_per_symbol())
    h, l = F.col("high"), F.col("low")
    # greatest skips nulls: the first bar has only high - low.
    return bars.withColumn("true_range", F.greatest(h - l, F.abs(h - before), F.abs(l - before)))


def with_atr(bars: DataFrame, periods: Sequence[int] = ATR_PERIODS) -> DataFrame:
    """Mean true range over exactly ``period`` bars; null until that many exist."""
    out = with_true_range(bars)
    columns = {}
    for period in periods:
        frame = _per_symbol().rowsBetween(-(period - 1), 0)
        columns[f"atr_{period}"] = F.when(
            F.count("true_range").over(frame) == period, F.avg("true_range").over(frame)
        )
    return out.withColumns(columns)


def latest(
    df: DataFrame, n: int = 100, order: Sequence[str] = ("time",), slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """The last ``n`` rows per symbol, with ``rank`` 1 for the newest.

    Rows are counted per (symbol, slice). Only the newest slices that reach ``n`` rows together
    are read on; a row's rank is its rank in its slice plus the rows of the newer ones, so no
    symbol's rows meet in one task. Rows without time come last, as a slice of their own.
    """
    first = order[0]
    # Nulls below all slices of the clock.
    cut = df.withColumn("_slice", F.coalesce(time_slice(slice_seconds, first), F.lit(-(1 << 62))))
    newer = Window.partitionBy("symbol").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        cut.groupBy("symbol", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .select(F.col("symbol").alias("_symbol"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_rows").over(newer), F.lit(0)).alias("_newer"))
        .filter(F.col("_newer") < n)
    )
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_slice") == F.col("_of"))
    newest_first = Window.partitionBy("symbol", "_slice").orderBy(*[F.col(c).desc() for c in order])
    ranked = cut.join(needed, same).withColumn("rank", F.row_number().over(newest_first) + F.col("_newer").cast("int"))
    return ranked.filter(F.col("rank") <= n).drop("_slice", "_symbol", "_of", "_newer")


def unique_bars(bars: DataFrame, file_column: str = "file_no") -> DataFrame:
    """One row per (symbol, time): the copy in the latest file."""
    rest = [c for c in bars.columns if c not in ("symbol", "time")]
    return (
        bars.groupBy("symbol", "time")
        .agg(*[F.max_by(c, file_column).alias(c) for c in rest])
    )
