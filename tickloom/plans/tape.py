"""The full feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.joins import BAR_CONTEXT, with_bar_context
from tickloom.operators.ordered import SLICE, SLICE_SECONDS, by_time
from tickloom.operators.rolling import FEATURE_NAMES, MIN_TICKS, WINDOWS, feature_columns, is_placed, placed_features
from tickloom.operators.ticks import fill_defaults


_PLACED, _KEY = "_placed", "_key"


def _clean(column: str) -> Column:
    # Infinite reads as 0, not-a-number as missing.
    return F.expr(f"case when isnan({column}) then null when abs({column}) = double('infinity') then 0D else {column} end")


def fill_features(df: DataFrame, columns: Sequence[str], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Infinite to 0, then the symbol's last known value, then 0.

    A row without symbol or time has no place in a history: its own values alone count.
    """
    axis = by_time(seconds=slice_seconds)
    # Rows without a place are dealt out below all slices. No key is null: else the join below would have null keys left out of one of
    # the two readings of the rows alone, and all rows would be made and moved twice.
    nowhere = F.lit(-(1 << 40)) - F.shiftrightunsigned(F.xxhash64(*df.columns), 24)
    cut = axis.cut(df).withColumn(_PLACED, axis.placed).withColumns({
        SLICE: F.coalesce(F.when(F.col(_PLACED), F.col(SLICE)), nowhere), _KEY: F.coalesce("symbol", F.lit(""))})
    kept = [c for c in df.columns if c not in columns]
    over = f"over (partition by {_KEY}, {SLICE} order by {', '.join(axis.order)}"
    local = cut.select(*kept, _KEY, SLICE, _PLACED, *[_clean(c).alias(c) for c in columns]).selectExpr(
        *kept, _KEY, SLICE, f"{_PLACED} and lead(1) {over}) is null as _final",
        *[f"if({_PLACED}, last({c}, true) {over} rows between unbounded preceding and current row), {c}) as {c}" for c in columns])
    # Both readings name all columns that are kept (``% 1`` changes nothing), or each would have a shuffle of its own columns.
    named = f"xxhash64({', '.join(kept)}) % 1 = 0"
    return _carried(local.filter(named), local.filter(f"_final and {named}"), columns, kept, _KEY)


def _carried(rows: DataFrame, tails: DataFrame, columns: Sequence[str], shown: Sequence[str], key: str = "symbol") -> DataFrame:
    """Rows filled inside their slices, with the last known values of the slices before; ``tails`` are the last rows of all slices."""
    before = f"over (partition by {key} order by {SLICE} rows between unbounded preceding and 1 preceding)"
    carry = tails.selectExpr(key, SLICE, *[f"last({c}, true) {before} as _c{i}" for i, c in enumerate(columns)])
    return rows.join(carry, [key, SLICE], "left").selectExpr(
        *shown, *[f"coalesce({c}, _c{i}, 0D) as {c}" for i, c in enumerate(columns)])


def _filled_in_place(wide: DataFrame, columns: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """``fill_features`` for rows that lie sorted by (symbol, slice), which cost much to make.

    Inside a slice the rows are filled where they lie. Then they are shuffled once, and both the last row of each slice, whose values
    go on to the later ones, and the rows themselves are read from that shuffle. Its number of partitions differs from
    every other shuffle's, or Spark would leave the rows where they are and make all of them twice. Both readings
    name all its columns (``% 1`` changes nothing), or each would get a shuffle of its own columns. Their conditions have a part, never true,
    that Spark can not move, or they would move below the shuffle, and all windows would run again; so would the join's
    search for null keys, if the rows did not say that they have none. Spark sees that
    they are of one shuffle where the sources are files or tables; rows made on the driver it reads twice.
    """
    over = f"over (partition by symbol, {SLICE} order by _us, tick_id"
    local = wide.select(*kept, SLICE, "_us", *[_clean(c).alias(c) for c in columns]).selectExpr(
        *kept, SLICE, f"lead(1) {over}) is null as _final",
        *[f"last({c}, true) {over} rows between unbounded preceding and current row) as {c}" for c in columns])
    partitions = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    dealt = local.where(f"symbol is not null and {SLICE} is not null").repartition(partitions, "symbol", SLICE)
    named, stays = f"xxhash64({', '.join(kept)}) % 1 = 0", "monotonically_increasing_id() < 0"
    tails = dealt.filter(f"(_final and {named}) or {stays}")
    return _carried(dealt.filter(f"(_final or {named}) or {stays}"), tails, columns, kept)


def extract_features(
    ticks: DataFrame,
    bars: DataFrame | None = None,
    features: Sequence[str] = FEATURE_NAMES,
    windows: Sequence[int] = WINDOWS,
    closed_bars_only: bool = False,
    slice_seconds: int = SLICE_SECONDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All features of every tick on one frame, filled.

    Bar context goes along as columns, so it needs no join. The windows run once, and the fill takes both the last values of each
    slice and the rows from one shuffle of their result. A tick without symbol, time or id has no place in a history: it stays, and
    all its features are 0. ``keep`` names tick columns to pass through.
    """
    base = fill_defaults(ticks)
    given = ["direction"] if "direction" in base.columns else []
    base = base.select("tick_id", "symbol", "time", "bid", "ask", "last", "volume", *given, *keep)
    placed, context = base.filter(is_placed()), ()
    if bars is not None:
        placed, context = with_bar_context(placed, bars, closed_bars_only, slice_seconds), BAR_CONTEXT
    wide = placed_features(placed, features, windows, MIN_TICKS, slice_seconds, [*keep, *context], keep_slice=True)
    columns, kept = [*feature_columns(features, windows), *context], ["tick_id", "symbol", "time", *keep]
    rest = base.filter(~is_placed()).select("tick_id", "symbol", "time", *keep, *[F.lit(0.0).alias(c) for c in columns])
    return _filled_in_place(wide, columns, kept).unionByName(rest)
