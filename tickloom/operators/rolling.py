"""Tape-reading features over causal time windows.

A window of ``w`` seconds at a tick holds the ticks of its symbol with time in
``(t - w, t]`` that do not come after it, so a later tick with the same time
is not in it.

How it runs:

1. ``with_history``: each history is cut in time slices. One summary row per slice
   tells every row its predecessor and which later slices still need it, and
   those slices get a copy (the halo). Ticks are shuffled on (symbol, slice), so
   a hot symbol spreads over as many tasks as it has slices.
2. Spark evaluates a sliding frame row by row over the whole frame, which costs
   rows x frame length. Counts and sums of whole numbers are the difference of two growing
   frames instead, "all rows so far" and "all rows up to t - w", which Spark
   updates in one pass and which are exact. The first row of the window is the successor of the last
   row at or before t - w.
   The extremes come from blocks of length w: a
   window meets two blocks at most, so its maximum is that of the tail of one
   block and the head of the next.
3. Moments of doubles are never subtracted: one huge price would stay in
   every later difference. They are joined from runs of 1, 2, 4, ... rows by adding; see ``counting``.
4. All five window lengths share one shuffle and two sorts.

Missing and bad values: a price or volume that is no finite number counts as missing at intake. A feature needs
``min_ticks`` values of the column it is about (not just rows); differences with a missing end are null, sums, means and extremes leave it out, and a
missing quote counts as changed. A tick without symbol, time or id has no place in a history: it stays,
with null features, and is in no other tick's window.

The formulas are Spark SQL text: over a hundred columns are built at once, and one
parsed string is far cheaper to build than a tree of Python column calls.

``level_tests`` and ``large_print_ratio`` compare every row of a window with a
threshold of that window, which no running total gives; see ``counting``. What Python finds comes back as
columns of the same rows, in one step for all features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators import counting
from tickloom.operators.ordered import SLICE_SECONDS, by_time, time_slice
from tickloom.operators.ticks import fill_defaults

# Window lengths in seconds, rows a window needs, rows of the volume mean.
WINDOWS = (10, 30, 60, 300, 600)
MIN_TICKS = 5
VOLUME_MEAN_ROWS = 50
VOLUME_MEAN_MIN = 10

_HOME, _OWN = "_home", "_own"


# --- history: predecessor, position and halo -----------------------------------------


def with_history(
    ticks: DataFrame,
    seconds: int = max(WINDOWS),
    rows: int = VOLUME_MEAN_ROWS,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Send each tick to its slice and to later slices that look back at it.

    Adds ``_home`` (slice to compute in), ``_own`` (whether the row belongs to it),
    ``_us`` (time in microseconds), ``_rank`` (position in the symbol's history) and
    ``_prev_last`` (price of the tick before). A slice sees every row within
    ``seconds`` before any of its own rows or of the row before it, and the
    ``rows`` rows before its first.

    Slices may be shorter than the window, down to where tasks get small enough in the
    busiest period; a row is then copied to every slice that looks back at it.
    """
    axis = by_time(seconds=slice_seconds)
    span = seconds * 1_000_000
    cut = ticks.withColumns({"_slice": time_slice(slice_seconds), "_us": S.epoch_micros(F.col("time"))})

    over = Window.partitionBy("symbol").orderBy("_slice")
    slices = (
        cut.groupBy("symbol", "_slice")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("_us").alias("_until"),
            F.max_by("last", axis.position).alias("_tail"),
        )
        .select(
            "symbol", "_slice", "_until",
            F.lag("_tail").over(over).alias("_prev_tail"),
            F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("_through"),
            F.coalesce(
                F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.lag("_until").over(over).alias("_prev_until"),
        )
    )
    # Later slices that may look back here. Each of them holds a row, so ``rows`` + 1 reach
    # over the row count, and the second term over the time. Usually one stays after
    # the filter.
    reach = max(rows, -(-seconds // slice_seconds) + 1) + 1
    later = F.collect_list(F.struct(
        F.col("_slice").alias("slice"), F.col("_offset").alias("offset"),
        F.col("_prev_until").alias("prev_until"),
    )).over(over.rowsBetween(1, reach))
    slices = slices.withColumn("_later", later).withColumn("_later", F.filter("_later", lambda s: (
        (F.col("_until") > s["prev_until"] - span) | (F.col("_through") > s["offset"] - rows)
    ))).drop("_until", "_through", "_prev_until")

    within = Window.partitionBy("symbol", "_slice").orderBy("time", "tick_id")
    placed = (
        cut.withColumns({
            "_n": F.row_number().over(within),
            "_lag": F.lag("last").over(within),
        })
        .join(slices, ["symbol", "_slice"])
        .withColumns({
            "_rank": F.col("_n") + F.col("_offset"),
            "_prev_last": F.when(F.col("_n") == 1, F.col("_prev_tail")).otherwise(F.col("_lag")),
        })
    )
    needs = F.filter("_later", lambda s: (
        (F.col("_us") > s["prev_until"] - span) | (F.col("_rank") > s["offset"] - rows)
    ))
    return (
        placed.withColumn(_HOME, F.explode(
            F.concat(F.array(F.col("_slice")), F.transform(needs, lambda s: s["slice"]))
        ))
        .withColumn(_OWN, F.col(_HOME) == F.col("_slice"))
        .drop("_slice", "_n", "_lag", "_offset", "_prev_tail", "_later")
    )


# --- one window of one row -------------------------------------------------------------


@dataclass
class Frame:
    """SQL expressions over one window; remembers which totals they need."""

    seconds: int
    sums: set[str] = field(default_factory=set)
    heads: set[str] = field(default_factory=set)
    moments: set[str] = field(default_factory=set)
    extremes: bool = False

    @property
    def n(self) -> str:
        return f"_n_{self.seconds}"

    def sum(self, name: str) -> str:
        self.sums.add(name)
        return f"_sum_{name}_{self.seconds}"

    def first(self, name: str) -> str:
        self.heads.add(name)
        return f"_head_{self.seconds}.{name}"

    @property
    def max(self) -> str:
        self.extremes = True
        return f"_max_{self.seconds}"

    @property
    def min(self) -> str:
        self.extremes = True
        return f"_min_{self.seconds}"

    def moment(self, name: str, part: str) -> str:
        """``n``, ``mean`` or ``dev`` (sum of squared deviations) of a double."""
        self.moments.add(name)
        return f"_{part}_{name}_{self.seconds}"

    def total(self, name: str, whole: bool) -> str:
        """Sum of a column; of doubles by adding only."""
        return self.sum(name) if whole else f"({self.moment(name, 'mean')} * {self.moment(name, 'n')})"

    def std(self, name: str) -> str:
        n, dev = self.moment(name, "n"), self.moment(name, "dev")
        return f"if({n} > 1, sqrt({dev} / ({n} - 1)), null)"

    def per_second(self, value: str) -> str:
        return f"({value}) / {self.seconds}D"


def _or_one(value: str) -> str:
    return f"if({value} = 0, 1, {value})"


# --- per-row values the windows add up ----------------------------------------------

# Whole numbers: exact, so a window is the difference of two totals.
_SUMS = {
    "dir": "cast(direction as bigint)",
    "up": "cast(direction > 0 as bigint)",
    "down": "cast(direction < 0 as bigint)",
    "volume": "volume",
    "buy": "if(direction = 1, volume, volume * 0)",
    "sell": "if(direction = -1, volume, volume * 0)",
    # The change of the first row of a window is always taken off again, so the
    # row before the window does not matter.
    "dir_chg": "coalesce(cast(direction != _prev_dir as bigint), 1)",
    "bid_chg": "coalesce(cast(bid != _prev_bid as bigint), 1)",
    "ask_chg": "coalesce(cast(ask != _prev_ask as bigint), 1)",
    "on_grid": f"coalesce(cast((last - _prev_last) % {S.TICK_SIZE}D = 0 as bigint), 0)",
    "pair": "cast(last - _prev_last is not null as bigint)",
    **{f"has_{c}": f"cast({c} is not null as bigint)" for c in ("direction", "last", "volume", "bid", "ask", "spread")},
}
# Doubles: moments by adding.
_MOMENTS = {
    "ret": "_ret", "spread": "spread", "mid": "(bid + ask) / 2D", "volume": "volume",
    "buy": _SUMS["buy"], "sell": _SUMS["sell"],
}
_HEADS = {"us": "_us", "last": "last", **{n: _SUMS[n] for n in ("dir_chg", "bid_chg", "ask_chg", "on_grid", "pair")}}

# --- the features ------------------------------------------------------------------

FEATURES: dict[str, Callable[[Frame, bool], str]] = {
    "tick_velocity": lambda f, _: f.per_second(f.n),
    "price_velocity": lambda f, _: f.per_second(f"last - {f.first('last')}"),
    "volatility": lambda f, _: f.std("ret"),
    "range_velocity": lambda f, _: f.per_second(f"{f.max} - {f.min}"),
    "momentum": lambda f, _: f"cast({f.sum('dir')} as double)",
    "trend_consistency": lambda f, _: (
        f"if({f.sum('up')} + {f.sum('down')} = 0, 0D, "
        f"greatest({f.sum('up')}, {f.sum('down')}) / ({f.sum('up')} + {f.sum('down')}))"),
    "rejection_strength": lambda f, _: (
        f"if({f.n} < 3 or {f.max} = {f.min}, 0D, 1D - abs(last - {f.first('last')}) / ({f.max} - {f.min}))"),
    "directional_persistence": lambda f, _: (
        f"if({f.n} < 2, 0D, 1D - ({f.sum('dir_chg')} - {f.first('dir_chg')} + 1) / {f.n})"),
    "buy_pressure": lambda f, whole: f"{f.total('buy', whole)} / {_or_one(f.total('volume', whole))}",
    "sell_pressure": lambda f, whole: f"{f.total('sell', whole)} / {_or_one(f.total('volume', whole))}",
    "volume_imbalance": lambda f, whole: (
        f"({f.total('buy', whole)} - {f.total('sell', whole)}) / {_or_one(f.total('volume', whole))}"),
    "volume_spike": lambda f, whole: f"try_divide({f.total('volume', whole)}, _volume_mean)",
    "volume_velocity": lambda f, whole: f.per_second(f.total("volume", whole)),
    "spread_normalized": lambda f, _: f"{f.moment('spread', 'mean')} / {_or_one(f.moment('mid', 'mean'))}",
    "spread_volatility": lambda f, _: f.std("spread"),
    "bid_change_freq": lambda f, _: f.per_second(f"{f.sum('bid_chg')} - {f.first('bid_chg')} + 1"),
    "ask_change_freq": lambda f, _: f.per_second(f"{f.sum('ask_chg')} - {f.first('ask_chg')} + 1"),
    "avg_time_between_ticks": lambda f, _: f"if({f.n} < 2, 0D, (_us - {f.first('us')}) / 1e6D / ({f.n} - 1))",
    "tick_size_adherence": lambda f, _: (
        f"coalesce(try_divide({f.sum('on_grid')} - {f.first('on_grid')}, {f.sum('pair')} - {f.first('pair')}), 1D)"),
}
# The column whose values ``min_ticks`` counts; rows for the others, nothing for volatility.
_ABOUT = {
    **dict.fromkeys(("price_velocity", "range_velocity", "rejection_strength", "tick_size_adherence"), "last"),
    **dict.fromkeys(("momentum", "trend_consistency", "directional_persistence"), "direction"),
    **dict.fromkeys(("buy_pressure", "sell_pressure", "volume_imbalance", "volume_spike", "volume_velocity"), "volume"),
    **dict.fromkeys(("spread_normalized", "spread_volatility"), "spread"),
    "bid_change_freq": "bid", "ask_change_freq": "ask",
}
# Change against the row before of another feature.
CHANGES = {"acceleration": "price_velocity"}
# Full column order, one block of columns per window length.
FEATURE_NAMES = (
    "tick_velocity", "price_velocity", "acceleration", "volatility", "range_velocity",
    "momentum", "trend_consistency", "rejection_strength", "level_tests", "directional_persistence",
    "buy_pressure", "sell_pressure", "volume_imbalance", "volume_spike", "large_print_ratio",
    "volume_velocity",
    "spread_normalized", "spread_volatility", "bid_change_freq", "ask_change_freq",
    "avg_time_between_ticks", "tick_size_adherence",
)
# These need no minimum number of ticks.
_UNGUARDED = {"volatility"}


def feature_columns(features: Sequence[str] = FEATURE_NAMES, windows: Sequence[int] = WINDOWS) -> list[str]:
    return [f"{f}_{w}s" for w in windows for f in features]


def is_placed() -> Column:
    """Whether a tick has a place in a history."""
    return F.col("symbol").isNotNull() & F.col("time").isNotNull() & F.col("tick_id").isNotNull()


def _finite(ticks: DataFrame) -> DataFrame:
    """Prices and volumes that are no finite numbers as missing."""
    doubles = [c for c, kind in ticks.dtypes if c in ("bid", "ask", "last", "volume") and kind in ("double", "float")]
    return ticks.withColumns({c: S.finite_or_null(F.col(c)) for c in doubles}) if doubles else ticks


def rolling_features(
    ticks: DataFrame,
    features: Sequence[str] = FEATURE_NAMES,
    windows: Sequence[int] = WINDOWS,
    min_ticks: int = MIN_TICKS,
    slice_seconds: int = SLICE_SECONDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column ``<feature>_<w>s`` per feature and window, plus tick_id, symbol, time.

    ``keep`` names tick columns to pass through.
    """
    unknown = set(features) - set(FEATURE_NAMES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    base = fill_defaults(ticks)
    placed = placed_features(base.filter(is_placed()), features, windows, min_ticks, slice_seconds, keep)
    # The others need no shuffle; the condition reaches the scan.
    rest = base.filter(~is_placed()).select(
        "tick_id", "symbol", "time", *keep, *[F.lit(None).cast("double").alias(c) for c in feature_columns(features, windows)])
    return placed.unionByName(rest)


def placed_features(
    ticks: DataFrame, features: Sequence[str], windows: Sequence[int], min_ticks: int, slice_seconds: int,
    keep: Sequence[str], keep_slice: bool = False,
) -> DataFrame:
    """``rolling_features`` of ticks that all have symbol, time and id; ``keep_slice`` leaves what the rows are partitioned
    and sorted by in ``_slice`` and ``_us``."""
    base = _finite(ticks)
    given = ["direction"] if "direction" in base.columns else []
    base = base.select("tick_id", "symbol", "time", "bid", "ask", "last", "volume", *given, *keep)
    rows = with_history(base, max(windows), slice_seconds=slice_seconds)
    if not given:
        rows = rows.withColumn("direction", S.sign(F.col("last") - F.col("_prev_last")))
    rows = _add_windows(rows, features, windows, min_ticks)
    home = [F.col(_HOME).alias("_slice"), "_us"] if keep_slice else []
    return rows.filter(_OWN).select(
        "tick_id", "symbol", "time", *keep, *home, *feature_columns(features, windows)
    )


def _add_windows(rows: DataFrame, features: Sequence[str], windows: Sequence[int], min_ticks: int) -> DataFrame:
    whole = dict(rows.dtypes)["volume"] in ("bigint", "int", "smallint", "tinyint")
    frames = {w: Frame(w) for w in windows}
    counted = [f for f in features if f in counting.FEATURES]
    wanted = dict.fromkeys([f for f in features if f in FEATURES] + [CHANGES[f] for f in features if f in CHANGES])
    columns = []
    for w, frame in frames.items():
        for name in wanted:
            value = FEATURES[name](frame, whole)
            if name not in _UNGUARDED:
                there = frame.sum(f"has_{_ABOUT[name]}") if name in _ABOUT else frame.n
                value = f"if({there} >= {min_ticks}, {value}, null)"
            columns.append(f"cast({value} as double) as {name}_{w}s")
        if "volume_spike" in wanted:
            frame.sums |= {"has_volume"} | ({"volume"} if whole else set())
    moments = sorted(set().union(*(f.moments for f in frames.values())))
    sums = sorted(set().union(*(f.sums for f in frames.values())))
    heads = sorted(set().union(*(f.heads for f in frames.values())))
    extremes = [(m, w) for w, f in frames.items() if f.extremes for m in ("max", "min")]
    if extremes and "us" not in heads:
        heads.append("us")

    part = f"partition by symbol, {_HOME}"
    oldest_first = f"{part} order by _us, tick_id"
    newest_first = f"{part} order by _us desc, tick_id desc"
    grow = "rows between unbounded preceding and current row"

    def block(w: int, column: str = "_us") -> str:
        return f"{column} div {w * 1_000_000}"

    # Newest first: extremes from here to the end of the block. Blocks come in falling
    # order, so the extreme of (block, price) is the one of the block at hand. A missing price is beaten by any other.
    price = {"max": "coalesce(last, double('-infinity'))", "min": "coalesce(last, double('infinity'))"}
    back = []
    for m, w in extremes:
        order = f"-({block(w)})" if m == "max" else block(w)
        back.append(f"{m}(struct({order} as b, {price[m]} as v)) over ({newest_first} {grow}).v as _{m}_tail_{w}")

    # Oldest first: values of the row before.
    lags = [
        f"lag({column}) over ({oldest_first}) as {name}"
        for column, name, total in (
            ("direction", "_prev_dir", "dir_chg"), ("bid", "_prev_bid", "bid_chg"), ("ask", "_prev_ask", "ask_chg"),
        ) if total in sums
    ]
    if "spread" in moments or "has_spread" in sums:
        lags.append("ask - bid as spread")
    if "ret" in moments:
        lags.append("try_divide(last - _prev_last, _prev_last) as _ret")

    # Running totals, extremes from the start of the block to here, and the next row.
    running = [f"row_number() over ({oldest_first}) as _c_n"]
    running += [f"sum({_SUMS[n]}) over ({oldest_first} {grow}) as _c_{n}" for n in sums]
    for m, w in extremes:
        order = block(w) if m == "max" else f"-({block(w)})"
        running.append(f"{m}(struct({order} as b, {price[m]} as v)) over ({oldest_first} {grow}).v as _{m}_from_{w}")
    head_row = [f"{_HEADS[n]} as {n}" for n in heads]
    head_row += [f"_{m}_tail_{w} as {m}_{w}" for m, w in extremes]
    if head_row:
        struct = f"struct({', '.join(head_row)})"
        running.append(f"lead({struct}) over ({oldest_first}) as _next")
        running.append(f"first({struct}) over ({oldest_first} {grow}) as _start")

    # The totals at the last row with time <= t - w: one growing frame per length.
    snapshot = ["_us as at", "tick_id as id", "_c_n as n", *[f"_c_{n} as {n}" for n in sums]]
    snapshot += ["_next as next"] if head_row else []
    far = [f"struct({', '.join(snapshot)}) as _snap"]
    mean = []
    if "volume_spike" in wanted:
        back_rows = VOLUME_MEAN_ROWS
        far += [
            f"_c_volume - coalesce(lag(_c_volume, {back_rows}) over ({oldest_first}), 0) as _recent_volume" if whole else
            f"sum(volume) over ({oldest_first} rows between {back_rows - 1} preceding and current row) as _recent_volume",
            f"_c_has_volume - coalesce(lag(_c_has_volume, {back_rows}) over ({oldest_first}), 0) as _volumes"]
        mean = [f"if(_volumes >= {VOLUME_MEAN_MIN}, _recent_volume / _volumes, null) as _volume_mean"]
    lookups = [
        f"max(_snap) over ({part} order by _us range between unbounded preceding "
        f"and {w * 1_000_000} preceding) as _far_{w}"
        for w in windows
    ]

    # Differences: what is in the window.
    inside = []
    for w in windows:
        inside.append(f"_c_n - coalesce(_far_{w}.n, 0) as _n_{w}")
        inside += [f"coalesce(_c_{n}, 0) - coalesce(_far_{w}.{n}, 0) as _sum_{n}_{w}" for n in sums if n in frames[w].sums]
        if head_row:
            inside.append(f"if(_far_{w} is null, _start, _far_{w}.next) as _head_{w}")
    across = []
    for m, w in extremes:
        pick = "greatest" if m == "max" else "least"
        across.append(
            f"if({block(w)} = {block(w, f'_head_{w}.us')}, _{m}_from_{w}, "
            f"{pick}(_{m}_from_{w}, _head_{w}.{m}_{w})) as _{m}_{w}")

    # Python sees the rows as the running totals have sorted them, before they grow wide.
    out = rows
    for step in (back, lags, running):
        if step:
            out = out.selectExpr("*", *step)
    if counted or moments:
        out = counting.add(out, "_c_n", counted, {n: _MOMENTS[n] for n in moments}, windows, min_ticks)
    if wanted:
        for step in (far, mean, lookups, inside, across, columns):
            if step:
                out = out.selectExpr("*", *step)
    changes = [
        f"{CHANGES[f]}_{w}s - lag({CHANGES[f]}_{w}s) over ({oldest_first}) as {f}_{w}s"
        for f in features if f in CHANGES for w in windows
    ]
    return out.selectExpr("*", *changes) if changes else out
