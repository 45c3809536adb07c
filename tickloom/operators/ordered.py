"""Order-dependent columns over histories too long for one task.

A window over a whole symbol runs in one task, and one symbol may hold a third
of all rows. These helpers cut each history in slices, run the window inside a
slice, and carry a small per-slice summary forward:

* the rows are shuffled once, on (keys, slice);
* the summaries are one row per slice, made with map-side combine, and only
  they are ever ordered over a whole symbol;
* the join that brings a summary back uses the same (keys, slice) hashing, so
  the rows do not move again.

* the join is a left join, so no row is lost. A row without key or time has no place in a
  history: it stays, has no row before it and no running values, and is before no other row.

Time slices follow the clock. Arrival slices hold ``block`` consecutive ids and
are bounded whatever the clock does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 3600
ARRIVAL_BLOCK = 1 << 18

SLICE = "_slice"


@dataclass(frozen=True)
class Axis:
    """How rows are grouped, ordered and cut."""

    slice: Column
    order: tuple[str, ...]
    keys: tuple[str, ...]
    position: Column  # one scalar that grows with ``order``

    def cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, self.slice)

    @property
    def within(self):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    @property
    def over_slices(self):
        return Window.partitionBy(*(self.keys or (F.lit(0),))).orderBy(SLICE)

    @property
    def placed(self) -> Column:
        """Whether a row has a place in a history."""
        return reduce(and_, [F.col(c).isNotNull() for c in self.slice_keys])

    @property
    def slice_keys(self) -> list[str]:
        return [*self.keys, SLICE]


def position(major: Column, minor: Column) -> Column:
    """One number that orders like (major, minor), both long.

    A decimal and not a struct: aggregation buffers of fixed width keep max_by and
    min_by a hash aggregation, a struct would force a sort of the input.
    """
    high = major.cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    return (high + minor.cast("decimal(19,0)")).cast("decimal(38,0)")


def time_slice(seconds: int = SLICE_SECONDS, column: str = "time") -> Column:
    return F.floor(F.unix_micros(F.col(column)) / F.lit(seconds * 1_000_000))


def by_time(
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("time", "tick_id"),
    seconds: int = SLICE_SECONDS,
) -> Axis:
    time, ident = order
    return Axis(time_slice(seconds, time), (time, ident), tuple(keys), position(F.unix_micros(F.col(time)), F.col(ident)))


def by_arrival(
    keys: Sequence[str] = ("symbol",), id_column: str = "tick_id", block: int = ARRIVAL_BLOCK
) -> Axis:
    blocks = F.floor(F.col(id_column) / F.lit(block))
    return Axis(blocks, (id_column,), tuple(keys), F.col(id_column))


def previous(df: DataFrame, values: Mapping[str, Column], axis: Axis) -> DataFrame:
    """Add, per name, the value the expression has in the row before (null in the first)."""
    names = list(values)
    cut = axis.cut(df)
    tails = cut.groupBy(*axis.slice_keys).agg(
        *[F.max_by(values[n], axis.position).alias(f"_t{i}") for i, n in enumerate(names)]
    )
    carry = tails.select(*axis.slice_keys, *[
        F.lag(f"_t{i}").over(axis.over_slices).alias(f"_c{i}") for i in range(len(names))
    ])
    local = cut.withColumns({
        "_first": F.row_number().over(axis.within) == 1,
        **{f"_l{i}": F.lag(values[n]).over(axis.within) for i, n in enumerate(names)},
    })
    joined = local.join(carry, axis.slice_keys, "left")
    helpers = [f"_{kind}{i}" for kind in "lc" for i in range(len(names))]
    return joined.withColumns({
        n: F.when(axis.placed, F.when(F.col("_first"), F.col(f"_c{i}")).otherwise(F.col(f"_l{i}")))
        for i, n in enumerate(names)
    }).drop(*helpers, "_first", SLICE)


def last_known(df: DataFrame, values: Mapping[str, Column], axis: Axis) -> DataFrame:
    """Add, per name, the latest non-null value of the expression up to this row."""
    return last_known_cut(axis.cut(df), values, axis).drop(SLICE)


def last_known_cut(
    cut: DataFrame, values: Mapping[str, Column], axis: Axis, tails: DataFrame | None = None
) -> DataFrame:
    """``last_known`` for rows that already carry their slice column.

    ``tails`` may give the last value per slice (columns ``_l0``, ``_l1``, ...) where
    that is cheaper to get elsewhere; otherwise the last row of each slice holds it.
    """
    names = list(values)
    keys, order = ", ".join(axis.slice_keys), ", ".join(axis.order)
    over = f"over (partition by {keys} order by {order}"
    kept = [c for c in cut.columns if c not in names]
    # SQL text: wide tables have over a hundred columns here.
    local = cut.select(*cut.columns, *[values[n].alias(f"_v{i}") for i, n in enumerate(names)]).selectExpr(
        *kept,
        f"lead(1) {over}) is null as _final",
        *[f"last(_v{i}, true) {over} rows between unbounded preceding and current row) as _l{i}"
          for i in range(len(names))],
    )
    if tails is None:
        tails = local.filter("_final")
    parents = ", ".join(axis.keys) or "0"
    carry = tails.selectExpr(*axis.slice_keys, *[
        f"last(_l{i}, true) over (partition by {parents} order by {SLICE} "
        f"rows between unbounded preceding and 1 preceding) as _c{i}"
        for i in range(len(names))
    ])
    return local.join(carry, axis.slice_keys, "left").selectExpr(
        *kept, *[f"coalesce(_l{i}, _c{i}) as {n}" for i, n in enumerate(names)])


def running(
    df: DataFrame,
    axis: Axis,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums and maxima from the start of the history up to this row.

    ``inclusive=False`` leaves the row itself out. A running count is the sum of 1.
    """
    cut = axis.cut(df)
    sums, maxima = dict(sums or {}), dict(maxima or {})
    totals = cut.groupBy(*axis.slice_keys).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"_t_{n}") for n, v in maxima.items()],
    )
    earlier = axis.over_slices.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *axis.slice_keys,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    frame = axis.within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumns({
        **{f"_l_{n}": F.sum(v).over(frame) for n, v in sums.items()},
        **{f"_l_{n}": F.max(v).over(frame) for n, v in maxima.items()},
    })
    joined = local.join(carry, axis.slice_keys, "left")
    out = {
        n: F.when(
            axis.placed & (F.col(f"_l_{n}").isNotNull() | F.col(f"_c_{n}").isNotNull()),
            F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)),
        )
        for n in sums
    }
    out.update({n: F.when(axis.placed, F.greatest(f"_l_{n}", f"_c_{n}")) for n in maxima})
    helpers = [f"_{k}_{n}" for k in "lc" for n in (*sums, *maxima)]
    return joined.withColumns(out).drop(*helpers, SLICE)
