"""Validation, coverage, statistics and profiles, all as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators.ordered import by_arrival, previous
from tickloom.session import ship_module

ship_module(__name__)

# Columns a tick table must have and rows it needs.
REQUIRED_TICK_COLUMNS = ("time", "bid", "ask", "symbol")
MIN_TICK_ROWS = 100


def check_ticks(ticks: DataFrame) -> DataFrame:
    """One row: missing columns, row count, rows without a key, steps back in time by arrival, verdict.

    Order is compared in blocks of arrival ids; only a block's last time is carried on.
    Going back in time is a warning and does not make the table invalid; a null symbol,
    time or id does, as such a row has no place on the tape.
    """
    missing = [c for c in REQUIRED_TICK_COLUMNS if c not in ticks.columns]
    keys = [c for c in ("symbol", "time", "tick_id") if c in ticks.columns]
    null_keys = F.count_if(reduce(or_, [F.col(c).isNull() for c in keys])) if keys else F.lit(0).cast("long")
    counted = ticks.agg(F.count(F.lit(1)).alias("row_count"), null_keys.alias("null_keys"))
    if missing:
        stepped = counted.withColumn("steps_back", F.lit(0).cast("long"))
    else:
        placed = ticks.select("tick_id", "time").where("tick_id IS NOT NULL AND time IS NOT NULL")
        before = previous(placed, {"before": F.col("time")}, by_arrival(keys=()))
        # Two tables of one row.
        stepped = counted.join(before.agg(F.count_if(F.col("time") < F.col("before")).alias("steps_back")))
    valid = (F.col("row_count") >= MIN_TICK_ROWS) & (F.col("null_keys") == 0) & F.lit(not missing)
    return stepped.select(
        F.lit(",".join(missing)).alias("missing_columns"), "row_count", "null_keys", "steps_back",
        (F.col("steps_back") == 0).alias("in_order"), valid.alias("valid"),
    )


def dataset_summary(table: DataFrame, dataset: str) -> DataFrame:
    return table.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("time").alias("from_time"), F.max("time").alias("to_time"),
    ).withColumn("dataset", F.lit(dataset))


def validate_collection(symbols: DataFrame, ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Per expected symbol and dataset: rows and date range, or status ``missing``."""
    datasets = F.array(F.lit("ticks"), F.lit("ohlc"))
    expected = symbols.select("symbol").distinct().withColumn("dataset", F.explode(datasets))
    found = dataset_summary(ticks, "ticks").unionByName(dataset_summary(bars, "ohlc"))
    status = F.when(F.col("row_count").isNull(), "missing").otherwise("present")
    return expected.join(found, ["symbol", "dataset"], "left").withColumn("status", status)


def coverage(symbols: DataFrame, ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Tick and bar counts of every expected symbol, 0 where there are none."""
    counted = (
        ticks.select("symbol", F.lit(1).alias("t"), F.lit(0).alias("b"))
        .unionByName(bars.select("symbol", F.lit(0).alias("t"), F.lit(1).alias("b")))
        .groupBy("symbol").agg(F.sum("t").alias("ticks"), F.sum("b").alias("bars"))
    )
    return symbols.select("symbol").distinct().join(counted, "symbol", "left").fillna(0, ["ticks", "bars"])


def missing_symbols(symbols: DataFrame, ticks: DataFrame) -> DataFrame:
    return symbols.select("symbol").distinct().join(ticks.select("symbol").distinct(), "symbol", "left_anti")


def collection_status(covered: DataFrame) -> DataFrame:
    """``success`` with ticks and bars, ``partial`` with one of them, else ``failed``."""
    has_ticks, has_bars = F.col("ticks") > 0, F.col("bars") > 0
    return covered.withColumn(
        "status",
        F.when(has_ticks & has_bars, "success").when(has_ticks | has_bars, "partial").otherwise("failed"),
    )


def symbol_stats(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol: ticks, last tick time, mean spread and finished bars."""
    seen = ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_ticks"),
        F.max("time").alias("last_tick_time"),
        F.avg(S.spread(F.col("bid"), F.col("ask"))).alias("avg_spread"),
    )
    made = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars_completed"))
    return seen.join(made, "symbol", "left").fillna(0, ["bars_completed"])


def tick_rate(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy(F.date_trunc("second", "time").alias("second")).agg(
        F.count(F.lit(1)).alias("ticks_per_second"))


def collection_report(validated: DataFrame) -> DataFrame:
    """One row per symbol: both datasets side by side."""
    def of(dataset: str, column: str) -> F.Column:
        return F.max(F.when(F.col("dataset") == dataset, F.col(column)))

    return validated.groupBy("symbol").agg(
        F.coalesce(of("ticks", "row_count"), F.lit(0)).alias("tick_rows"),
        of("ticks", "from_time").alias("tick_from"), of("ticks", "to_time").alias("tick_to"),
        F.coalesce(of("ohlc", "row_count"), F.lit(0)).alias("bar_rows"),
        of("ohlc", "from_time").alias("bar_from"), of("ohlc", "to_time").alias("bar_to"),
    )


def live_report(ticks: DataFrame, bars: DataFrame, bad_rows: DataFrame | None = None) -> DataFrame:
    """Per symbol and in total (``is_total``): ticks, rate over the time seen, spread, bars, rows turned away."""
    def part(df: DataFrame, **values) -> DataFrame:
        counts = {"t": 0, "b": 0, "e": 0} | values
        return df.select(
            "symbol", *[F.lit(v).alias(k) for k, v in counts.items()],
            *([F.col("time"), S.spread(F.col("bid"), F.col("ask")).alias("spread")] if counts["t"] else []),
        )

    rows = part(ticks, t=1).unionByName(part(bars, b=1), allowMissingColumns=True)
    if bad_rows is not None:
        rows = rows.unionByName(part(bad_rows, e=1), allowMissingColumns=True)
    span = F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))
    return rows.rollup("symbol").agg(
        (F.grouping_id() == 1).alias("is_total"), F.sum("t").alias("total_ticks"), F.max("time").alias("last_tick_time"),
        F.try_divide(F.sum("t") * F.lit(1e6), span).alias("ticks_per_second"),
        F.avg("spread").alias("avg_spread"), F.sum("b").alias("bars_completed"), F.sum("e").alias("errors"),
    )


def _column_moments(columns: Sequence[str]):
    """Per partition one row for each column; infinite values are counted and left out of the moments."""

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(columns)
        rows, n, up, down = 0, np.zeros(width), np.zeros(width, np.int64), np.zeros(width, np.int64)
        mean, dev = np.zeros(width), np.zeros(width)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for part in parts:
            values = part.to_numpy(float)
            if not len(values):
                continue
            finite = np.isfinite(values)
            rows, up, down = rows + len(values), up + np.isposinf(values).sum(axis=0), down + np.isneginf(values).sum(axis=0)
            low = np.minimum(low, np.where(finite, values, np.inf).min(axis=0))
            high = np.maximum(high, np.where(finite, values, -np.inf).max(axis=0))
            # Mean and squared deviations of the batch, joined to those before.
            count = finite.sum(axis=0)
            own = np.where(finite, values, 0.0).sum(axis=0, dtype=np.longdouble) / np.maximum(count, 1)
            around = (np.where(finite, values - own, 0.0) ** 2).sum(axis=0)
            share, apart = count / np.maximum(n + count, 1), (own - mean).astype(float)
            dev = dev + around.astype(float) + apart * apart * n * share
            mean, n = mean + apart * share, n + count
        if rows:
            yield pd.DataFrame({
                "feature": columns, "rows": rows, "n": n.astype(np.int64), "up": up, "down": down, "low": low, "high": high, "mean": mean, "dev": dev})

    return compute


def profile_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows of the table, missing, infinite, min, max, mean and sample deviation, and how many columns there are.

    One pass: each partition reduces all columns at once to one row each, and these are joined around their common mean.
    Not-a-number is missing. An infinite value is an extreme, makes the mean infinite (not a number with both signs) and
    leaves no deviation.
    """
    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(
        _column_moments(columns), "feature string, rows long, n long, up long, down long, low double, high double, mean double, dev double")
    # Rows are columns times partitions.
    of = Window.partitionBy("feature")
    common = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(of), F.sum("n").over(of))
    step = F.col("mean") - F.col("common")
    joined = found.withColumn("common", common).groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.first("common").alias("common"), F.sum(F.col("dev") + F.col("n") * step * step).alias("dev"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    up, down, inf = F.col("up") > 0, F.col("down") > 0, F.lit(float("inf"))
    seen = F.col("n") > 0
    zero = F.lit(0).cast("long")
    return names.join(joined, "feature", "left").select(
        "feature", F.lit(len(columns)).cast("long").alias("total_features"), F.coalesce("rows", zero).alias("total_rows"),
        F.coalesce(F.col("rows") - F.col("n") - F.col("up") - F.col("down"), zero).alias("missing_values"),
        F.coalesce(F.col("up") + F.col("down"), zero).alias("infinite_values"),
        F.when(down, -inf).when(seen, F.col("low")).when(up, inf).alias("min"),
        F.when(up, inf).when(seen, F.col("high")).when(down, -inf).alias("max"),
        F.when(up & down, F.lit(float("nan"))).when(up, inf).when(down, -inf).otherwise(F.col("common")).alias("mean"),
        F.when(~up & ~down & (F.col("n") > 1), F.sqrt(F.col("dev") / (F.col("n") - 1))).alias("std"),
    )


# Deviations this small against the mean are rounding: the column is constant.
_ROUNDING = 1e-24


def _pair_moments(columns: Sequence[str]):
    """Per partition and pair of columns: rows with both, means and (co)deviations.

    Values are shifted by the partition's first value before they are squared.
    """
    first, second = np.triu_indices(len(columns))

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.full(len(columns), np.nan)
        sums = np.zeros((4, len(columns), len(columns)))
        for part in parts:
            values = part.to_numpy(float)
            there = ~np.isnan(values)
            begin = np.where(there.any(axis=0), values[there.argmax(axis=0), np.arange(len(columns))], np.nan) if len(values) else shift
            shift = np.where(np.isnan(shift), begin, shift)
            x, m = np.where(there, values - shift, 0.0), there.astype(float)
            sums += m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        n, total, squares, products = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = total / n, total.T / n
            cells = {
                "n": n, "mean_a": a + shift[:, None], "mean_b": b + shift[None, :], "aa": squares - n * a * a, "bb": squares.T - n * b * b,
                "ab": products - n * a * b,
            }
        out = pd.DataFrame({"i": first, "j": second, **{k: v[first, second] for k, v in cells.items()}})
        yield out[out.n > 0]

    return compute


def correlate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in long form, both ways round.

    Pairs with a missing or not-a-number value are skipped. Each partition reduces its rows to one
    row for each pair; these are added up around the common mean. A constant column has no
    correlation, not even with itself.
    """
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(
        _pair_moments(columns), "i int, j int, n double, mean_a double, mean_b double, aa double, bb double, ab double")
    # Rows are pairs times partitions.
    pair = Window.partitionBy("i", "j")
    whole = F.sum("n").over(pair)
    centred = parts.withColumns({
        "da": F.col("mean_a") - F.sum(F.col("n") * F.col("mean_a")).over(pair) / whole,
        "db": F.col("mean_b") - F.sum(F.col("n") * F.col("mean_b")).over(pair) / whole,
    })
    n, da, db = F.col("n"), F.col("da"), F.col("db")
    level = lambda m: F.sum(n * F.col(m) * F.col(m)) * _ROUNDING
    summed = centred.groupBy("i", "j").agg(
        F.sum(F.col("aa") + n * da * da).alias("aa"), F.sum(F.col("bb") + n * db * db).alias("bb"),
        F.sum(F.col("ab") + n * da * db).alias("ab"), level("mean_a").alias("small_a"), level("mean_b").alias("small_b"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    corr = F.when(
        (F.col("aa") > F.col("small_a")) & (F.col("bb") > F.col("small_b")),
        F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("ab") / F.sqrt("aa") / F.sqrt("bb")),
    )
    # Every pair of names, also those without a common row.
    spark = df.sparkSession
    pairs = spark.range(len(columns)).select(F.col("id").cast("int").alias("i")).withColumn(
        "j", F.explode(F.sequence(F.col("i"), F.lit(len(columns) - 1))))
    filled = pairs.join(summed, ["i", "j"], "left").select("i", "j", corr.alias("corr"))
    both = F.array_distinct(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    return filled.select("corr", F.explode(both).alias("p")).select(
        F.get(names, F.col("p.a")).alias("col_a"), F.get(names, F.col("p.b")).alias("col_b"), "corr")
