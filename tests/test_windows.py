"""Window features on hand-made and random frames."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.reference_windows import brute_force
from tickloom.checks.tape_queries import rounded
from tickloom.operators import counting
from tickloom.operators.rolling import FEATURE_NAMES, feature_columns, rolling_features

START = pd.Timestamp("2024-01-01 00:00:00")


def frame(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp"))


def tape(seed: int, n: int, step_ms, hot: float = 0.7) -> pd.DataFrame:
    """Random walk with ties, gaps of hours and one symbol with most of the rows."""
    rng = np.random.default_rng(seed)
    gaps = rng.choice(step_ms, n).astype("int64")
    last = 1000 + 0.25 * np.cumsum(rng.integers(-3, 4, n))
    return pd.DataFrame({
        "tick_id": np.arange(n), "symbol": np.where(rng.random(n) < hot, "hot", "cold"),
        "time": START + pd.to_timedelta(np.cumsum(gaps), unit="ms"),
        "bid": last - 0.5 * rng.integers(1, 3, n), "ask": last + 0.5, "last": last,
        "volume": rng.choice([0, 1, 2, 50], n).astype("int64"),
    })


def check(spark, pdf: pd.DataFrame, windows, slice_seconds: int) -> None:
    got = rolling_features(frame(spark, pdf), windows=windows, slice_seconds=slice_seconds).toPandas()
    assert len(got) == len(pdf)
    got = got.set_index("tick_id").sort_index()
    for w in windows:
        want = brute_force(pdf, w)
        for name in FEATURE_NAMES:
            a, b = got[f"{name}_{w}s"].astype(float), want[name].astype(float)
            assert (a.isna() == b.isna()).all(), (name, w)
            np.testing.assert_allclose(a.fillna(0), b.fillna(0), atol=1e-7, err_msg=f"{name} {w}")


@pytest.mark.parametrize("seed, step_ms, slice_seconds", [
    (1, [0, 0, 1000, 2000, 5000], 600),             # ties, whole seconds, several slices
    (2, [0, 1, 40, 250, 999, 1001], 7),             # sub-second times, slices shorter than windows
    (3, [0, 1000, 30_000, 900_000, 9_000_000], 600),  # gaps longer than slices
])
def test_features_equal_brute_force(spark, seed, step_ms, slice_seconds):
    windows = [10, 600]
    check(spark, tape(seed, 400, step_ms), windows, slice_seconds)


def test_slice_length_does_not_matter(spark):
    pdf = tape(4, 500, [0, 500, 1000, 60_000])
    names = feature_columns(windows=[30, 300])
    runs = [
        rolling_features(frame(spark, pdf), windows=[30, 300], slice_seconds=s).toPandas()
        .set_index("tick_id").sort_index()[names]
        for s in (300, 1234, 4, 10_000_000)
    ]
    for other in runs[1:]:
        pd.testing.assert_frame_equal(runs[0], other, atol=1e-9, rtol=0)


def test_window_edges_and_ties(spark):
    pdf = pd.DataFrame({
        "tick_id": range(6), "symbol": "a",
        "time": START + pd.to_timedelta([0, 0, 5, 5, 10, 15], unit="s"),
        "bid": 1.0, "ask": 2.0, "last": 1.5, "volume": [1, 2, 4, 8, 16, 32],
    })
    out = rolling_features(frame(spark, pdf), ["volume_velocity"], [10], min_ticks=1)
    sums = [round(r[0] * 10) for r in out.orderBy("tick_id").select("volume_velocity_10s").collect()]
    assert sums == [1, 3, 7, 15, 28, 48]


def test_flat_prices_and_no_volume(spark):
    pdf = pd.DataFrame({
        "tick_id": range(8), "symbol": "a", "time": START + pd.to_timedelta(range(8), unit="s"),
        "bid": 0.1, "ask": 0.3, "last": 0.2, "volume": 0,
    })
    row = rolling_features(frame(spark, pdf), windows=[60]).orderBy(F.desc("tick_id")).first()
    assert row["rejection_strength_60s"] == 0 and row["trend_consistency_60s"] == 0
    assert row["buy_pressure_60s"] == 0 and row["volume_spike_60s"] is None
    assert row["spread_volatility_60s"] == 0 and row["volatility_60s"] == 0
    assert row["level_tests_60s"] == 8


def test_single_tick_and_missing_columns(spark):
    pdf = tape(5, 1, [0]).drop(columns=["last", "volume"])
    row = rolling_features(frame(spark, pdf), windows=[60]).first()
    assert row["momentum_60s"] is None and row["volatility_60s"] is None


def test_given_direction_is_used(spark):
    pdf = tape(6, 20, [100]).assign(direction=1, symbol="a")
    row = rolling_features(frame(spark, pdf), ["momentum"], [60]).orderBy(F.desc("tick_id")).first()
    assert row["momentum_60s"] == 20


def test_range_counts_and_maxima():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 333):
        values = rng.choice([0.5, 1.0, 2.0, 7.25, 9.0], n)
        hi = np.arange(1, n + 1)
        lo = np.array([rng.integers(0, h) for h in hi])
        least = rng.choice([0.0, 0.75, 2.0, 9.0, 10.0], n)
        counts = counting.count_at_least(values, least, lo, hi)
        assert list(counts) == [int((values[a:b] >= t).sum()) for a, b, t in zip(lo, hi, least)]
        assert list(counting.range_max(values, lo, hi)) == [values[a:b].max() for a, b in zip(lo, hi)]


def test_plan_shuffles_on_symbol_and_slice_only(spark):
    df = rolling_features(frame(spark, tape(8, 50, [100])), ["momentum", "range_velocity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Ticks move twice; the other shuffles (at most three) carry one row per slice.
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) <= 5 and sum("_home" in line for line in moves) == 1


@pytest.mark.parametrize("name", ["level_tests", "volatility", "large_print_ratio", "spread_volatility"])
def test_feature_alone_sees_the_rows_before_its_slice(spark, name):
    """Rows of earlier slices leave after the values are found, also where no window of Spark's stands between."""
    df = rolling_features(frame(spark, tape(9, 50, [1000])), [name], [60], slice_seconds=10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.splitlines() if "Filter" in line and "_own" in line]
    assert len(own) == 1 and plan.index(own[0]) < plan.index("ArrowEvalPython")


def test_rows_of_a_window_are_not_gone_through_again_for_every_batch(monkeypatch):
    """A window of many batches: rows looked at grow with the rows, and the answers are those of one batch."""
    n, windows, looked = 60_000, (10, 600), []
    rng = np.random.default_rng(0)
    columns = [np.arange(1, n + 1), np.sort(rng.integers(0, 300, n)) * 1_000_000, 1000 + rng.integers(0, 20, n) / 2, rng.integers(1, 90, n)]
    moments = counting.range_moments
    monkeypatch.setattr(counting, "range_moments", lambda values, *a, **b: looked.append(len(values)) or moments(values, *a, **b))
    names = [f"{f}_{w}s" for f in counting.FEATURES for w in windows] + ["_dev_last_10"]
    monkeypatch.setattr(counting, "SPREADING", ("last",))
    run = counting._in_stretches(counting.FEATURES, ["last"], ["last", "volume"], windows, 5, names)
    whole = pd.concat(run(iter([tuple(map(pd.Series, columns))])))
    assert looked == [n, n]
    looked.clear()
    found = list(run(tuple(pd.Series(c[a:a + 1000]) for c in columns) for a in range(0, n, 1000)))
    assert sum(looked) < 8 * n and max(map(len, found)) <= counting.ANSWER_ROWS
    pd.testing.assert_frame_equal(pd.concat(found, ignore_index=True), whole.reset_index(drop=True), check_exact=True)


def test_a_dense_window_takes_little_memory():
    """What a Python worker allocates for each row of its longest window, with all columns of the features."""
    in_window, windows, moments = 60_000, (10, 30, 60, 300, 600), ["mid", "ret", "spread"]
    names = [f"_{p}_{n}_{w}" for n in moments for w in windows for p in ("n", "mean", "dev") if p != "dev" or n in counting.SPREADING]
    names += [f"{f}_{w}s" for f in counting.FEATURES for w in windows]
    run = counting._in_stretches(counting.FEATURES, moments, [*moments, "last", "volume"], windows, 5, names)
    rng = np.random.default_rng(1)

    def parts():
        for at in range(0, 3 * in_window, 10_000):
            row = np.arange(at, at + 10_000)
            values = [1000 + rng.integers(0, 40, 10_000) / 4, rng.normal(size=10_000), 1.0 * rng.integers(1, 4, 10_000),
                      1000 + rng.integers(0, 40, 10_000) / 2, 1.0 * rng.integers(1, 90, 10_000)]
            yield tuple(map(pd.Series, (row + 1, row * 600 // in_window * 1_000_000, *values)))

    tracemalloc.start()
    try:
        rows = sum(map(len, run(parts())))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 3 * in_window and peak < 900 * in_window


def test_shown_decimals_are_those_of_round(spark):
    values = [0.0, -0.0, 1.5, -2.25, 5e-7, -5e-7, 1.0000005, 2.0000015, 0.1234565, -1e-9, 99999.9999995, 1e5, 1e12 + 0.5, float("inf"), float("nan"), None]
    values += [float(x) for x in np.random.default_rng(3).normal(size=2000) * 1000]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    shown = df.select(F.round("x", 6).cast("string").alias("a"), rounded(["x"])[0].cast("string").alias("b"))
    assert shown.where("not (a <=> b)").count() == 0
