"""Histories, cleaning, joins, messages and streams on small frames."""

from __future__ import annotations

import datetime as dt
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_windows import START, frame, tape
from tickloom.functions import scalar as S
from tickloom.operators import bars as B
from tickloom.operators import joins as J
from tickloom.operators import messages as M
from tickloom.operators import quality as V
from tickloom.operators import rolling as R
from tickloom.operators import ticks as K
from tickloom.operators.ordered import by_arrival, by_time, last_known, previous, running
from tickloom.plans.tape import extract_features, fill_features
from tickloom.session import scratch_path
from tickloom.sources import fixtures as fx
from tickloom.sources import tables
from tickloom.streaming import live


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def random_tape():
    return tape(11, 300, [0, 1000, 7000, 4_000_000])


def test_previous_and_running_across_slices(spark, random_tape):
    df = frame(spark, random_tape)
    for axis, order in ((by_time(seconds=10), ["time", "tick_id"]), (by_arrival(block=7), ["tick_id"])):
        want = random_tape.sort_values(order)
        g = want.groupby("symbol")
        want = want.assign(before=g["last"].shift(), total=g["volume"].cumsum(), top=g["last"].cummax())
        got = running(
            previous(df, {"before": F.col("last")}, axis), axis, sums={"total": F.col("volume")}, maxima={"top": F.col("last")}
        ).toPandas().set_index("tick_id").sort_index()
        want = want.set_index("tick_id").sort_index()
        for column in ("before", "total", "top"):
            pd.testing.assert_series_equal(got[column], want[column], check_dtype=False)


def test_last_known_across_slices(spark, random_tape):
    holed = random_tape.assign(x=random_tape["last"].where(random_tape.tick_id % 5 == 0))
    got = last_known(frame(spark, holed), {"seen": F.nanvl("x", F.lit(None))}, by_time(seconds=10)).toPandas()
    want = holed.sort_values(["time", "tick_id"]).assign(seen=lambda d: d.groupby("symbol")["x"].ffill())
    pd.testing.assert_series_equal(
        got.set_index("tick_id")["seen"].sort_index(), want.set_index("tick_id")["seen"].sort_index())


def test_fill_order(spark):
    inf = float("inf")
    pdf = pd.DataFrame({
        "tick_id": range(6), "symbol": ["a"] * 5 + ["b"], "time": START + pd.to_timedelta(range(6), unit="h"),
        "x": [None, 2.0, None, inf, float("nan"), None],
    })
    df = frame(spark, pdf)
    assert [r[0] for r in rows(fill_features(df, ["x"]).orderBy("tick_id"), "x")] == [0, 2, 2, 0, 0, 0]


def test_extract_without_bars_has_no_gaps(spark, random_tape):
    out = extract_features(frame(spark, random_tape), features=["momentum", "level_tests"], windows=[10, 60])
    assert out.count() == len(random_tape) and out.dropna().count() == len(random_tape)


def test_extract_runs_the_windows_once(spark):
    """The fill reads one shuffle twice: a single Python step in the plan that ran, and only its own columns go there."""
    sf = "/root/testdata/sf0.001"
    out = extract_features(fx.ticks(spark, sf), fx.bars(spark, sf))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    steps = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(steps) == 1 and "FlatMapGroups" not in plan and "MapInPandas" not in plan
    sent = steps[0][steps[0].index("run("):steps[0].index(")#")]
    assert set(re.findall(r"(\w+)#", sent)) == {"_c_n", "_us", "last", "volume", "bid", "ask", "_ret", "spread"}


def _ran(df) -> list[str]:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_the_fill_makes_its_rows_once(spark):
    """The last rows of the slices come from the shuffle that the rows come from, and the windows below it run once."""
    sf = "/root/testdata/sf0.001"
    features, columns = ["momentum", "volatility"], ["momentum_60s", "volatility_60s"]
    filled = _ran(fill_features(R.rolling_features(fx.ticks(spark, sf), features, [60]), columns))
    table = _ran(extract_features(fx.ticks(spark, sf), None, features, [60]))
    for plan in (filled, table):
        assert sum("Window [max(_snap" in x for x in plan) == 1 and any("ReusedExchange" in x for x in plan)


def test_a_fill_leaves_rows_without_keys_to_themselves(spark):
    rows = [(1, "a", 0, 1.0), (2, "a", 1, None), (3, "a", 9000, None), (4, None, 2, 5.0), (5, None, 2, None), (6, "a", None, 7.0), (6, "a", None, None),
            (7, "", 3, None), (8, "a", 9001, float("inf"))]
    df = spark.createDataFrame(rows, "tick_id long, symbol string, s long, x double").selectExpr("tick_id", "symbol", "timestamp_seconds(s) as time", "x")
    got = sorted((r["tick_id"], r["x"]) for r in fill_features(df, ["x"]).collect())
    assert got == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 5.0), (5, 0.0), (6, 0.0), (6, 7.0), (7, 0.0), (8, 0.0)]


def test_rows_without_keys_stay(spark, random_tape):
    holed = frame(spark, random_tape).withColumn("symbol", F.when(F.col("tick_id") % 10 != 0, F.col("symbol")))
    out = extract_features(holed, features=["momentum", "volatility"], windows=[60])
    assert out.count() == len(random_tape)
    assert out.filter("symbol is null").agg(F.max("momentum_60s"), F.min("momentum_60s")).first() == (0.0, 0.0)


@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan"), None, 1e12, -1e300])
def test_a_bad_price_leaves_with_its_window(spark, bad):
    """Windows that do not hold it are as if it had never been, in every column."""
    good = tape(5, 400, [1000, 2000, 5000])
    spoiled = good.copy()
    at = len(good) // 3
    for column in ("bid", "ask", "last"):
        spoiled[column] = spoiled[column].astype(object)
        spoiled.loc[at, column] = bad
    schema = "tick_id long, symbol string, time timestamp, bid double, ask double, last double, volume long"
    names = [c.split()[0] for c in schema.split(", ")]
    spoiled_rows = [(int(i), s, t.to_pydatetime(), b, a, x, int(v)) for i, s, t, b, a, x, v in spoiled[names].itertuples(index=False)]
    columns = R.feature_columns(windows=[10, 60])
    want, got = (
        R.rolling_features(d, windows=[10, 60]).toPandas().set_index("tick_id").sort_index()
        for d in (frame(spark, good), spark.createDataFrame(spoiled_rows, schema)))
    row = good.loc[at]
    gap = (good.time - row.time).dt.total_seconds()
    # Its successor's change and return look back at it, wherever that lies.
    after = good[(good.symbol == row.symbol) & (good.tick_id > row.tick_id)].sort_values(["time", "tick_id"])
    beyond = good[(good.symbol != row.symbol) | (gap < 0) | (gap > 130)].tick_id
    beyond = beyond[~beyond.isin(after.tick_id.head(60))]
    assert len(beyond) > 100
    pd.testing.assert_frame_equal(got.loc[beyond, columns], want.loc[beyond, columns], rtol=1e-9, atol=1e-12)



def test_asof_before_first_bar_and_over_gaps(spark):
    ticks = frame(spark, pd.DataFrame({
        "tick_id": [1, 2, 3, 4], "symbol": ["a", "a", "a", "b"],
        "time": START + pd.to_timedelta([0, 60, 90_000, 90_000], unit="s")}))
    bars = frame(spark, pd.DataFrame({
        "symbol": ["a", "a"], "time": START + pd.to_timedelta([60, 120], unit="s"), "timeframe": "M1", "close": [5.0, 6.0]}))
    out = J.asof_bars(ticks, bars, ["close"])
    assert dict(rows(out, "tick_id", "close")) == {1: None, 2: 5.0, 3: 6.0, 4: None}
    closed = J.asof_bars(ticks, bars, ["close"], closed_bars_only=True)
    assert dict(rows(closed, "tick_id", "close")) == {1: None, 2: None, 3: 6.0, 4: None}


def test_first_copy_wins(spark):
    pdf = tape(12, 4, [0]).assign(symbol="a", bid=1.0, ask=2.0, last=[9.0, 8.0, 7.0, 6.0])
    assert rows(K.first_copies(frame(spark, pdf)), "tick_id", "last") == [(0, 9.0)]


def test_newer_only_and_sent_direction(spark, random_tape):
    shuffled = random_tape.assign(time=random_tape.time.sample(frac=1, random_state=1).values)
    df = frame(spark, shuffled)
    want, top, price = [], {}, {}
    for r in shuffled.itertuples():
        if r.symbol in top and r.time <= top[r.symbol]:
            continue
        change = r.last - price.get(r.symbol, r.last)
        want.append((r.tick_id, (change > 0) - (change < 0)))
        top[r.symbol], price[r.symbol] = r.time, r.last
    sent = K.sent_direction(K.newer_only(df, by_arrival(block=16)), by_arrival(block=16))
    assert sorted(rows(sent, "tick_id", "direction")) == want


def test_atr_needs_whole_period(spark):
    pdf = pd.DataFrame({
        "symbol": "a", "time": START + pd.to_timedelta(range(20), unit="min"),
        "open": 1.0, "high": 3.0, "low": 1.0, "close": 2.0})
    out = B.with_atr(frame(spark, pdf)).orderBy("time").toPandas()
    assert out.atr_14.isna().sum() == 13 and out.atr_14.iloc[-1] == 2.0 and out.atr_50.isna().all()


def test_gate(spark):
    pdf = tape(13, 120, [1000])
    pdf.loc[50, "time"] = START
    row = V.check_ticks(frame(spark, pdf)).first()
    assert (row.row_count, row.steps_back, row.valid, row.in_order) == (120, 1, True, False)
    assert not V.check_ticks(frame(spark, pdf.head(99))).first().valid


def test_profile_and_wide_correlation(spark):
    pdf = pd.DataFrame({f"c{i}": [(i * 7 + j * j * (i + 1)) % 11 for j in range(30)] for i in range(21)}).astype(float)
    wide = spark.createDataFrame(pdf)
    got = V.correlate(wide, list(pdf)).toPandas().pivot(index="col_a", columns="col_b", values="corr")
    pd.testing.assert_frame_equal(got.loc[list(pdf), list(pdf)], pdf.corr(), check_names=False, atol=1e-9)
    bad = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    row = V.profile_features(bad, ["x"]).first()
    assert (row.missing_values, row.infinite_values, row["min"]) == (2, 1, 1.0)


def test_signal_matching_boundaries(spark):
    def at(s):
        return START + pd.to_timedelta(s, unit="s")
    requests = frame(spark, pd.DataFrame({"msg_id": [1, 2, 3], "symbol": "a", "time": at([3599.5, 10.0, 20.0])}))
    answers = frame(spark, pd.DataFrame({
        "msg_id": [11, 12, 13, 14], "symbol": "a", "time": at([3600.2, 10.0, 11.0, 21.5]), "direction": 1, "confidence": 0.5}))
    out = J.match_signals(requests, answers)
    assert dict(rows(out, "msg_id", "response_id")) == {1: 11, 2: 13, 3: None}


def test_messages_are_json_and_round_trip(spark):
    df = spark.createDataFrame(
        [("S\"1\\\n", 1, 0.25, dt.datetime(2024, 1, 1))], "symbol string, direction int, confidence double, sent_at timestamp")
    lines = M.encode(df, 3).select("value")
    doc = json.loads(lines.first()[0])
    assert doc["symbol"] == "S\"1\\\n" and doc["confidence"] == 0.25 and '"confidence":0.25000000' in lines.first()[0]
    assert rows(M.decode_signals(lines), "symbol", "direction", "confidence") == [("S\"1\\\n", 1, 0.25)]


def test_heartbeat_limit_is_strict(spark):
    beats = frame(spark, pd.DataFrame({"msg_id": [1, 2, 3], "time": START + pd.to_timedelta([0, 60, 121], unit="s")}))
    out = M.heartbeat_gaps(beats, F.lit(START + pd.to_timedelta(130, unit="s")).cast("timestamp"), slice_seconds=10)
    assert rows(out.orderBy("msg_id"), "gap_seconds", "lost") == [(60.0, False), (61.0, True), (9.0, False)]
    assert rows(M.live_spans(beats, slice_seconds=10).orderBy("span"), "beats") == [(2,), (1,)]


def test_market_range_and_labels(spark):
    start, end = S.market_date_range(dt.datetime(2024, 7, 10, 15, 30), 6)
    assert (start, end) == (dt.datetime(2024, 1, 12, 9), dt.datetime(2024, 7, 10, 23, 59, 59))
    codes = spark.createDataFrame([(16385,), (7,), (None,)], "code int")
    assert [r[0] for r in rows(codes, S.timeframe_label(F.col("code")))] == ["H1", "M1", "M1"]


def test_range_filter_reaches_folders(spark, random_tape):
    path = scratch_path(spark, "ticks")
    full = frame(spark, random_tape).withColumns({
        "time_msc": F.lit(0).cast("long"), "flags": F.lit(0), "volume_real": F.lit(1.0)})
    tables.write_ticks(full, path)
    day = dt.datetime(2024, 1, 2)
    out = K.between(tables.read_ticks(spark, path), ["hot"], F.lit(day), F.lit(day + dt.timedelta(days=1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "symbol" in folders and "date" in folders and "GreaterThanOrEqual(time" in plan
    want = random_tape[(random_tape.symbol == "hot") & (random_tape.time >= day) & (random_tape.time < day + dt.timedelta(days=1))]
    assert out.count() == len(want) > 0


def test_profile_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, inf, None, 7.0, inf), (3.0, 2.0, None, 7.0, -inf), (None, nan, nan, 7.0, 1.0), (5.0, None, None, 7.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    got = {r["feature"]: tuple(r)[2:] for r in V.profile_features(df, list("abcde")).collect()}
    assert got["a"] == (4, 1, 0, 1.0, 5.0, 3.0, 2.0)
    assert got["b"] == (4, 2, 1, 2.0, inf, inf, None)
    assert got["c"] == (4, 4, 0, None, None, None, None)
    assert got["d"] == (4, 0, 0, 7.0, 7.0, 7.0, 0.0)
    assert got["e"][:5] == (4, 1, 2, -inf, inf) and got["e"][5] != got["e"][5] and got["e"][6] is None
    empty = V.profile_features(df.limit(0), ["a"]).collect()
    assert [tuple(r) for r in empty] == [("a", 1, 0, 0, 0, None, None, None, None)]
