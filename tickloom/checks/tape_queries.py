"""Queries over ticks and bars: scalars, windows, features, bars, joins, sets, sorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.checks import sql as Q
from tickloom.checks.registry import query
from tickloom.functions import scalar as S
from tickloom.operators import bars as B
from tickloom.operators import joins as J
from tickloom.operators import rolling as R
from tickloom.operators import ticks as K
from tickloom.operators.ordered import by_arrival, by_time
from tickloom.plans.tape import extract_features, fill_features
from tickloom.sources import fixtures as fx


def t() -> F.Column:
    return S.whole_seconds(F.col("time")).alias("t")


OHLC = ["open", "high", "low", "close"]


def rounded(columns: list[str] | tuple[str, ...]) -> list[F.Column]:
    """Six decimals, as ``round`` has them. It makes a decimal of each value; where no tie is near, whole numbers give the same."""
    shown = []
    for c in columns:
        value = f"cast({c} as double)"
        millionths = f"(abs({value}) * 1e6D)"
        clear = f"abs({value}) < 1e5D and abs({millionths} - floor({millionths}) - 0.5D) > 1e-3D"
        shown.append(F.expr(f"if({clear}, signum({value}) * floor({millionths} + 0.5D) / 1e6D + 0D, round({value}, 6))").alias(c))
    return shown


def sql_rounded(columns: list[str] | tuple[str, ...], prefix: str = "") -> str:
    return ", ".join(f"round(CAST({prefix}{c} AS DOUBLE), 6) AS {c}" for c in columns)


def bar_rows(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", t(), *OHLC, "volume", "tick_count", *rounded(["mean_mid"]))


SQL_BAR_ROWS = "symbol, t, open, high, low, close, volume, tick_count, round(mean_mid, 6) AS mean_mid"

# --- scalar columns -----------------------------------------------------------------


@query("epoch_to_time", f"""WITH {Q.TICKS}
SELECT tick_id, t AS t, CAST(strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS shown FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    secs = fx.ticks(spark, sf).select("tick_id", F.expr("time_msc div 1000").alias("s"))
    time = S.from_epoch_seconds(F.col("s"))
    return secs.select("tick_id", S.whole_seconds(time).alias("t"), S.stamp(time, "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("time_to_epoch", f"WITH {Q.TICKS} SELECT tick_id, CAST(t AS DOUBLE) AS epoch FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_prices(fx.ticks(spark, sf)).select("tick_id", F.col("timestamp").alias("epoch"))


@query("spread", f"WITH {Q.TICKS} SELECT tick_id, ask - bid AS spread FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_prices(fx.ticks(spark, sf)).select("tick_id", "spread")


@query("mid_price", f"WITH {Q.TICKS} SELECT tick_id, (bid + ask) / 2 AS mid_price FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_prices(fx.ticks(spark, sf)).select("tick_id", "mid_price")


@query("last_default", f"WITH {Q.TICKS} SELECT tick_id, (bid + ask) / 2 AS last FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.fill_defaults(fx.ticks(spark, sf).drop("last")).select("tick_id", "last")


@query("volume_default", f"WITH {Q.TICKS} SELECT tick_id, CAST(1 AS BIGINT) AS volume FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.fill_defaults(fx.ticks(spark, sf).drop("volume")).select("tick_id", "volume")


@query("bar_geometry", f"""WITH {Q.BARS}, g AS (SELECT symbol, t, {Q.GEOMETRY} FROM bars)
SELECT symbol, t, {sql_rounded(['typical_price', 'range', 'body', 'upper_shadow', 'lower_shadow'])} FROM g""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_bar_geometry(fx.bars(spark, sf)).select(
        "symbol", t(), *rounded(["typical_price", "range", "body", "upper_shadow", "lower_shadow"]))


@query("timeframe_label", f"""WITH {Q.EV},
c AS (SELECT event_id, CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 30 WHEN 4 THEN 16385
  WHEN 5 THEN 16388 WHEN 6 THEN 16408 WHEN 7 THEN 43200 END AS code FROM ev)
SELECT event_id, CASE code WHEN 1 THEN 'M1' WHEN 5 THEN 'M5' WHEN 15 THEN 'M15' WHEN 30 THEN 'M30'
  WHEN 16385 THEN 'H1' WHEN 16388 THEN 'H4' WHEN 16408 THEN 'D1' ELSE 'M1' END AS timeframe FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in (*S.TIMEFRAME_LABELS, 43200)])
    code = F.when(k % 9 < 8, F.element_at(codes, k % 9 + 1))
    return fx.events(spark, sf).select("event_id", S.timeframe_label(code).alias("timeframe"))


@query("tagged_bars", f"WITH {Q.BARS} SELECT symbol, t, timeframe FROM bars")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bars(spark, sf).select("symbol", t(), "timeframe")


@query("split_volume", f"WITH {Q.PREPARED} SELECT tick_id, buy AS buy_volume, sell AS sell_volume FROM prepared")
def _(spark: SparkSession, sf: str) -> DataFrame:
    directed = K.with_direction(fx.ticks(spark, sf))
    v, d = F.col("volume"), F.col("direction")
    return directed.select(
        "tick_id", S.directed_volume(v, d, 1).alias("buy_volume"), S.directed_volume(v, d, -1).alias("sell_volume"))


@query("normalize_price", f"""WITH {Q.TICKS}
SELECT tick_id, CAST(length(symbol) % 3 AS INTEGER) AS digits,
  round(last * 1.0001::DOUBLE * pow(10.0::DOUBLE, length(symbol) % 3)) / pow(10.0::DOUBLE, length(symbol) % 3) AS price FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    digits = (F.length("symbol") % 3).cast("int")
    return fx.ticks(spark, sf).select(
        "tick_id", digits.alias("digits"), S.normalize_price(F.col("last") * F.lit(1.0001), digits).alias("price"))


@query("inf_to_zero", f"""WITH {Q.PREPARED}
SELECT tick_id, round(coalesce(CASE WHEN direction = 0 THEN 0 ELSE last / direction END, 0), 6) AS cleaned FROM prepared""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("direction")
    infinite = F.when(d == 0, F.lit(float("inf")) * F.when(F.col("tick_id") % 2 == 0, -1.0).otherwise(1.0))
    ratio = infinite.otherwise(F.try_divide(F.col("last"), d))
    return K.with_direction(fx.ticks(spark, sf)).select("tick_id", F.round(S.finite_or_zero(ratio), 6).alias("cleaned"))


@query("minute_floor", f"WITH {Q.TICKS} SELECT tick_id, t // 60 * 60 AS minute FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ticks(spark, sf).select("tick_id", F.unix_seconds(S.minute_floor(F.col("time"))).alias("minute"))


@query("format_time", f"""WITH {Q.TICKS}
SELECT tick_id, strftime(make_timestamp(t * 1000000), '%Y%m%d_%H%M%S') AS file_stamp,
       strftime(make_timestamp(t * 1000000), '%Y.%m.%d %H:%M:%S') AS message_stamp FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ticks(spark, sf).select(
        "tick_id", S.stamp(F.col("time"), S.FILE_STAMP).alias("file_stamp"),
        S.stamp(F.col("time")).alias("message_stamp"))


@query("grid_test", f"WITH {Q.PREPARED} SELECT tick_id, adheres = 1 AS on_grid FROM prepared")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.operators.ordered import previous
    stepped = previous(fx.ticks(spark, sf), {"before": F.col("last")}, by_time())
    return stepped.select("tick_id", F.coalesce(S.on_grid(F.col("last") - F.col("before")), F.lit(False)).alias("on_grid"))


@query("tick_columns", f"WITH {Q.TICKS} SELECT t, bid, ask, last FROM ticks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ticks(spark, sf).select(t(), "bid", "ask", "last")


@query("bar_columns", f"WITH {Q.BARS} SELECT t, open, high, low, close, tick_count AS tick_volume FROM bars")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bars(spark, sf).select(t(), *OHLC, F.col("tick_count").alias("tick_volume"))


# --- order-dependent columns ----------------------------------------------------------


@query("direction_last", f"WITH {Q.PREPARED} SELECT tick_id, direction FROM prepared")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_direction(fx.ticks(spark, sf)).select("tick_id", "direction")


@query("direction_hourly_reset", f"""WITH {Q.TICKS} SELECT tick_id, coalesce(CAST(sign(last - lag(last) OVER
  (PARTITION BY symbol, t // 3600 ORDER BY t, tick_id)) AS INTEGER), 0) AS direction FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chunked = fx.ticks(spark, sf).withColumn("chunk", F.date_trunc("hour", "time"))
    return K.with_direction(chunked, reset_by="chunk", axis=by_time(seconds=1000)).select("tick_id", "direction")


@query("direction_mid", f"""WITH {Q.TICKS} SELECT tick_id, coalesce(CAST(sign((bid + ask) / 2 - lag((bid + ask) / 2) OVER
  (PARTITION BY symbol ORDER BY t, tick_id)) AS INTEGER), 0) AS direction FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    mid = S.mid_price(F.col("bid"), F.col("ask"))
    return K.with_direction(fx.ticks(spark, sf), mid).select("tick_id", "direction")


_RUN = "(PARTITION BY symbol ORDER BY t, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("running_spread", f"""WITH {Q.TICKS}
SELECT tick_id, round(avg(ask - bid) OVER {_RUN}, 6) AS running_spread FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_running_stats(fx.ticks(spark, sf)).select("tick_id", *rounded(["running_spread"]))


@query("running_counts", f"""WITH {Q.TICKS}
SELECT tick_id, count(*) OVER {_RUN} AS running_ticks, max(t) OVER {_RUN} AS last_t FROM ticks""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_running_stats(fx.ticks(spark, sf)).select(
        "tick_id", "running_ticks", F.unix_seconds("last_tick_time").alias("last_t"))


@query("true_range_atr", f"""WITH {Q.BARS}, {Q.ATR}
SELECT symbol, t, {sql_rounded(['true_range', 'atr_14', 'atr_20', 'atr_50'])} FROM atr""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_atr(fx.bars(spark, sf)).select("symbol", t(), *rounded(["true_range", "atr_14", "atr_20", "atr_50"]))


@query("simple_return", f"WITH {Q.PREPARED} SELECT tick_id, round(ret, 9) AS ret FROM prepared")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_return(fx.ticks(spark, sf)).select("tick_id", F.round("ret", 9).alias("ret"))


# --- rolling features -----------------------------------------------------------------


def _register_feature(name: str) -> None:
    @query(name, Q.feature_query([name]))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        out = R.rolling_features(fx.ticks(spark, sf), [name])
        return out.select("tick_id", "symbol", *rounded(R.feature_columns([name])))


for _name in R.FEATURE_NAMES:
    _register_feature(_name)

_ALL = R.feature_columns()
_FFILL = "(PARTITION BY symbol ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ffilled(columns: list[str]) -> str:
    return ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {_FFILL}, 0) AS {c}" for c in columns)


@query("filled_features", f"""WITH {Q.features_ctes()}, filled AS (SELECT tick_id, {_ffilled(_ALL)} FROM features)
SELECT tick_id, {sql_rounded(_ALL)} FROM filled""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fill_features(R.rolling_features(fx.ticks(spark, sf)), _ALL).select("tick_id", *rounded(_ALL))


def _shown(columns: list[str]) -> list[F.Column]:
    """Six decimals, or eight digits of the logarithm where a price of 1e12 is in the window."""
    return [F.when(F.abs(c) < 1e6, F.round(c, 6)).otherwise(F.signum(c) * F.round(F.ln(F.abs(F.col(c))), 8)).alias(c) for c in columns]


def _sql_shown(columns: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN abs({c}) < 1e6 THEN round(CAST({c} AS DOUBLE), 6) ELSE sign({c}) * round(ln(abs(CAST({c} AS DOUBLE))), 8) END AS {c}" for c in columns)


@query("features_bad_prices", f"WITH {Q.features_ctes(ticks=Q.BAD_PRICES)} SELECT tick_id, symbol, {_sql_shown(_ALL)} FROM features")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Bad prices and volumes count as missing, and a huge one is forgotten with its window."""
    return R.rolling_features(fx.ticks_with_bad_prices(spark, sf)).select("tick_id", "symbol", *_shown(_ALL))


@query("bar_context", f"""WITH {Q.BARS}, {Q.ATR}, {Q.context_cte()}
SELECT tick_id, {sql_rounded(Q.BAR_CONTEXT)} FROM context""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ticks = fx.ticks(spark, sf).select("tick_id", "symbol", "time", "last")
    return J.with_bar_context(ticks, fx.bars(spark, sf)).select("tick_id", *rounded(J.BAR_CONTEXT))


def _bars_from_ticks() -> str:
    return Q.BARS[len(Q.TICKS) + 1:]


@query("tape_features", f"""WITH {Q.features_ctes()}, {_bars_from_ticks()}, {Q.ATR}, {Q.context_cte()},
wide AS (SELECT f.*, {', '.join('c.' + c for c in Q.BAR_CONTEXT)} FROM features f JOIN context c USING (tick_id)),
filled AS (SELECT tick_id, symbol, t, {_ffilled([*_ALL, *Q.BAR_CONTEXT])} FROM wide)
SELECT tick_id, symbol, t, {sql_rounded([*_ALL, *Q.BAR_CONTEXT])} FROM filled""")
def tape_features(spark: SparkSession, sf: str) -> DataFrame:
    out = extract_features(fx.ticks(spark, sf), fx.bars(spark, sf))
    return out.select("tick_id", "symbol", t(), *rounded([*_ALL, *J.BAR_CONTEXT]))


# Ticks with all their keys make the tape; the others stay, with nothing known.
_PLACED = Q.HOLED.replace("ticks AS (\n  SELECT tick_id, symbol", "whole AS (\n  SELECT tick_id, symbol").replace("FROM ticks)", "FROM whole)") + """,
ticks AS (SELECT tick_id, symbol, t, bid, ask, last, volume, row_id FROM holed WHERE tick_id IS NOT NULL AND symbol IS NOT NULL AND t IS NOT NULL)"""


@query("tape_features_null_keys", f"""WITH {Q.features_ctes(ticks=_PLACED, keep='row_id, ')}, filled AS (SELECT row_id, {_ffilled(_ALL)} FROM features)
SELECT h.row_id, h.symbol, {', '.join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in _ALL)}
FROM holed h LEFT JOIN filled f ON f.row_id = h.row_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = extract_features(fx.ticks_with_null_keys(spark, sf), keep=["row_id"])
    return out.select("row_id", "symbol", *rounded(_ALL))


# --- bars -------------------------------------------------------------------------------


@query("minute_bars", f"WITH {Q.BARS} SELECT {SQL_BAR_ROWS} FROM bars")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bar_rows(fx.bars(spark, sf))


def _resampled_sql(seconds: int) -> str:
    return f"""WITH {Q.BARS}, longer AS (
  SELECT symbol, t // {seconds} * {seconds} AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, t) AS close, sum(volume) AS volume, CAST(sum(tick_count) AS BIGINT) AS tick_count,
         sum(mean_mid * tick_count) / sum(tick_count) AS mean_mid
  FROM bars GROUP BY symbol, t // {seconds})
SELECT {SQL_BAR_ROWS} FROM longer"""


def _register_resample(label: str) -> None:
    @query(f"bars_{label.lower()}", _resampled_sql(S.TIMEFRAME_SECONDS[label]))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return bar_rows(B.resample(fx.bars(spark, sf), label))


for _label in ("M5", "M15", "M30", "H1", "H4", "D1"):
    _register_resample(_label)

# --- ranges, sorts, latest rows -----------------------------------------------------------

_FROM = dt.datetime(2024, 1, 1, 2, tzinfo=dt.timezone.utc)
_TO = dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc)
_FROM_S, _TO_S = int(_FROM.timestamp()), int(_TO.timestamp())


def _instant(value: dt.datetime) -> F.Column:
    return F.timestamp_seconds(F.lit(int(value.timestamp())))


@query("ticks_between", f"""WITH {Q.TICKS} SELECT tick_id, symbol, t, bid, ask, last FROM ticks
WHERE symbol IN ('click', 'view') AND t >= {_FROM_S} AND t < {_TO_S}""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.between(fx.ticks(spark, sf), ["click", "view"], _instant(_FROM), _instant(_TO)).select(
        "tick_id", "symbol", t(), "bid", "ask", "last")


@query("bars_between", f"""WITH {Q.BARS} SELECT symbol, t, close FROM bars
WHERE symbol = 'click' AND timeframe = 'M1' AND t >= {_FROM_S} AND t < {_TO_S}""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.between(fx.bars(spark, sf), ["click"], _instant(_FROM), _instant(_TO), "M1").select("symbol", t(), "close")


@query("market_range", f"""WITH {Q.EV},
span AS (SELECT max(epoch_us(ts)) // 86400000000 * 86400 AS day FROM events)
SELECT event_id, epoch_us(ts) // 1000000 AS t FROM ev, span
WHERE epoch_us(ts) >= (day - 30 * 86400 + 32400) * 1000000 AND epoch_us(ts) <= (day + 86399) * 1000000""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    start, end = S.market_range_columns(F.col("as_of"), months=1)
    # The one-row side is a global aggregate: one value, joined by a constant key.
    as_of = e.agg(F.max("ts").alias("as_of")).select(start.alias("start"), end.alias("end"), F.lit(1).alias("one"))
    return (
        e.withColumn("one", F.lit(1)).join(F.broadcast(as_of), "one")
        .filter((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end")))
        .select("event_id", F.unix_seconds("ts").alias("t"))
    )


@query("sorted_ticks", f"WITH {Q.TICKS} SELECT symbol, t, tick_id FROM ticks ORDER BY symbol, t, tick_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.in_order(fx.ticks(spark, sf)).select("symbol", t(), "tick_id")


def _latest_sql(table: str, n: int, order: str, columns: str) -> str:
    return f"""SELECT symbol, {columns}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rank FROM {table}) WHERE rank <= {n}"""


def _register_latest(name: str, n: int, of: str) -> None:
    bars = of == "bars"
    order = "t DESC" if bars else "t DESC, tick_id DESC"
    columns = "t, close" if bars else "tick_id, t, last"
    base = Q.BARS if bars else Q.TICKS

    @query(name, f"WITH {base} {_latest_sql(of, n, order, columns)}")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        if bars:
            return B.latest(fx.bars(spark, sf), n).select("symbol", t(), "close", "rank")
        return B.latest(fx.ticks(spark, sf), n, ("time", "tick_id")).select("symbol", "tick_id", t(), "last", "rank")


for _name, _n, _of in (
    ("latest_bars", 100, "bars"), ("latest_bars_from_position", 10, "bars"), ("bars_kept_in_buffer", 1440, "bars"),
    ("latest_ticks", 100, "ticks"), ("ticks_kept_in_buffer", 10_000, "ticks"),
):
    _register_latest(_name, _n, _of)


@query("first_ticks", f"WITH {Q.TICKS} SELECT t, tick_id, bid, ask, last FROM ticks ORDER BY t, tick_id LIMIT 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ticks(spark, sf).orderBy("time", "tick_id").limit(3).select(t(), "tick_id", "bid", "ask", "last")


@query("last_bars", f"""WITH {Q.BARS} SELECT symbol, t, open, high, low, close, tick_count FROM bars
ORDER BY t DESC, symbol LIMIT 3""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bars(spark, sf).orderBy(F.desc("time"), "symbol").limit(3).select("symbol", t(), *OHLC, "tick_count")


# --- sets ---------------------------------------------------------------------------------

_DUP = Q.TICKS + """, dup AS (SELECT * FROM ticks UNION ALL
  SELECT tick_id + 10000000, symbol, t, bid, ask, last, volume, time_msc, flags, volume_real FROM ticks WHERE tick_id % 11 = 0)"""


@query("concat_chunks", f"WITH {_DUP} SELECT tick_id, symbol, t, last FROM dup")
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = fx.ticks(spark, sf)
    again = base.filter(F.col("tick_id") % 11 == 0).withColumn("tick_id", F.col("tick_id") + 10_000_000)
    return K.concat([base, again]).select("tick_id", "symbol", t(), "last")


@query("first_copies", f"""WITH {_DUP} SELECT symbol, t, bid, ask, min(tick_id) AS tick_id, arg_min(last, tick_id) AS last,
  arg_min(volume, tick_id) AS volume FROM dup GROUP BY symbol, t, bid, ask""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.first_copies(fx.duplicated_ticks(spark, sf)).select("symbol", t(), "bid", "ask", "tick_id", "last", "volume")


@query("cleaned_ticks", f"""WITH {_DUP}, d AS (SELECT *, coalesce(CAST(sign(last - lag(last) OVER
  (PARTITION BY symbol ORDER BY t, tick_id)) AS INTEGER), 0) AS direction FROM dup)
SELECT symbol, t, bid, ask, min(tick_id) AS tick_id, arg_min(direction, tick_id) AS direction,
  arg_min(ask - bid, tick_id) AS spread FROM d GROUP BY symbol, t, bid, ask""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.clean(fx.duplicated_ticks(spark, sf)).select("symbol", t(), "bid", "ask", "tick_id", "direction", "spread")


@query("unique_bars", f"""WITH {Q.BARS}, files AS (SELECT *, 1 AS file_no FROM bars UNION ALL
  SELECT * EXCLUDE (r) REPLACE (volume + 1 AS volume) FROM (SELECT *, 2 AS file_no, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS r FROM bars) WHERE r <= 100)
SELECT symbol, t, arg_max(close, file_no) AS close, arg_max(volume, file_no) AS volume, max(file_no) AS file_no
FROM files GROUP BY symbol, t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bars = fx.bars(spark, sf)
    again = B.latest(bars, 100).drop("rank").withColumns({"file_no": F.lit(2), "volume": F.col("volume") + 1})
    both = K.concat([bars.withColumn("file_no", F.lit(1)), again])
    return B.unique_bars(both).select("symbol", t(), "close", "volume", "file_no")


# --- joins ---------------------------------------------------------------------------------


@query("asof_bars", f"""WITH {Q.BARS}, {Q.ATR}, {Q.context_cte()} SELECT tick_id, bar_t,
  round(ohlc_range, 6) AS range FROM context""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.with_bar_geometry(fx.bars(spark, sf))
    out = J.asof_bars(fx.ticks(spark, sf).select("tick_id", "symbol", "time"), bars, ["range"])
    return out.select("tick_id", F.unix_seconds("bar_time").alias("bar_t"), *rounded(["range"]))


@query("asof_null_keys", f"""WITH {Q.BARS}, {Q.HOLED[len(Q.TICKS) + 2:]} SELECT row_id, k.symbol, b.t AS bar_t, round(b.high - b.low, 6) AS range
FROM holed k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.t >= b.t""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.with_bar_geometry(fx.bars(spark, sf))
    ticks = fx.ticks_with_null_keys(spark, sf).select("tick_id", "row_id", "symbol", "time")
    out = J.asof_bars(ticks, bars, ["range"])
    return out.select("row_id", "symbol", F.unix_seconds("bar_time").alias("bar_t"), *rounded(["range"]))


@query("direction_null_keys", f"""WITH {Q.HOLED}, p AS (SELECT row_id, last, symbol IS NOT NULL AND t IS NOT NULL AS placed,
  lag(last) OVER (PARTITION BY symbol ORDER BY t, tick_id NULLS FIRST) AS before FROM holed WHERE symbol IS NOT NULL AND t IS NOT NULL)
SELECT row_id, coalesce(CAST(sign(last - before) AS INTEGER), 0) AS direction FROM p
UNION ALL SELECT row_id, 0 FROM holed WHERE symbol IS NULL OR t IS NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ticks = fx.ticks_with_null_keys(spark, sf)
    return K.with_direction(ticks.withColumn("tick_id", F.coalesce("tick_id", F.lit(-1))), axis=by_time()).select("row_id", "direction")


@query("asof_closed_bars", f"""WITH {Q.BARS}, {Q.ATR}, {Q.context_cte(60)} SELECT tick_id, bar_t,
  round(ohlc_range, 6) AS range FROM context""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bars = S.with_bar_geometry(fx.bars(spark, sf))
    ticks = fx.ticks(spark, sf).select("tick_id", "symbol", "time")
    out = J.asof_bars(ticks, bars, ["range"], closed_bars_only=True)
    return out.select("tick_id", F.unix_seconds("bar_time").alias("bar_t"), *rounded(["range"]))


@query("join_features", Q.feature_query(R.FEATURE_NAMES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature from one of four separate tables, as their makers group them."""
    ticks = fx.ticks(spark, sf)
    names = R.FEATURE_NAMES
    sets = [R.rolling_features(ticks, group) for group in (names[:5], names[5:10], names[10:16], names[16:])]
    return J.join_features(ticks.select("tick_id", "symbol"), *sets).select("tick_id", "symbol", *rounded(_ALL))


@query("resolve_symbols", """WITH wanted AS (SELECT DISTINCT event_type AS symbol FROM events),
available AS (SELECT DISTINCT CASE WHEN event_type = 'click' THEN event_type WHEN event_type = 'view' THEN 'view.BMF'
  WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'purchase.SIR' WHEN event_type = 'purchase' THEN 'purchase.WDO'
  WHEN event_type = 'signup' THEN 'signup.OLD' END AS symbol FROM events)
SELECT w.symbol, coalesce(max(CASE WHEN a.symbol = w.symbol THEN a.symbol END), max(CASE WHEN a.symbol = w.symbol || '.SIR' THEN a.symbol END),
  max(CASE WHEN a.symbol = w.symbol || '.BMF' THEN a.symbol END), max(CASE WHEN a.symbol = w.symbol || '.WDO' THEN a.symbol END)) AS resolved
FROM wanted w LEFT JOIN available a ON a.symbol LIKE w.symbol || '%' GROUP BY w.symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    kind = F.col("event_type")
    listed = (
        F.when(kind == "click", kind).when(kind == "view", "view.BMF")
        .when((kind == "purchase") & (F.col("event_id") % 2 == 0), "purchase.SIR")
        .when(kind == "purchase", "purchase.WDO").when(kind == "signup", "signup.OLD")
    )
    return J.resolve_symbols(e.select(kind.alias("symbol")).distinct(), e.select(listed.alias("symbol")).distinct())


_INFO_SQL = """info AS (SELECT event_type AS symbol, pow(10.0::DOUBLE, -(length(event_type) % 3)) AS point, CAST(length(event_type) % 3 AS INTEGER) AS digits,
  0.5::DOUBLE AS tick_size, CAST(length(event_type) AS DOUBLE) AS contract_size, max(value) AS margin_initial,
  'BRL' AS currency_base, 'BRL' AS currency_profit, 'BRL' AS currency_margin FROM events GROUP BY event_type)"""


@query("symbol_info", f"""WITH {Q.TICKS}, {_INFO_SQL} SELECT tick_id, k.symbol, point, digits, tick_size, contract_size,
  margin_initial, currency_base, currency_profit, currency_margin FROM ticks k LEFT JOIN info i ON k.symbol = i.symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("event_type")
    info = fx.events(spark, sf).groupBy("event_type").agg(F.max("value").alias("margin_initial")).select(
        F.col("event_type").alias("symbol"), F.pow(F.lit(10.0), -(size % 3)).alias("point"),
        (size % 3).cast("int").alias("digits"), F.lit(0.5).alias("tick_size"),
        size.cast("double").alias("contract_size"), "margin_initial",
        *[F.lit("BRL").alias(f"currency_{c}") for c in ("base", "profit", "margin")])
    return J.with_symbol_info(fx.ticks(spark, sf).select("tick_id", "symbol"), info)


@query("newer_ticks", f"""WITH {Q.TICKS}, s AS (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY tick_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ticks)
SELECT tick_id, symbol, t FROM s WHERE seen IS NULL OR t > seen""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.newer_only(fx.ticks(spark, sf), by_arrival()).select("tick_id", "symbol", t())


SENT_SQL = f"""WITH {Q.TICKS}, s AS (SELECT *, max(t) OVER (PARTITION BY symbol ORDER BY tick_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ticks)
SELECT tick_id, symbol, t, coalesce(CAST(sign(last - lag(last) OVER (PARTITION BY symbol ORDER BY tick_id)) AS INTEGER), 0) AS direction
FROM s WHERE seen IS NULL OR t > seen"""


@query("sent_direction", SENT_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    sent = K.newer_only(fx.ticks(spark, sf), by_arrival(block=1024))
    return K.sent_direction(sent, by_arrival(block=1024)).select("tick_id", "symbol", t(), "direction")
