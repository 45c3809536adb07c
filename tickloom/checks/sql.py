"""SQL building blocks: the derived tables in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Sequence

from tickloom.operators.rolling import FEATURE_NAMES, MIN_TICKS, WINDOWS, feature_columns

BASE_US = 1_704_067_200_000_000

EV = f"""ev AS (
  SELECT *, {BASE_US} + (epoch_us(ts) - {BASE_US}) // 100 AS us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

# ``t`` is the time in whole seconds.
TICKS = EV + """,
raw_ticks AS (
  SELECT event_id AS tick_id, event_type AS symbol, us // 1000000 AS t, us // 1000 AS time_msc,
         1000.0::DOUBLE + 0.5::DOUBLE * (k % 20)
           + CASE WHEN event_id % 7 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS last,
         1 + CAST(floor(value) AS BIGINT) AS volume,
         CAST(event_id % 8 AS INTEGER) AS flags
  FROM ev),
ticks AS (
  SELECT tick_id, symbol, t, last - 0.5::DOUBLE * (1 + tick_id % 3) AS bid, last + 0.5::DOUBLE AS ask,
         last, volume, time_msc, flags, CAST(volume AS DOUBLE) AS volume_real
  FROM raw_ticks)"""

# Every tenth row lacks one of its keys.
HOLED = TICKS + """,
holed AS (
  SELECT CASE WHEN tick_id % 30 <> 20 THEN tick_id END AS tick_id, CASE WHEN tick_id % 30 <> 0 THEN symbol END AS symbol,
         CASE WHEN tick_id % 30 <> 10 THEN t END AS t, bid, ask, last, volume, tick_id AS row_id
  FROM ticks)"""

BARS = TICKS + """,
bars AS (
  SELECT symbol, t // 60 * 60 AS t, 'M1' AS timeframe,
         arg_min((bid + ask) / 2, tick_id) AS open, max((bid + ask) / 2) AS high,
         min((bid + ask) / 2) AS low, arg_max((bid + ask) / 2, tick_id) AS close,
         sum(volume_real) AS volume, count(*) AS tick_count, avg((bid + ask) / 2) AS mean_mid
  FROM ticks GROUP BY symbol, t // 60)"""

# Ticks with predecessor values and the row-causal key: unique, and 2048 apart per second.
STEP = 2048
_PREPARE = f""",
lagged AS (
  SELECT *, ask - bid AS spread, (bid + ask) / 2 AS mid,
         t * {STEP} + row_number() OVER (PARTITION BY symbol, t ORDER BY tick_id) - 1 AS key,
         lag(last) OVER o AS p_last, lag(bid) OVER o AS p_bid, lag(ask) OVER o AS p_ask
  FROM ticks WINDOW o AS (PARTITION BY symbol ORDER BY t, tick_id)),
directed AS (
  SELECT *, coalesce(CAST(sign(last - p_last) AS INTEGER), 0) AS direction,
         (last - p_last) / p_last AS ret,
         CAST(coalesce(bid <> p_bid, true) AS BIGINT) AS bid_chg,
         CAST(coalesce(ask <> p_ask, true) AS BIGINT) AS ask_chg,
         CAST(coalesce((last - p_last) % 0.5::DOUBLE = 0, false) AS BIGINT) AS adheres,
         CAST((last - p_last) IS NOT NULL AS BIGINT) AS pair
  FROM lagged),
prepared AS (
  SELECT *, CASE WHEN direction = 1 THEN volume ELSE volume * 0 END AS buy,
         CASE WHEN direction = -1 THEN volume ELSE volume * 0 END AS sell,
         CAST(coalesce(direction <> lag(direction) OVER o, true) AS BIGINT) AS dir_chg,
         CASE WHEN count(volume) OVER m >= 10 THEN avg(volume) OVER m END AS volume_mean
  FROM directed
  WINDOW o AS (PARTITION BY symbol ORDER BY key),
         m AS (PARTITION BY symbol ORDER BY key ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
PREPARED = TICKS + _PREPARE

# Every 101st tick has a bad price; what is no finite number is missing.
BAD_PRICES = EV + TICKS[len(EV):].replace("ticks AS (\n  SELECT tick_id, symbol", "whole AS (\n  SELECT tick_id, symbol") + """,
ticks AS (
  SELECT * REPLACE (
    CASE WHEN kind IN (0, 4) THEN NULL WHEN kind = 6 THEN 1e12::DOUBLE ELSE bid END AS bid,
    CASE WHEN kind IN (1, 5) THEN NULL ELSE ask END AS ask,
    CASE WHEN kind IN (2, 3, 5) THEN NULL WHEN kind = 7 THEN 1e12::DOUBLE ELSE last END AS last,
    CASE WHEN kind = 4 THEN NULL ELSE volume END AS volume)
  FROM (SELECT *, CASE WHEN tick_id % 101 = 0 THEN tick_id // 101 % 8 ELSE -1 END AS kind FROM whole))"""

MESSAGES = EV + """,
messages AS (
  SELECT event_id AS msg_id, us,
         CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
                         WHEN 'view' THEN 6 WHEN 'error' THEN 99 END AS type,
         'S' || CAST(user_id % 5 AS VARCHAR) AS symbol,
         k % 3 - 1 AS direction, k / 100.0::DOUBLE AS confidence, value
  FROM ev)"""

GEOMETRY = """(high + low + close) / 3 AS typical_price, high - low AS range, abs(close - open) AS body,
       high - greatest(open, close) AS upper_shadow, least(open, close) - low AS lower_shadow"""

_FORMULAS = {
    "tick_velocity": "n_{w} / {w}.0",
    "price_velocity": "(last - first_last_{w}) / {w}.0",
    "volatility": "sd_ret_{w}",
    "range_velocity": "(hi_{w} - lo_{w}) / {w}.0",
    "momentum": "CAST(s_dir_{w} AS DOUBLE)",
    "trend_consistency": "CASE WHEN up_{w} + down_{w} = 0 THEN 0.0 ELSE greatest(up_{w}, down_{w}) / (up_{w} + down_{w}) END",
    "rejection_strength": "CASE WHEN hi_{w} = lo_{w} THEN 0.0 ELSE 1 - abs(last - first_last_{w}) / (hi_{w} - lo_{w}) END",
    "level_tests": "CAST(greatest(len(list_filter(lasts_{w}, lambda x: x >= hi_{w} * 0.9999::DOUBLE)),"
                   " len(list_filter(lasts_{w}, lambda x: x <= lo_{w} * 1.0001::DOUBLE))) AS DOUBLE)",
    "directional_persistence": "1 - (s_chg_{w} - f_chg_{w} + 1) / n_{w}",
    "buy_pressure": "s_buy_{w} / CASE WHEN s_vol_{w} = 0 THEN 1 ELSE s_vol_{w} END",
    "sell_pressure": "s_sell_{w} / CASE WHEN s_vol_{w} = 0 THEN 1 ELSE s_vol_{w} END",
    "volume_imbalance": "(s_buy_{w} - s_sell_{w}) / CASE WHEN s_vol_{w} = 0 THEN 1 ELSE s_vol_{w} END",
    "volume_spike": "s_vol_{w} / nullif(volume_mean, 0)",
    "large_print_ratio": "len(list_filter(volumes_{w}, lambda x: x > 3 * a_vol_{w})) / n_{w}",
    "volume_velocity": "s_vol_{w} / {w}.0",
    "spread_normalized": "a_spread_{w} / CASE WHEN a_mid_{w} = 0 THEN 1 ELSE a_mid_{w} END",
    "spread_volatility": "sd_spread_{w}",
    "bid_change_freq": "(s_bchg_{w} - f_bchg_{w} + 1) / {w}.0",
    "ask_change_freq": "(s_achg_{w} - f_achg_{w} + 1) / {w}.0",
    "avg_time_between_ticks": "(t - f_t_{w}) / (n_{w} - 1)",
    "tick_size_adherence": "CASE WHEN s_pair_{w} = f_pair_{w} THEN 1.0 ELSE (s_adh_{w} - f_adh_{w}) / (s_pair_{w} - f_pair_{w}) END",
}
# The column whose values the minimum counts; rows for the others.
_ABOUT = {
    "price_velocity": "last", "range_velocity": "last", "rejection_strength": "last", "level_tests": "last", "tick_size_adherence": "last",
    "buy_pressure": "volume", "sell_pressure": "volume", "volume_imbalance": "volume", "volume_spike": "volume",
    "volume_velocity": "volume", "large_print_ratio": "volume",
    "spread_normalized": "spread", "spread_volatility": "spread", "bid_change_freq": "bid", "ask_change_freq": "ask",
}
_AGGREGATES = {
    "n": "count(*)", "first_last": "first_value(last)", "sd_ret": "stddev_samp(ret)",
    "hi": "max(last)", "lo": "min(last)", "s_dir": "sum(direction)",
    "up": "count(*) FILTER (direction > 0)", "down": "count(*) FILTER (direction < 0)",
    "lasts": "list(last)", "volumes": "list(volume)", "a_vol": "avg(volume)",
    "s_chg": "sum(dir_chg)", "f_chg": "first_value(dir_chg)",
    "s_buy": "sum(buy)", "s_sell": "sum(sell)", "s_vol": "sum(volume)",
    "a_spread": "avg(spread)", "a_mid": "avg(mid)", "sd_spread": "stddev_samp(spread)",
    "s_bchg": "sum(bid_chg)", "f_bchg": "first_value(bid_chg)",
    "s_achg": "sum(ask_chg)", "f_achg": "first_value(ask_chg)",
    "f_t": "first_value(t)", "s_adh": "sum(adheres)", "f_adh": "first_value(adheres)",
    "s_pair": "sum(pair)", "f_pair": "first_value(pair)", **{f"has_{c}": f"count({c})" for c in ("last", "volume", "spread", "bid", "ask")},
}


def features_ctes(
    features: Sequence[str] = FEATURE_NAMES, windows: Sequence[int] = WINDOWS, ticks: str = TICKS, keep: str = ""
) -> str:
    """CTEs ending in ``features``: tick_id, symbol, t, key and unrounded feature columns of the last table of ``ticks``."""
    wanted = list(dict.fromkeys(["price_velocity" if f == "acceleration" else f for f in features]))
    aggs, values = [], []
    for w in windows:
        guards = {f: f"has_{_ABOUT[f]}_{w}" if f in _ABOUT else f"n_{w}" for f in wanted}
        text = " ".join([*(_FORMULAS[f].format(w=w) for f in wanted), *guards.values()]) + f" n_{w} "
        aggs += [f"{sql} OVER w{w} AS {a}_{w}" for a, sql in _AGGREGATES.items() if f"{a}_{w} " in text.replace(")", " ").replace(",", " ")]
        for f in wanted:
            formula = _FORMULAS[f].format(w=w)
            guarded = formula if f == "volatility" else f"CASE WHEN {guards[f]} >= {MIN_TICKS} THEN {formula} END"
            values.append(f"{guarded} AS {f}_{w}s")
    frames = ", ".join(
        f"w{w} AS (PARTITION BY symbol ORDER BY key RANGE BETWEEN {w * STEP - STEP // 2} PRECEDING AND CURRENT ROW)"
        for w in windows)
    out = ticks + _PREPARE + f""",
framed AS (SELECT *, {', '.join(aggs)} FROM prepared WINDOW {frames}),
valued AS (SELECT tick_id, symbol, t, key, bid, ask, last, {keep}{', '.join(values)} FROM framed)"""
    columns = [
        f"price_velocity_{w}s - lag(price_velocity_{w}s) OVER o AS acceleration_{w}s" if f == "acceleration" else f"{f}_{w}s"
        for w in windows for f in features]
    return out + f""",
features AS (SELECT tick_id, symbol, t, key, last, {keep}{', '.join(columns)} FROM valued
  WINDOW o AS (PARTITION BY symbol ORDER BY key))"""


def feature_query(features: Sequence[str], windows: Sequence[int] = WINDOWS) -> str:
    rounded = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in feature_columns(features, windows))
    return f"WITH {features_ctes(features, windows)} SELECT tick_id, symbol, {rounded} FROM features"


ATR = """
ranged AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS true_range
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY t)),
atr AS (
  SELECT *, """ + ", ".join(
    f"CASE WHEN count(*) OVER a{p} = {p} THEN avg(true_range) OVER a{p} END AS atr_{p}" for p in (14, 20, 50)) + """
  FROM ranged WINDOW """ + ", ".join(
    f"a{p} AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in (14, 20, 50)) + ")"

BAR_CONTEXT = ("ohlc_range", "ohlc_body", "upper_shadow", "lower_shadow", "price_position_in_range",
               "atr_14", "atr_20", "atr_50")


def context_cte(shift: int = 0) -> str:
    """CTE ``context``: the bar columns of each tick; ``shift`` delays when a bar can be seen."""
    return f"""
seen AS (SELECT *, t + {shift} AS seen_at FROM atr),
context AS (
  SELECT k.tick_id, k.symbol, k.t, b.t AS bar_t, b.high - b.low AS ohlc_range, abs(b.close - b.open) AS ohlc_body,
         b.high - greatest(b.open, b.close) AS upper_shadow, least(b.open, b.close) - b.low AS lower_shadow,
         (k.last - b.low) / CASE WHEN b.high = b.low THEN 1 ELSE b.high - b.low END AS price_position_in_range,
         b.atr_14, b.atr_20, b.atr_50
  FROM ticks k ASOF LEFT JOIN seen b ON k.symbol = b.symbol AND k.t >= b.seen_at)"""
