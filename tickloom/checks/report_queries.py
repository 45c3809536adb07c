"""Queries for validation, coverage, statistics, profiles and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.checks import sql as Q
from tickloom.checks.registry import query
from tickloom.checks.tape_queries import rounded, t
from tickloom.functions import scalar as S
from tickloom.operators import joins as J
from tickloom.operators import messages as M
from tickloom.operators import quality as V
from tickloom.operators import rolling as R
from tickloom.sources import fixtures as fx


def expected_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The event types, each also under a name nothing is listed as."""
    kinds = fx.events(spark, sf).select("event_type").distinct()
    return kinds.select(F.explode(F.array(
        F.col("event_type"), F.concat(F.lit("missing_"), F.col("event_type")))).alias("symbol"))


_SYMBOLS = """symbols AS (SELECT DISTINCT event_type AS symbol FROM events
  UNION ALL SELECT DISTINCT 'missing_' || event_type FROM events)"""


def seconds(*names: str) -> list[F.Column]:
    return [F.unix_seconds(n).alias(n) for n in names]


@query("tick_gate", f"""WITH {Q.TICKS}, s AS (SELECT t, lag(t) OVER (ORDER BY tick_id) AS before FROM ticks)
SELECT '' AS missing_columns, count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (t < before) AS steps_back,
  count(*) FILTER (t < before) = 0 AS in_order, count(*) >= 100 AS valid FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_ticks(fx.ticks(spark, sf))


@query("tick_gate_missing_column", """SELECT 'ask' AS missing_columns, count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS steps_back,
  true AS in_order, false AS valid FROM events""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_ticks(fx.ticks(spark, sf).drop("ask"))


@query("tick_gate_null_keys", f"""WITH {Q.HOLED}, s AS (SELECT t, lag(t) OVER (ORDER BY tick_id) AS before FROM holed
  WHERE tick_id IS NOT NULL AND t IS NOT NULL)
SELECT '' AS missing_columns, (SELECT count(*) FROM holed) AS row_count,
  (SELECT count(*) FROM holed WHERE tick_id IS NULL OR symbol IS NULL OR t IS NULL) AS null_keys,
  count(*) FILTER (t < before) AS steps_back, count(*) FILTER (t < before) = 0 AS in_order, false AS valid FROM s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_ticks(fx.ticks_with_null_keys(spark, sf))


@query("coverage", f"""WITH {Q.BARS}, {_SYMBOLS} SELECT s.symbol,
  (SELECT count(*) FROM ticks k WHERE k.symbol = s.symbol) AS ticks,
  (SELECT count(*) FROM bars b WHERE b.symbol = s.symbol) AS bars FROM symbols s""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.coverage(expected_symbols(spark, sf), fx.ticks(spark, sf), fx.bars(spark, sf))


@query("missing_symbols", f"WITH {_SYMBOLS} SELECT symbol FROM symbols WHERE symbol NOT IN (SELECT event_type FROM events)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_symbols(expected_symbols(spark, sf), fx.ticks(spark, sf))


@query("collection_status", f"""WITH {Q.BARS}, {_SYMBOLS}, c AS (SELECT s.symbol,
  (SELECT count(*) FROM ticks k WHERE k.symbol = s.symbol) AS ticks,
  (SELECT count(*) FROM bars b WHERE b.symbol = s.symbol AND b.symbol <> 'view') AS bars FROM symbols s)
SELECT *, CASE WHEN ticks > 0 AND bars > 0 THEN 'success' WHEN ticks > 0 OR bars > 0 THEN 'partial' ELSE 'failed' END AS status FROM c""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bars = fx.bars(spark, sf).filter(F.col("symbol") != "view")
    return V.collection_status(V.coverage(expected_symbols(spark, sf), fx.ticks(spark, sf), bars))


_SUMMARY = f"""WITH {Q.BARS}, {_SYMBOLS}, found AS (
  SELECT symbol, 'ticks' AS dataset, count(*) AS row_count, min(t) AS from_time, max(t) AS to_time FROM ticks GROUP BY symbol
  UNION ALL SELECT symbol, 'ohlc', count(*), min(t), max(t) FROM bars GROUP BY symbol),
validated AS (SELECT symbol, dataset, row_count, from_time, to_time, CASE WHEN row_count IS NULL THEN 'missing' ELSE 'present' END AS status
  FROM (SELECT symbol, d.dataset FROM symbols, (VALUES ('ticks'), ('ohlc')) d(dataset)) LEFT JOIN found USING (symbol, dataset))"""


@query("validate_collection", _SUMMARY + " SELECT * FROM validated")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = V.validate_collection(expected_symbols(spark, sf), fx.ticks(spark, sf), fx.bars(spark, sf))
    return out.select("symbol", "dataset", "row_count", *seconds("from_time", "to_time"), "status")


@query("collection_report", _SUMMARY + """ SELECT symbol,
  CAST(coalesce(max(row_count) FILTER (dataset = 'ticks'), 0) AS BIGINT) AS tick_rows,
  max(from_time) FILTER (dataset = 'ticks') AS tick_from, max(to_time) FILTER (dataset = 'ticks') AS tick_to,
  CAST(coalesce(max(row_count) FILTER (dataset = 'ohlc'), 0) AS BIGINT) AS bar_rows,
  max(from_time) FILTER (dataset = 'ohlc') AS bar_from, max(to_time) FILTER (dataset = 'ohlc') AS bar_to
FROM validated GROUP BY symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = V.collection_report(
        V.validate_collection(expected_symbols(spark, sf), fx.ticks(spark, sf), fx.bars(spark, sf)))
    return out.select("symbol", "tick_rows", *seconds("tick_from", "tick_to"), "bar_rows", *seconds("bar_from", "bar_to"))


@query("symbol_stats", f"""WITH {Q.BARS}, b AS (SELECT symbol, count(*) AS bars_completed FROM bars GROUP BY symbol)
SELECT k.symbol, count(*) AS total_ticks, max(k.t) AS last_tick_time, round(avg(ask - bid), 6) AS avg_spread,
  max(bars_completed) AS bars_completed FROM ticks k JOIN b USING (symbol) GROUP BY k.symbol""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = V.symbol_stats(fx.ticks(spark, sf), fx.bars(spark, sf))
    return out.select("symbol", "total_ticks", *seconds("last_tick_time"), *rounded(["avg_spread"]), "bars_completed")


@query("tick_rate", f"WITH {Q.TICKS} SELECT t AS second, count(*) AS ticks_per_second FROM ticks GROUP BY t")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.tick_rate(fx.ticks(spark, sf)).select(*seconds("second"), "ticks_per_second")


@query("live_report", f"""WITH {Q.BARS}, u AS (
  SELECT CASE WHEN tick_id % 10 <> 0 THEN symbol END AS symbol, t, ask - bid AS spread, 1 AS k, 0 AS b, 0 AS e FROM ticks
  UNION ALL SELECT symbol, NULL, NULL, 0, 1, 0 FROM bars UNION ALL SELECT symbol, NULL, NULL, 0, 0, 1 FROM ticks WHERE tick_id % 13 = 0)
SELECT symbol, grouping(symbol) = 1 AS is_total, CAST(sum(k) AS BIGINT) AS total_ticks, max(t) AS last_tick_time,
  round(sum(k)::DOUBLE / nullif(max(t) - min(t), 0), 6) AS ticks_per_second, round(avg(spread), 6) AS avg_spread,
  CAST(sum(b) AS BIGINT) AS bars_completed, CAST(sum(e) AS BIGINT) AS errors FROM u GROUP BY ROLLUP (symbol)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows are turned away, and some ticks have no symbol."""
    ticks = fx.ticks(spark, sf).withColumn("symbol", F.when(F.col("tick_id") % 10 != 0, F.col("symbol")))
    out = V.live_report(ticks, fx.bars(spark, sf), fx.ticks(spark, sf).where("tick_id % 13 = 0"))
    return out.select(
        "symbol", "is_total", "total_ticks", *seconds("last_tick_time"), *rounded(["ticks_per_second", "avg_spread"]), "bars_completed", "errors")


_PROFILED = [*R.feature_columns(), *J.BAR_CONTEXT]
_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _PROFILED)
_WITH_CONTEXT = f"""{Q.features_ctes()}, {Q.BARS[len(Q.TICKS) + 1:]}, {Q.ATR}, {Q.context_cte()},
both_parts AS (SELECT f.*, {', '.join('c.' + c for c in Q.BAR_CONTEXT)} FROM features f JOIN context c USING (tick_id))"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature and the bar context, before missing values are filled."""
    ticks = J.with_bar_context(fx.ticks(spark, sf).select("tick_id", "symbol", "time", "bid", "ask", "last", "volume"), fx.bars(spark, sf))
    return R.rolling_features(ticks, keep=J.BAR_CONTEXT)


# Seven decimals: some mean lies just between two numbers of six, and its last digit would hang on the order of the sum.
@query("feature_profile", f"""WITH {_WITH_CONTEXT}, wide AS (SELECT {_DOUBLES} FROM both_parts),
long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_PROFILED)})))
SELECT feature, CAST({len(_PROFILED)} AS BIGINT) AS total_features, count(*) AS total_rows, count(*) - count(value) AS missing_values,
  count(*) FILTER (isinf(value)) AS infinite_values,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(favg(value), 7) AS mean, round(stddev_samp(value), 7) AS std
FROM long GROUP BY feature""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = V.profile_features(_features(spark, sf), _PROFILED)
    return out.select(
        "feature", "total_features", "total_rows", "missing_values", "infinite_values", *rounded(["min", "max"]),
        F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"))


@query("feature_correlation", f"""WITH {_WITH_CONTEXT}, wide AS (SELECT tick_id, {_DOUBLES} FROM both_parts),
long AS (SELECT * FROM (UNPIVOT wide ON {', '.join(_PROFILED)} INTO NAME feature VALUE value)),
names AS (SELECT unnest([{', '.join(f"'{c}'" for c in _PROFILED)}]) AS feature),
pairs AS (SELECT a.feature AS col_a, b.feature AS col_b,
    CASE WHEN max(a.value) > min(a.value) AND max(b.value) > min(b.value) THEN round(corr(a.value, b.value), 5) END AS corr
  FROM long a JOIN long b USING (tick_id) GROUP BY a.feature, b.feature)
SELECT a.feature AS col_a, b.feature AS col_b, CASE WHEN a.feature = b.feature AND corr IS NOT NULL THEN 1.0::DOUBLE ELSE corr END AS corr
FROM names a CROSS JOIN names b LEFT JOIN pairs p ON p.col_a = a.feature AND p.col_b = b.feature""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return V.correlate(_features(spark, sf), _PROFILED).select("col_a", "col_b", F.round("corr", 5).alias("corr"))


# --- messages -----------------------------------------------------------------------------


@query("message_stats", f"""WITH {Q.MESSAGES} SELECT CAST(type AS INTEGER) AS type, grouping(type) = 1 AS is_total, count(*) AS messages,
  count(*) FILTER (type IN (1, 2, 5, 6)) AS sent, count(*) FILTER (type IS NULL OR type NOT IN (1, 2, 5, 6)) AS received,
  count(*) FILTER (type = 99) AS errors FROM (SELECT CASE WHEN msg_id % 10 <> 0 THEN type END AS type FROM messages) GROUP BY ROLLUP (type)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return M.message_stats(fx.messages(spark, sf).withColumn("type", F.when(F.col("msg_id") % 10 != 0, F.col("type"))))


@query("route_messages", f"""WITH {Q.MESSAGES} SELECT msg_id, CASE type WHEN 1 THEN 'tick_data' WHEN 2 THEN 'signal_request'
  WHEN 3 THEN 'signal_response' WHEN 6 THEN 'status_update' WHEN 99 THEN 'error' END AS kind FROM messages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fx.messages(spark, sf).select("msg_id", M.type_label(F.col("type")).alias("kind"))


def message_fields(m: DataFrame) -> DataFrame:
    """Every field a message kind can carry, from the message rows."""
    return m.select(
        "msg_id", "type", "symbol", F.col("time").alias("sent_at"), F.unix_seconds("time").alias("time"),
        (F.col("value") + 1000).alias("bid"), (F.col("value") + 1001).alias("ask"),
        (F.col("value") + F.lit(1000.5)).alias("last"), F.col("msg_id").alias("volume"), F.lit(1.0).alias("spread"),
        "direction", "confidence", F.col("msg_id").alias("request_id"),
        (F.col("direction") + 1).alias("operation"), F.col("value").alias("price"),
        (F.col("value") - 1).alias("sl"), (F.col("value") + 2).alias("tp"),
        F.concat(F.lit('say "'), F.col("symbol"), F.lit('"\\\n\t')).alias("comment"), F.col("msg_id").alias("magic"),
        F.lit("up").alias("status"), F.lit("all well").alias("details"),
        F.lit("tickloom").alias("expert_id"), F.lit("mode").alias("key"), F.col("symbol").alias("value"),
    )


_STAMP = "strftime(make_timestamp(us), '%Y.%m.%d %H:%M:%S')"
# The line format is fixed, so the whole text is compared.
_LINE_SQL = {
    1: "'\"symbol\":\"' || symbol || '\",\"time\":' || us // 1000000 || ',\"bid\":' || printf('%.8f', value + 1000) || ',\"ask\":' || printf('%.8f', value + 1001) || ',\"last\":' || printf('%.8f', value + 1000.5) || ',\"volume\":' || msg_id || ',\"spread\":1.00000000,\"direction\":' || direction",
    2: "'\"symbol\":\"' || symbol || '\",\"request_id\":' || msg_id",
    4: "'\"symbol\":\"' || symbol || '\",\"operation\":' || direction + 1 || ',\"volume\":' || msg_id || ',\"price\":' || printf('%.8f', value) || ',\"sl\":' || printf('%.8f', value - 1) || ',\"tp\":' || printf('%.8f', value + 2) || ',\"comment\":\"say \\\"' || symbol || '\\\"\\\\\\n\\t\",\"magic\":' || msg_id",
    6: "'\"status\":\"up\",\"details\":\"all well\",\"expert_id\":\"tickloom\"'",
    7: "'\"key\":\"mode\",\"value\":\"' || symbol || '\"'",
}
_NAMES = {1: "encode_ticks", 2: "encode_signal_requests", 4: "encode_orders", 6: "encode_status", 7: "encode_config"}


def _register_encode(code: int) -> None:
    body = _LINE_SQL[code]
    head = f"""'{{"type":{code},"timestamp":"' || {_STAMP} || '",' || """
    @query(_NAMES[code], f"WITH {Q.MESSAGES} SELECT msg_id, {head}{body} || '}}' AS line FROM messages")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return M.encode(message_fields(fx.messages(spark, sf)), code).select("msg_id", F.col("value").alias("line"))


for _code in _NAMES:
    _register_encode(_code)


@query("encode_null_fields", f"""WITH {Q.MESSAGES} SELECT msg_id, '{{"type":4,"timestamp":' || coalesce('"' || CASE WHEN msg_id % 2 = 0 THEN {_STAMP} END || '"', 'null')
  || ',"symbol":' || CASE WHEN msg_id % 3 = 0 THEN 'null' ELSE '"' || symbol || '"' END || ',"operation":' || direction + 1
  || ',"volume":' || CASE WHEN msg_id % 5 = 0 THEN 'null' ELSE msg_id || '' END || ',"price":' || CASE WHEN msg_id % 7 < 4 THEN 'null' ELSE printf('%.8f', value) END
  || ',"sl":' || printf('%.8f', value - 1) || ',"tp":' || printf('%.8f', value + 2) || ',"comment":null,"magic":' || msg_id || '}}' AS line FROM messages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values, and prices that are no finite numbers, are written as null."""
    i = F.col("msg_id")
    odd = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 7 == 1, F.lit(float("inf"))).when(i % 7 == 2, F.lit(float("-inf"))).when(i % 7 > 3, F.col("price"))
    fields = message_fields(fx.messages(spark, sf)).withColumns({
        "sent_at": F.when(i % 2 == 0, F.col("sent_at")), "symbol": F.when(i % 3 != 0, F.col("symbol")), "volume": F.when(i % 5 != 0, F.col("volume")),
        "price": odd, "comment": F.lit(None).cast("string")})
    return M.encode(fields, 4).select("msg_id", F.col("value").alias("line"))


@query("decode_messages", f"""WITH {Q.MESSAGES} SELECT msg_id, CAST(4 AS INTEGER) AS type, symbol, CAST(direction + 1 AS INTEGER) AS operation,
  round(value, 8) AS price, 'say "' || symbol || '"\\' || chr(10) || chr(9) AS comment, msg_id AS magic FROM messages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = M.encode(message_fields(fx.messages(spark, sf)), 4).select("msg_id", "value")
    return M.decode(lines).select("msg_id", "m.type", "m.symbol", "m.operation", F.round("m.price", 8).alias("price"), "m.comment", "m.magic")


@query("decode_signals", f"""WITH {Q.MESSAGES} SELECT msg_id, symbol, CAST(direction AS INTEGER) AS direction, confidence
FROM messages WHERE type = 3""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    fields = message_fields(fx.messages(spark, sf))
    responses = M.encode(fields.filter(F.col("type") == 3), 3)
    others = M.encode(fields.filter(F.col("type") != 3), 2)
    return M.decode_signals(responses.unionByName(others).select("msg_id", "value"))


MATCH_SQL = f"""WITH {Q.MESSAGES}, pairs AS (SELECT q.msg_id, p.msg_id AS response_id, p.direction, p.confidence,
    row_number() OVER (PARTITION BY q.msg_id ORDER BY p.us, p.msg_id) AS r
  FROM messages q JOIN messages p ON p.type = 3 AND p.symbol = q.symbol AND p.us > q.us AND p.us <= q.us + 1000000 WHERE q.type = 2)
SELECT q.msg_id, q.symbol, p.response_id, CAST(p.direction AS INTEGER) AS direction, p.confidence, p.response_id IS NULL AS timed_out
FROM messages q LEFT JOIN pairs p ON p.msg_id = q.msg_id AND p.r = 1 WHERE q.type = 2"""


@query("match_signals", MATCH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    return J.match_signals(m.filter(F.col("type") == 2), m.filter(F.col("type") == 3)).drop("time")


_BEATS = "beats AS (SELECT msg_id, us FROM messages WHERE type = 6)"
_AS_OF_US = Q.BASE_US + 26_000 * 1_000_000


@query("heartbeat_gaps", f"""WITH {Q.MESSAGES}, {_BEATS}, g AS (SELECT msg_id,
  (coalesce(lead(us) OVER (ORDER BY us, msg_id), {_AS_OF_US}) - us) / 1e6 AS gap FROM beats)
SELECT msg_id, round(CAST(gap AS DOUBLE), 6) AS gap_seconds, gap > 60 AS lost FROM g""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    beats = fx.messages(spark, sf).filter(F.col("type") == 6)
    out = M.heartbeat_gaps(beats, F.timestamp_micros(F.lit(_AS_OF_US)))
    return out.select("msg_id", *rounded(["gap_seconds"]), "lost")


@query("live_spans", f"""WITH {Q.MESSAGES}, {_BEATS}, s AS (SELECT us, msg_id, CASE WHEN us - lag(us) OVER (ORDER BY us, msg_id) <= 60000000 THEN 0 ELSE 1 END AS starts FROM beats),
n AS (SELECT us, sum(starts) OVER (ORDER BY us, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM s)
SELECT CAST(span AS BIGINT) AS span, min(us) AS since, max(us) AS until, count(*) AS beats FROM n GROUP BY span""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = M.live_spans(fx.messages(spark, sf).filter(F.col("type") == 6))
    return out.select("span", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "beats")
