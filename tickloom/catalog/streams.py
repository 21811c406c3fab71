"""Streaming queries: each drains the whole table once as a stream and returns what was written."""

from pyspark.sql import functions as F

from ..sources import views as V
from ..streaming import jobs as J
from . import SQL, query, r, rounded
from .orderflow import _BOOK, _OFI_OUT, _ofi_sql

_T = V.with_views("ticks")
c = F.col


def _stream(spark, d, replay=None, files_per_trigger=64):
    """The tick view over the event table read as a stream."""
    J.use_rocksdb(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = J.read_table_stream(spark, d, "events", files_per_trigger)
    e = replay.open(e, "ts") if replay else e
    qty = F.get_json_object("props", "$.k").cast("long") + 1
    p = c("value")
    return e.select(
        F.concat(F.lit("S"), (c("user_id") % 12).cast("string")).alias("symbol"), c("ts").cast("timestamp").alias("timestamp"), c("event_id").alias("seq"), p.alias("price"), qty.cast("double").alias("quantity"),
        F.when(c("event_type").isin("error", "view"), "SELL").otherwise("BUY").alias("side"), (p * 0.999).alias("bid"), (p * 1.001).alias("ask"), (qty + c("user_id") % 7).cast("double").alias("bid_size"), (qty + c("event_id") % 5).cast("double").alias("ask_size"),
    )


@query(
    "stream_normalized_ticks",
    _T + f" SELECT seq, symbol, date_trunc('millisecond', timestamp) AS timestamp, {r('price')}, {r('quantity', name='volume')}, lower(side) AS side FROM ticks",
)
def stream_normalized_ticks(spark, d):
    t = _stream(spark, d)
    body = F.struct(F.lower("symbol").alias("s"), F.unix_millis("timestamp").alias("T"), c("price").cast("string").alias("p"), c("quantity").cast("string").alias("q"), (c("side") == "SELL").alias("m"))
    n = J.normalized_ticks(t.select("seq", F.to_json(body).alias("payload")), "crypto")
    n = n.select("seq", "symbol", "timestamp", c("price").cast("double").alias("price"), c("volume").cast("double").alias("volume"), "side")
    return rounded(J.drain(n))


@query(
    "stream_bars",
    _T + f""", s(bar_seconds) AS (VALUES (3600), (14400)),
    b AS (SELECT symbol, bar_seconds, to_timestamp((epoch_us(timestamp) // 1000000) // bar_seconds * bar_seconds)::TIMESTAMP AS timestamp, first(price ORDER BY timestamp, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY timestamp, seq) AS close, sum(quantity) AS volume, sum(price * quantity) / sum(quantity) AS vwap, count(*) AS trade_count
      FROM (SELECT t.*, s.bar_seconds FROM ticks t CROSS JOIN s) x GROUP BY symbol, bar_seconds, 3)
    SELECT symbol, bar_seconds, timestamp, open, high, low, close, volume, {r('vwap')}, trade_count FROM b""",
)
def stream_bars(spark, d):
    play = J.Replay(spark)
    x = play.drain(J.tumbling_bars(_stream(spark, d, play), (3600, 14400)))
    return rounded(rounded(x.withColumn("vwap", F.round(c("vwap") + 1.7e-10, 6))), None)


@query("stream_microstructure", SQL["recent_microstructure"])
def stream_microstructure(spark, d):
    play = J.Replay(spark)
    return rounded(play.drain(J.microstructure_stream(_stream(spark, d, play))).drop("timestamp"))


@query("stream_order_flow", _T + _ofi_sql(_BOOK) + f" SELECT symbol, seq, {r('ofi_signal')} FROM ofi")
def stream_order_flow(spark, d):
    play = J.Replay(spark)
    return rounded(play.drain(J.feature_stream(_stream(spark, d, play))).select("symbol", "seq", F.nanvl("ofi_signal", F.lit(None).cast("double")).alias("ofi_signal")))


@query(
    "stream_vpin",
    _T.replace("WITH ", "WITH RECURSIVE ", 1) + f""", n AS (SELECT symbol, timestamp, quantity AS q, CASE WHEN side = 'BUY' THEN 1.0e0 ELSE 0.0e0 END AS share, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS i FROM ticks),
    c AS (SELECT symbol, 0::BIGINT AS i, 0.0e0 AS buy, 0.0e0 AS tot, NULL::TIMESTAMP AS timestamp, false AS closed, 0.0e0 AS b, 0.0e0 AS s FROM (SELECT DISTINCT symbol FROM ticks)
      UNION ALL SELECT symbol, i, CASE WHEN tt >= 500 THEN tb * (tt - 500) / tt ELSE tb END, CASE WHEN tt >= 500 THEN tt - 500 ELSE tt END, timestamp, tt >= 500, tb * 500 / tt, (tt - tb) * 500 / tt
        FROM (SELECT n.symbol, n.i, n.timestamp, c.buy + q * share AS tb, c.tot + q AS tt FROM c JOIN n ON n.symbol = c.symbol AND n.i = c.i + 1)),
    k AS (SELECT symbol, timestamp, b, s, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS bucket FROM c WHERE closed)
    SELECT symbol, bucket, timestamp, {r('b', 4, 'buy_volume')}, {r('s', 4, 'sell_volume')}, {r('sum(abs(b - s)) OVER w / sum(b + s) OVER w', 4, 'vpin')}, {r('sum(b) OVER w / sum(b + s) OVER w', 4, 'buy_volume_pct')} FROM k WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 49 PRECEDING)""",
)
def stream_vpin(spark, d):
    play = J.Replay(spark)
    return rounded(play.drain(J.vpin_stream(_stream(spark, d, play), 500.0)), 4)


_BREAKER = """x AS (SELECT account, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::TIMESTAMP AS timestamp, 'CLOSED' AS status, 0::BIGINT AS tripped, NULL::VARCHAR AS reason, true AS allowed, 0::BIGINT AS losses FROM (SELECT DISTINCT account FROM e)
      UNION ALL SELECT account, i, seq, timestamp, CASE WHEN shut THEN 'OPEN' WHEN half AND pnl >= 0 THEN 'CLOSED' WHEN half AND pnl < 0 THEN 'OPEN' WHEN half THEN 'HALF_OPEN' ELSE was END,
        CASE WHEN shut OR (half AND pnl < 0) THEN us WHEN half AND pnl >= 0 THEN 0 ELSE tripped END, CASE WHEN shut THEN trig WHEN half AND pnl >= 0 THEN NULL ELSE reason END, NOT shut AND (half OR was <> 'OPEN'),
        CASE WHEN shut OR (half AND pnl < 0) THEN losses + 1 WHEN half AND pnl >= 0 THEN 0 ELSE losses END
      FROM (SELECT e.account, e.i, e.seq, e.timestamp, e.us, e.trig, e.pnl, x.status AS was, x.tripped, x.reason, x.losses, x.status = 'HALF_OPEN' OR (x.status = 'OPEN' AND e.us - x.tripped >= 1800000000) AS half, x.status = 'CLOSED' AND e.trig IS NOT NULL AS shut FROM x JOIN e ON e.account = x.account AND e.i = x.i + 1))"""


@query(
    "stream_breaker",
    _T.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT symbol AS account, seq, timestamp, epoch_us(timestamp) AS us, CASE WHEN seq % 97 = 0 THEN 'daily_drawdown' WHEN seq % 89 = 0 THEN 'vix_spike' END AS trig, CASE WHEN seq % 5 = 0 THEN seq % 41 - 20 END AS pnl, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS i FROM ticks),
""" + _BREAKER + """
    SELECT account, seq, timestamp, status, reason, allowed, losses FROM x WHERE i > 0""",
)
def stream_breaker(spark, d):
    play = J.Replay(spark)
    t = _stream(spark, d, play)
    trig = F.when(c("seq") % 97 == 0, "daily_drawdown").when(c("seq") % 89 == 0, "vix_spike")
    e = t.select(c("symbol").alias("account"), "seq", "timestamp", trig.alias("trigger"), F.when(c("seq") % 5 == 0, c("seq") % 41 - 20).alias("pnl"))
    return rounded(play.drain(J.breaker_stream(e)))


@query(
    "stream_silence",
    _T + f""", g AS (SELECT symbol AS source, epoch_us(timestamp) AS us, lag(epoch_us(timestamp)) OVER w AS p, lead(epoch_us(timestamp)) OVER w AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
    SELECT source, make_timestamp(us) AS timestamp, 'back' AS event, make_timestamp(p) AS silent_since, {r('(us - p) / 1e6', 3, 'gap_seconds')} FROM g WHERE us - p > 7200000000
    UNION ALL SELECT source, make_timestamp(us + 7200000000), 'silent', make_timestamp(us), NULL FROM g WHERE n IS NULL OR n - us > 7200000000""",
)
def stream_silence(spark, d):
    play = J.Replay(spark)
    x = play.drain(J.silence_stream(_stream(spark, d, play).select(c("symbol").alias("source"), "timestamp"), 7200))
    return rounded(x.select("source", "timestamp", "event", "silent_since", "gap_seconds"), 3)


_RAW = """, e0 AS (SELECT symbol AS account, seq, timestamp, epoch_us(timestamp) AS us, CASE seq % 3 WHEN 0 THEN 'pnl' WHEN 1 THEN 'vix' ELSE 'beat' END AS kind,
      CASE seq % 3 WHEN 0 THEN (seq % 41 - 21) * 10.0e0 WHEN 1 THEN seq % 17 + 30.0e0 END AS value, CASE WHEN seq % 3 = 2 THEN concat('feed', seq % 2) END AS source FROM ticks),
    e1 AS (SELECT *, CASE WHEN kind = 'pnl' THEN value END AS pnl, row_number() OVER w AS i,
      sum(CASE WHEN kind = 'pnl' THEN value ELSE 0 END) OVER (PARTITION BY account, date_trunc('day', timestamp) ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS dp,
      sum(CASE WHEN kind = 'pnl' THEN value ELSE 0 END) OVER (PARTITION BY account ORDER BY timestamp RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS r30,
      last_value(CASE WHEN kind = 'vix' THEN value END IGNORE NULLS) OVER w AS v1, us - max(CASE WHEN source = 'feed0' THEN us END) OVER w AS s0, us - max(CASE WHEN source = 'feed1' THEN us END) OVER w AS s1
      FROM e0 WINDOW w AS (PARTITION BY account ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT account, us AS at, value AS v0 FROM e0 WHERE kind = 'vix'),
    e AS (SELECT e1.*, CASE WHEN -dp / 10000 > 0.03 THEN 'daily_drawdown' WHEN -r30 / 10000 > 0.02 THEN 'intraday_loss' WHEN (v1 - v0) / v0 > 0.2 THEN 'vix_spike' WHEN greatest(coalesce(s0, 0), coalesce(s1, 0)) > 36000000000 THEN 'source_silent' END AS trig
      FROM e1 ASOF LEFT JOIN v ON v.account = e1.account AND v.at <= e1.us - 3600000000),
    """


@query(
    "stream_breaker_from_raw",
    _T.replace("WITH ", "WITH RECURSIVE ", 1) + _RAW + _BREAKER + """
    SELECT x.account, x.seq, x.timestamp, e.trig AS trigger, status, reason, allowed, losses FROM x JOIN e ON e.account = x.account AND e.i = x.i WHERE x.i > 0""",
)
def stream_breaker_from_raw(spark, d):
    """Results, volatility readings and heartbeats as three streams; the breaker's state after every row."""
    play = J.Replay(spark)
    t = _stream(spark, d, play).withColumn("account", c("symbol"))
    pnl = t.where(c("seq") % 3 == 0).select("account", "seq", "timestamp", ((c("seq") % 41 - 21) * 10.0).alias("pnl"))
    vix = t.where(c("seq") % 3 == 1).select("account", "seq", "timestamp", (c("seq") % 17 + 30.0).alias("vix"))
    # the row that ends a replay has no number; it goes with the beats
    beats = t.where((c("seq") % 3 == 2) | c("seq").isNull()).select("account", "seq", "timestamp", F.concat(F.lit("feed"), (c("seq") % 2).cast("string")).alias("source"))
    return rounded(play.drain(J.triggered_breaker_stream(pnl, vix, beats, 10_000.0, limits={"silence_seconds": 36_000})))


@query(
    "stream_regimes",
    _T + f""", k AS (SELECT symbol AS market, seq, timestamp, seq % 5 AS kind, CASE seq % 5 WHEN 0 THEN seq % 40 + 5.0e0 WHEN 1 THEN (seq % 13) / 16.0e0 WHEN 4 THEN (seq % 9) / 128.0e0 ELSE (seq % 11) / 4.0e0 + 2 END AS value FROM ticks),
    f AS (SELECT *, last_value(CASE WHEN kind = 0 THEN value END IGNORE NULLS) OVER w AS vix, coalesce(last_value(CASE WHEN kind = 1 THEN value END IGNORE NULLS) OVER w, 0) AS dx, last_value(CASE WHEN kind = 2 THEN value END IGNORE NULLS) OVER w AS y10,
      last_value(CASE WHEN kind = 3 THEN value END IGNORE NULLS) OVER w AS y2, coalesce(last_value(CASE WHEN kind = 4 THEN value END IGNORE NULLS) OVER w, 0) AS fr, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY market ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, coalesce(y2 > y10, false) AS inv, CASE WHEN vix IS NULL THEN 'normal' WHEN vix >= 35 THEN 'crisis' WHEN vix >= 25 THEN 'high' WHEN vix >= 15 THEN 'normal' ELSE 'low' END AS reg FROM f),
    h AS (SELECT *, CASE WHEN dx > 0.3 OR inv OR reg IN ('crisis','high') THEN 'reduced' ELSE 'normal' END AS mode,
      round(CASE reg WHEN 'crisis' THEN 0.0e0 WHEN 'high' THEN 0.3e0 WHEN 'normal' THEN 1.0e0 ELSE 1.2e0 END * CASE WHEN dx > 0.5 THEN 0.7e0 ELSE 1 END * CASE WHEN inv THEN 0.8e0 ELSE 1 END * CASE WHEN abs(fr) > 0.03 THEN 0.9e0 ELSE 1 END + 1e-12, 3) AS mult FROM g),
    z AS (SELECT *, lag(reg || inv || mode || mult) OVER (PARTITION BY market ORDER BY i) AS was FROM h)
    SELECT market, seq, timestamp, {r('vix')}, reg AS vol_regime, inv AS yield_curve_inverted, mode AS risk_mode, {r('mult', name='macro_mult')} FROM z WHERE was IS DISTINCT FROM reg || inv || mode || mult""",
)
def stream_regimes(spark, d):
    """Regime changes of every market from its readings in event-time order."""
    play = J.Replay(spark)
    t, k = _stream(spark, d, play), c("seq") % 5
    kind = F.when(k == 0, "vix").when(k == 1, "dollar_change").when(k == 2, "yield_10y").when(k == 3, "yield_2y").otherwise("funding_rate")
    value = F.when(k == 0, c("seq") % 40 + 5.0).when(k == 1, (c("seq") % 13) / 16.0).when(k == 4, (c("seq") % 9) / 128.0).otherwise((c("seq") % 11) / 4.0 + 2)
    return rounded(play.drain(J.regime_stream(t.select(c("symbol").alias("market"), "seq", "timestamp", kind.alias("kind"), value.alias("value")))))


@query(
    "silent_sources",
    _T + f" SELECT symbol AS source, max(timestamp) AS last_seen, {r(chr(39).join(['epoch(TIMESTAMP ', '2024-01-31 00:00:00', ' - max(timestamp))']), 3, 'age_seconds')}, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(timestamp)) > 3600 AS is_silent FROM ticks GROUP BY 1",
)
def silent_sources(spark, d):
    b = V.ticks(spark, d).select(c("symbol").alias("source"), "timestamp")
    return rounded(J.silent_sources(b, F.lit("2024-01-31").cast("timestamp"), 3600), 3)


@query("stream_unique_trades", "SELECT o_custkey AS strategy_id, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) GROUP BY 1")
def stream_unique_trades(spark, d):
    """One trade per customer and day survives the suppression of repeated ids."""
    J.use_rocksdb(spark)
    o = J.read_table_stream(spark, d, "orders")
    t = o.select(F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd")).alias("trade_id"), c("o_custkey").alias("strategy_id"), c("o_orderdate").cast("timestamp").alias("exit_time"))
    return J.drain(J.unique_trade_stream(t)).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "regime_snapshot",
    V.with_views("macro_series") + f""", l AS (SELECT series_id, last(value ORDER BY timestamp) AS v, max(timestamp) AS t FROM macro_series WHERE series_id IN ('NATION_0','NATION_1','NATION_2','NATION_3') GROUP BY 1),
    w AS (SELECT max(t) AS as_of, max(v) FILTER (series_id = 'NATION_0') / 1e4 AS vix, max(v) FILTER (series_id = 'NATION_1') / 1e6 AS dx, max(v) FILTER (series_id = 'NATION_2') AS y10, max(v) FILTER (series_id = 'NATION_3') AS y2 FROM l),
    g AS (SELECT *, CASE WHEN vix >= 35 THEN 'crisis' WHEN vix >= 25 THEN 'high' WHEN vix >= 15 THEN 'normal' ELSE 'low' END AS vol_regime FROM w)
    SELECT as_of, {r('vix', 5)}, vol_regime, y2 > y10 AS yield_curve_inverted, CASE WHEN dx > 0.3 OR y2 > y10 OR vol_regime IN ('crisis','high') THEN 'reduced' ELSE 'normal' END AS risk_mode FROM g""",
)
def regime_snapshot(spark, d):
    m = V.macro_series(spark, d)
    scale = F.when(c("series_id") == "NATION_0", 1e4).when(c("series_id") == "NATION_1", 1e6).otherwise(1.0)
    s = J.regime_snapshot(m.withColumn("value", c("value") / scale), {"NATION_0": "vix", "NATION_1": "dollar_change", "NATION_2": "yield_10y", "NATION_3": "yield_2y"})
    return rounded(s.select("as_of", "vix", "vol_regime", "yield_curve_inverted", "risk_mode"), 5)
