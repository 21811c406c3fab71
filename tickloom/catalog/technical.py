"""Technical indicator queries on hourly bars."""

from pyspark.sql import functions as F

from ..operators import technical as X
from ..sources import views as V
from . import query, r, rounded, rs

_H = V.with_views("bars_1h")
_I = """, b AS (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS ch, lag(close) OVER w AS pc FROM bars_1h
    WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"""


def _smooth(name: str, term: str, alpha: str, n: int, first: int = 0) -> str:
    """Seeded exponential average as a weighted sum over all earlier rows."""
    s = first + n - 1
    return f""", {name}_s AS (SELECT symbol, avg({term}) AS seed FROM b WHERE i BETWEEN {first} AND {s} GROUP BY symbol),
    {name} AS (SELECT a.symbol, a.i, any_value(seed) * pow(1 - {alpha}, a.i - {s}) + coalesce(sum(CASE WHEN c.i > {s} THEN {alpha} * (c.v) * pow(1 - {alpha}, a.i - c.i) END), 0) AS v
      FROM b a JOIN {name}_s USING (symbol) JOIN (SELECT symbol, i, {term} AS v FROM b) c ON c.symbol = a.symbol AND c.i <= a.i
      WHERE a.i >= {s} GROUP BY a.symbol, a.i)"""


@query("ema", _H + _I + _smooth("e", "close", "2.0e0 / 21", 20) + f" SELECT b.symbol, timestamp, {r('e.v', name='ema_20')} FROM b LEFT JOIN e USING (symbol, i)")
def ema(spark, d):
    return rounded(X.ema(V.bars(spark, d), 20).select("symbol", "timestamp", "ema_20"))


@query(
    "rsi",
    _H + _I + _smooth("u", "greatest(ch, 0)", "1.0e0 / 14", 14, 1) + _smooth("dn", "greatest(-ch, 0)", "1.0e0 / 14", 14, 1)
    + f" SELECT b.symbol, timestamp, {r('CASE WHEN dn.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / dn.v) END', name='rsi')} FROM b LEFT JOIN u USING (symbol, i) LEFT JOIN dn USING (symbol, i)",
)
def rsi(spark, d):
    return rounded(X.rsi(V.bars(spark, d)).select("symbol", "timestamp", "rsi"))


@query(
    "atr",
    _H + _I + _smooth("t", "greatest(high - low, abs(high - pc), abs(low - pc))", "1.0e0 / 14", 14, 1)
    + f" SELECT b.symbol, timestamp, {r('t.v', name='atr')} FROM b LEFT JOIN t USING (symbol, i)",
)
def atr(spark, d):
    return rounded(X.atr(V.bars(spark, d)).select("symbol", "timestamp", "atr"))


_BB = """, bb AS (SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER n END AS m, CASE WHEN i >= 19 THEN stddev_samp(close) OVER n END AS sd FROM b
    WINDOW n AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(
    "bollinger",
    _H + _I + _BB + f""", sq AS (SELECT *, i >= 25 AND sd <= min(sd) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS squeeze,
      (close - (m - 2 * sd)) / (4 * sd) AS pos FROM bb)
    SELECT symbol, timestamp, {r('m + 2 * sd', name='bb_upper')}, {r('m', name='bb_middle')}, {r('m - 2 * sd', name='bb_lower')}, coalesce(squeeze, false) AS bb_squeeze,
    CASE WHEN pos IS NULL THEN 0.0e0 WHEN pos <= 0 THEN 1.0e0 WHEN pos >= 1 THEN -1.0e0 WHEN pos < 0.2 THEN 0.5e0 WHEN pos > 0.8 THEN -0.5e0 ELSE 0.0e0 END AS bb_score FROM sq""",
)
def bollinger(spark, d):
    b = X.bollinger(V.bars(spark, d))
    b = b.withColumn("bb_score", X.band_score(F.col("close"), F.col("bb_upper"), F.col("bb_lower")))
    return rounded(b.select("symbol", "timestamp", "bb_upper", "bb_middle", "bb_lower", "bb_squeeze", "bb_score"))


def _rsi_list(a: str) -> str:
    def wilder(sign):
        g = f"list_transform(range(2, len({a}) + 1), lambda j: greatest(({a}[j] - {a}[j - 1]) * {sign}, 0.0e0))"
        return f"list_reduce(list_prepend(list_avg(({g})[1:14]), ({g})[15:]), lambda s, x: (s * 13 + x) / 14)"

    return f"CASE WHEN len({a}) < 15 THEN NULL WHEN {wilder(-1)} = 0 THEN 100.0e0 ELSE 100 - 100 / (1 + {wilder(1)} / {wilder(-1)}) END"


@query(
    "rsi_divergence",
    _H + _I + f""", l AS (SELECT symbol, timestamp, list(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) AS a FROM b),
    h AS (SELECT *, a[1:len(a) // 2] AS o, a[len(a) // 2 + 1:] AS n FROM l),
    k AS (SELECT *, {_rsi_list('o')} AS ro, {_rsi_list('a')} AS rn, list_avg(n) > list_avg(o) AS pu FROM h)
    SELECT symbol, timestamp, CASE WHEN len(a) < 28 OR ro IS NULL OR rn IS NULL THEN NULL WHEN NOT pu AND rn > ro THEN 'bullish' WHEN pu AND NOT rn > ro THEN 'bearish' END AS rsi_divergence FROM k""",
)
def rsi_divergence(spark, d):
    return rounded(X.rsi_divergence(V.bars(spark, d)).select("symbol", "timestamp", "rsi_divergence"))


@query(
    "trend_regime",
    _H + _I + _smooth("f", "close", "2.0e0 / 21", 20) + _smooth("s", "close", "2.0e0 / 51", 50)
    + """ SELECT b.symbol, timestamp, CASE WHEN s.v IS NULL THEN 'ranging' WHEN f.v > s.v * 1.001 THEN 'trending_up' WHEN f.v < s.v * 0.999 THEN 'trending_down' ELSE 'ranging' END AS trend
    FROM b LEFT JOIN f USING (symbol, i) LEFT JOIN s USING (symbol, i)""",
)
def trend_regime(spark, d):
    return rounded(X.trend_regime(V.bars(spark, d)).select("symbol", "timestamp", "trend"))


@query(
    "open_interest_trend",
    _H + """, x AS (SELECT symbol, timestamp, volume - lag(volume) OVER w AS dv FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
    y AS (SELECT *, count(dv) OVER l AS n, min(dv) OVER l AS lo, max(dv) OVER l AS hi FROM x WINDOW l AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT symbol, timestamp, CASE WHEN n = 4 AND lo > 0 THEN 'rising' WHEN n = 4 AND hi < 0 THEN 'falling' END AS trend FROM y""",
)
def open_interest_trend(spark, d):
    return rounded(X.monotone_trend(V.bars(spark, d), "volume").select("symbol", "timestamp", "trend"))


_TFS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


@query(
    "timeframe_alignment",
    V.with_views("ticks") + f""", tf(timeframe, s) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in _TFS.items())}),
    bb AS (SELECT symbol, timeframe, (epoch_us(timestamp) // 1000000) // s * s AS bar, first(price ORDER BY timestamp, seq) AS o, last(price ORDER BY timestamp, seq) AS c
      FROM (SELECT t.symbol, t.timestamp, t.seq, t.price, tf.timeframe, tf.s FROM ticks t CROSS JOIN tf) x GROUP BY 1, 2, 3),
    st AS (SELECT symbol, timeframe, CASE WHEN last(c - o ORDER BY bar) > 0 THEN 'long' WHEN last(c - o ORDER BY bar) < 0 THEN 'short' ELSE 'flat' END AS direction FROM bb GROUP BY 1, 2)
    SELECT symbol, target, {r('avg(CASE WHEN direction = target THEN 1.0e0 ELSE 0 END)', name='alignment')} FROM st CROSS JOIN (VALUES ('long'), ('short')) g(target) GROUP BY 1, 2""",
)
def timeframe_alignment(spark, d):
    b = X.timeframe_bars(V.ticks(spark, d), _TFS)
    move = F.max_by(F.col("close") - F.col("open"), "timestamp")
    st = b.groupBy("symbol", "timeframe").agg(F.when(move > 0, "long").when(move < 0, "short").otherwise("flat").alias("direction"))
    st = st.withColumn("target", F.explode(F.array(F.lit("long"), F.lit("short"))))
    return rounded(X.alignment_share(st))
