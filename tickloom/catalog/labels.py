"""Labelling and sample-weight queries."""

from pyspark.sql import functions as F

from ..operators import labels as L
from ..plans.ordered import Ordered
from ..plans.spans import concurrency, span_uniqueness
from ..sources import views as V
from . import query, r, rounded, rs

_H = V.with_views("bars_1h")
_LAB = """, b AS (SELECT symbol, timestamp, close, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS lr FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
    s AS (SELECT *, CASE WHEN i >= 20 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) END AS sigma FROM b),
    e AS (SELECT *, close + {a} * sigma * close AS up, close - {d} * sigma * close AS dn FROM s WHERE sigma > 0),
    f AS (SELECT e.symbol, e.i, min(CASE WHEN n.close >= up OR n.close <= dn THEN n.i END) AS hit, max(n.i) AS lst FROM e LEFT JOIN b n ON n.symbol = e.symbol AND n.i BETWEEN e.i + 1 AND e.i + 60 GROUP BY 1, 2),
    lab AS (SELECT e.symbol, e.timestamp AS t0, coalesce(x.timestamp, e.timestamp) AS t1, e.i AS i0, coalesce(x.i, e.i) AS i1, e.close AS entry_price, coalesce(x.close, e.close) AS exit_price,
      CASE WHEN hit IS NULL THEN 'vertical' WHEN {win} THEN 'upper' ELSE 'lower' END AS barrier_hit, CAST(coalesce(x.i - e.i, 0) AS INTEGER) AS holding_periods, e.sigma
      FROM e JOIN f USING (symbol, i) LEFT JOIN b x ON x.symbol = e.symbol AND x.i = coalesce(f.hit, f.lst))"""
_LONG = _LAB.format(a="2.0e0", d="1.0e0", win="x.close >= up")
_TERN = "CAST(CASE barrier_hit WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS TINYINT)"


def _labels(spark, d):
    return L.barrier_labels(V.bars(spark, d))


@query(
    "barrier_labels",
    _H + _LONG + f""" SELECT symbol, t0, t1, {rs('entry_price', 'exit_price')}, {_TERN} AS ternary_label, CAST(barrier_hit = 'upper' AS TINYINT) AS binary_target, barrier_hit, holding_periods, {r('sigma')} FROM lab""",
)
def barrier_labels(spark, d):
    return rounded(_labels(spark, d).drop("side"))


@query(
    "barrier_labels_short",
    _H + _LAB.format(a="2.0e0", d="1.0e0", win="x.close <= dn") + f""" SELECT symbol, t0, t1, {_TERN} AS ternary_label, barrier_hit, holding_periods FROM lab""",
)
def barrier_labels_short(spark, d):
    x = L.barrier_labels(V.bars(spark, d), side=F.lit(-1))
    return rounded(x.select("symbol", "t0", "t1", "ternary_label", "barrier_hit", "holding_periods"))


_EVENTS = """, ev AS (SELECT symbol, timestamp FROM bars_1h WHERE volume > 100)"""


@query(
    "threshold_events",
    _H + " SELECT symbol, timestamp, CAST(1 AS TINYINT) AS direction FROM bars_1h WHERE volume > 100",
)
def threshold_events(spark, d):
    return rounded(L.threshold_events(V.bars(spark, d), "volume", 100.0))


@query(
    "event_labels",
    _H + _LONG + _EVENTS + f""" SELECT symbol, t0, t1, {_TERN} AS ternary_label, holding_periods FROM lab WHERE EXISTS (SELECT 1 FROM ev WHERE ev.symbol = lab.symbol AND ev.timestamp = t0)""",
)
def event_labels(spark, d):
    b = V.bars(spark, d)
    return rounded(L.label_events(L.threshold_events(b, "volume", 100.0), b).select("symbol", "t0", "t1", "ternary_label", "holding_periods"))


@query(
    "event_violations",
    _H + """, ix AS (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars_1h),
    ev AS (SELECT symbol, CASE WHEN trade_count >= 4 THEN timestamp + INTERVAL 1 MINUTE ELSE timestamp END AS timestamp FROM bars_1h)
    SELECT ev.symbol, ev.timestamp, CASE WHEN i IS NULL THEN 'orphan' ELSE 'warm_up' END AS reason FROM ev LEFT JOIN ix ON ev.symbol = ix.symbol AND ev.timestamp = ix.timestamp WHERE i IS NULL OR i < 20""",
)
def event_violations(spark, d):
    b = V.bars(spark, d)
    t = F.when(F.col("trade_count") >= 4, F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("timestamp"))
    return rounded(L.event_violations(b.select("symbol", t.alias("timestamp")), b))


@query(
    "signal_violations",
    V.with_views("bars_1d") + """, x AS (SELECT symbol, timestamp, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS v FROM bars_1d)
    SELECT symbol, count(*) - count(v) AS n_missing, count(*) - count(DISTINCT timestamp) AS n_repeated_times, count(*) AS n_rows FROM x GROUP BY symbol""",
)
def signal_violations(spark, d):
    from pyspark.sql.window import Window

    b = V.bars_1d(spark, d)
    s = b.withColumn("v", F.lag("close").over(Window.partitionBy("symbol").orderBy("timestamp")))
    return L.signal_violations(s, "v")


_Q = "CAST(list_sort(list(holding_periods))[CAST(floor({p} * (count(*) - 1)) AS BIGINT) + 1] AS DOUBLE)"
_RET = "(exit_price - entry_price) / entry_price"


@query(
    "label_diagnostics",
    _H + _LONG + f""", g AS (SELECT symbol, count(*) AS n_events, avg((barrier_hit = 'upper')::INT) AS bu, avg((barrier_hit = 'lower')::INT) AS bl, avg((barrier_hit = 'vertical')::INT) AS bv,
      min(holding_periods) AS holding_min, max(holding_periods) AS holding_max, {_Q.format(p=0.25)} AS q1, {_Q.format(p=0.5)} AS q2, {_Q.format(p=0.75)} AS q3,
      coalesce(avg({_RET}) FILTER (barrier_hit = 'upper'), 0) AS m1, coalesce(avg({_RET}) FILTER (barrier_hit <> 'upper'), 0) AS m0 FROM lab GROUP BY symbol)
    SELECT symbol, n_events, {r('bu', name='binary_pct_one')}, {r('1 - bu', name='binary_pct_zero')}, {r('bu', name='ternary_pct_up')}, {r('bv', name='ternary_pct_flat')}, {r('bl', name='ternary_pct_down')},
    {r('bu', name='barrier_pct_upper')}, {r('bl', name='barrier_pct_lower')}, {r('bv', name='barrier_pct_vertical')}, holding_min, holding_max, {r('m1', name='mean_return_label_one')}, {r('m0', name='mean_return_label_zero')},
    {r('q1', name='holding_p25')}, {r('q2', name='holding_median')}, {r('q3', name='holding_p75')}, m1 > 0 AS sanity_label_one_positive, m0 <= 0 AS sanity_label_zero_nonpositive FROM g""",
)
def label_diagnostics(spark, d):
    return rounded(L.label_diagnostics(_labels(spark, d), ("symbol",)))


_CONC = """, cc AS (SELECT b.symbol, b.i, b.lr, b.timestamp, count(lab.i0) AS c FROM b LEFT JOIN lab ON lab.symbol = b.symbol AND b.i BETWEEN lab.i0 AND lab.i1 GROUP BY ALL)"""


@query("label_concurrency", _H + _LONG + _CONC + " SELECT symbol, timestamp, c AS concurrency FROM cc")
def label_concurrency(spark, d):
    return rounded(concurrency(_labels(spark, d), V.bars(spark, d).select("symbol", "timestamp")))


@query(
    "sample_weights",
    _H + _LONG + _CONC + f""", w AS (SELECT lab.symbol, t0, t1, count(*) AS n_bars, avg(1.0e0 / c) AS u, abs(sum(coalesce(lr, 0) / c)) AS a FROM lab JOIN cc ON cc.symbol = lab.symbol AND cc.i BETWEEN i0 AND i1 GROUP BY 1, 2, 3)
    SELECT symbol, t0, t1, n_bars, {r('u', name='uniqueness')}, {r('a', name='attribution')}, {r('u * a * count(*) OVER p / sum(u * a) OVER p', name='weight')} FROM w WINDOW p AS (PARTITION BY symbol)""",
)
def sample_weights(spark, d):
    w = L.sample_weights(_labels(spark, d), V.bars(spark, d))
    return rounded(w.select("symbol", "t0", "t1", "n_bars", "uniqueness", "attribution", "weight"))


@query(
    "span_uniqueness",
    V.with_views("trades") + f""", sp AS (SELECT trade_id, symbol, entry_time AS t0, exit_time AS t1 FROM trades),
    ep AS (SELECT DISTINCT symbol, t FROM (SELECT symbol, t0 AS t FROM sp UNION ALL SELECT symbol, t1 FROM sp)),
    sg AS (SELECT symbol, t AS a, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS b FROM ep),
    sc AS (SELECT sg.symbol, a, b, count(*) AS c FROM sg JOIN sp ON sp.symbol = sg.symbol AND sp.t0 < b AND sp.t1 > a WHERE b IS NOT NULL GROUP BY ALL),
    lg AS (SELECT trade_id, sum(epoch(b - a) / c) / sum(epoch(b - a)) AS u FROM sp JOIN sc ON sc.symbol = sp.symbol AND a >= t0 AND b <= t1 WHERE t1 > t0 GROUP BY 1),
    ze AS (SELECT x.trade_id, 1.0e0 / count(*) AS u FROM sp x JOIN sp y ON x.symbol = y.symbol AND y.t0 <= x.t0 AND x.t0 <= y.t1 WHERE x.t0 = x.t1 GROUP BY 1)
    SELECT trade_id, {r('u', name='uniqueness')} FROM (SELECT * FROM lg UNION ALL SELECT * FROM ze)""",
)
def span_unique(spark, d):
    t = V.trades(spark, d).select("trade_id", "symbol", F.col("entry_time").alias("t0"), F.col("exit_time").alias("t1"))
    u = span_uniqueness(t, Ordered(bucket_seconds=86_400 * 30))
    return rounded(u.select("trade_id", "uniqueness"))
