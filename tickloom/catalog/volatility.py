"""Volatility, roughness, long-memory and gamma-exposure queries."""

import math

from pyspark.sql import functions as F

from ..operators import orderflow as O
from ..operators import volatility as X
from ..sources import views as V
from . import query, r, rounded, rs

_B = V.with_views("bars_1d")
_H = V.with_views("bars_1h")
_RET = """, ret AS (SELECT *, ln(close / lag(close) OVER w) AS lr, close / lag(close) OVER w - 1 AS sr FROM bars_1d
    WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
    x AS (SELECT symbol, timestamp, lr, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS d FROM ret WHERE lr IS NOT NULL)"""


def _returns(spark, d):
    return X.with_returns(V.bars_1d(spark, d)).filter(F.col("log_return").isNotNull())


@query("bar_returns", _B + _RET + f" SELECT symbol, timestamp, {r('lr', name='log_return')}, {r('sr', name='simple_return')} FROM ret")
def bar_returns(spark, d):
    return rounded(X.with_returns(V.bars_1d(spark, d)).select("symbol", "timestamp", "log_return", "simple_return"))


_DAILY = """, hr AS (SELECT symbol, CAST(timestamp AS DATE) AS day, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol, CAST(timestamp AS DATE) ORDER BY timestamp)) AS r FROM bars_1h),
    pr AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY symbol, day ORDER BY timestamp)) AS p FROM hr),
    dv AS (SELECT symbol, day, coalesce(sum(r * r), 0) AS rv, pi() / 2 * coalesce(sum(p), 0) AS bv, coalesce(sum(r), 0) AS dr, count(r) AS n FROM pr GROUP BY 1, 2)"""


@query(
    "daily_realized_variance",
    _H + _DAILY + f""" SELECT symbol, CAST(day AS TIMESTAMP) AS day, {rs('rv', 'bv')}, {r('dr', name='day_return')}, n AS n_returns, {r('greatest(0, rv - bv)', name='jump')},
    {r('CASE WHEN rv > 0 THEN greatest(0, rv - bv) / rv ELSE 0 END', name='jump_ratio')},
    CASE WHEN rv > 0 THEN greatest(0, rv - bv) / rv > 0.01 ELSE false END AS has_jump,
    {r('sqrt(rv * CASE WHEN n <= 50 THEN 252 ELSE 252.0e0 * 390 / n END)', name='annual_vol')} FROM dv""",
)
def daily_realized_variance(spark, d):
    return rounded(X.daily_realized(V.bars(spark, d)))


@query("amihud", _B + _RET + f" SELECT symbol, {r('1e6 * avg(CASE WHEN volume > 0 THEN abs(sr) / volume END)', name='amihud_e6')} FROM ret GROUP BY symbol")
def amihud(spark, d):
    return rounded(X.amihud(V.bars_1d(spark, d)).select("symbol", (F.col("amihud") * 1e6).alias("amihud_e6")))


@query(
    "informed_trading",
    V.with_views("ticks") + f""", f AS (SELECT symbol, date_trunc('hour', timestamp) AS h, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS b,
      sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS s FROM ticks GROUP BY 1, 2),
    g AS (SELECT symbol, stddev_pop(b - s) / avg(b + s) * avg(abs(b - s)) AS x, avg(least(b, s)) AS e FROM f GROUP BY 1)
    SELECT symbol, {r('x / (x + 2 * e)', name='pin')} FROM g""",
)
def informed_trading(spark, d):
    q = F.col("quantity")
    f = V.ticks(spark, d).groupBy("symbol", F.date_trunc("hour", "timestamp").alias("h")).agg(
        F.sum(F.when(F.col("side") == "BUY", q).otherwise(0.0)).alias("buy"),
        F.sum(F.when(F.col("side") == "SELL", q).otherwise(0.0)).alias("sell"),
    )
    return rounded(X.informed_trading(f))


_CEN = """, c AS (SELECT x.*, avg(lr) OVER p AS m, var_pop(lr) OVER p AS v, count(*) OVER p AS n FROM x WINDOW p AS (PARTITION BY symbol))"""


@query(
    "ljung_box",
    _B + _RET + _CEN + f""", k AS (SELECT a.symbol, b.d - a.d AS k, a.n, a.v, avg((a.lr - a.m) * (b.lr - b.m)) AS cov FROM c a JOIN c b
      ON a.symbol = b.symbol AND b.d BETWEEN a.d + 1 AND a.d + 10 GROUP BY ALL),
    q AS (SELECT symbol, n * (n + 2) * sum((cov / v) * (cov / v) / (n - k)) AS q FROM k GROUP BY symbol, n)
    SELECT symbol, {r('q', name='q_stat')}, q > 15 AS significant FROM q""",
)
def ljung_box(spark, d):
    return rounded(X.ljung_box(_returns(spark, d)))


@query(
    "hurst_rs",
    _B + f""", c AS (SELECT symbol, timestamp, close, avg(close) OVER (PARTITION BY symbol) AS m FROM bars_1d),
    e AS (SELECT symbol, close, sum(close - m) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS s FROM c)
    SELECT symbol, {r('ln((max(s) - min(s)) / stddev_samp(close)) / ln(count(*))', name='hurst')} FROM e GROUP BY symbol""",
)
def hurst_rs(spark, d):
    return rounded(X.hurst_rs(V.bars_1d(spark, d)))


@query(
    "tail_correlation",
    _B + _RET + f""", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM x)
    SELECT a.symbol, {r('covar_pop(a.lr, b.lr) / (stddev_pop(a.lr) * stddev_pop(b.lr))', name='correlation')}
    FROM k a JOIN k b ON a.k = b.k AND b.symbol = 0 WHERE a.k <= 60 GROUP BY a.symbol""",
)
def tail_correlation(spark, d):
    ret = _returns(spark, d)
    return rounded(X.tail_correlation(ret, ret.filter("symbol = 0")))


@query(
    "asset_correlation_matrix",
    _H + f""", hr AS (SELECT symbol, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp)) AS lr FROM bars_1h),
    ok AS (SELECT timestamp FROM hr WHERE lr IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM hr)),
    z AS (SELECT hr.* FROM hr JOIN ok USING (timestamp))
    SELECT a.symbol AS a, b.symbol AS b, {r('CASE WHEN a.symbol = b.symbol THEN 1 ELSE covar_pop(a.lr, b.lr) / (stddev_pop(a.lr) * stddev_pop(b.lr)) END', name='correlation')},
    count(*) AS n_rows FROM z a JOIN z b USING (timestamp) GROUP BY 1, 2""",
)
def asset_correlation_matrix(spark, d):
    ret = X.with_returns(V.bars(spark, d))
    return rounded(X.asset_correlations(ret, [f"S{i}" for i in range(12)]))


@query(
    "cointegration",
    _H + f""", p AS (SELECT a.symbol, a.timestamp, a.close AS y, b.close AS x FROM bars_1h a JOIN bars_1h b ON a.timestamp = b.timestamp AND b.symbol = 'S0' AND a.symbol <> 'S0'),
    f AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM p GROUP BY 1),
    q AS (SELECT symbol, timestamp, a, b, n, y - (a + b * x) AS r, lag(y - (a + b * x)) OVER (PARTITION BY symbol ORDER BY timestamp) AS l FROM p JOIN f USING (symbol)),
    g AS (SELECT symbol, a, b, n, sum(l * (r - l)) / sum(l * l) AS rho, sum(l * l) AS ll, count(l) AS m, sum((r - l) * (r - l)) AS dd, sum(l * (r - l)) AS ld FROM q GROUP BY symbol, a, b, n),
    h AS (SELECT *, rho / sqrt((dd - 2 * rho * ld + rho * rho * ll) / (m - 1) / ll) AS t FROM g)
    SELECT symbol, n AS n_obs, {r('b', name='hedge_ratio')}, {r('a', name='intercept')}, {r('t', name='adf_statistic')}, -3.41e0 AS critical_value,
    t < -3.41 AS cointegrated, 'tested' AS status FROM h""",
)
def cointegration(spark, d):
    b = V.bars(spark, d).select("symbol", "timestamp", "close")
    base = b.filter("symbol = 'S0'").select("timestamp", F.col("close").alias("x"))
    pairs = b.filter("symbol <> 'S0'").withColumnRenamed("close", "y").join(base, "timestamp")
    return rounded(X.cointegration(pairs))


_LN = [math.log(k) for k in range(1, 11)]
_LM = sum(_LN) / 10
_LW = [(a - _LM) / sum((b - _LM) ** 2 for b in _LN) for a in _LN]
_LAGW = ", ".join(f"({k}, {w!r})" for k, w in zip(range(1, 11), _LW))


@query(
    "hurst_from_vol",
    _H + _DAILY + f""", s AS (SELECT symbol, day, ln(greatest(annual_vol, 1e-10)) AS lr, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS d
      FROM (SELECT *, sqrt(rv * CASE WHEN n <= 50 THEN 252 ELSE 252.0e0 * 390 / n END) AS annual_vol FROM dv)),
    c AS (SELECT s.*, avg(lr) OVER p AS m, var_pop(lr) OVER p AS v FROM s WINDOW p AS (PARTITION BY symbol)),
    k AS (SELECT a.symbol, b.d - a.d AS k, ln(greatest(1e-10, abs(avg((a.lr - a.m) * (b.lr - b.m)) / a.v))) AS lc FROM c a JOIN c b
      ON a.symbol = b.symbol AND b.d BETWEEN a.d + 1 AND a.d + 10 GROUP BY a.symbol, 2, a.v),
    h AS (SELECT symbol, greatest(0.01e0, least(0.5e0, sum(w * lc) / 2)) AS hurst FROM k JOIN (VALUES {_LAGW}) l(k, w) USING (k) GROUP BY 1)
    SELECT symbol, {r('hurst')}, hurst < 0.3 AS is_rough, {r('(0.5e0 - hurst) / 0.5e0', name='edge_score')},
    CASE WHEN hurst < 0.2 THEN 'rough' WHEN hurst < 0.35 THEN 'semi_rough' ELSE 'classical' END AS vol_regime,
    CASE WHEN hurst < 0.2 THEN 1.15e0 WHEN hurst < 0.35 THEN 1.05e0 ELSE 1.0e0 END AS size_adjustment FROM h""",
)
def hurst_from_vol(spark, d):
    v = X.daily_realized(V.bars(spark, d)).withColumnRenamed("day", "timestamp").withColumnRenamed("annual_vol", "vol")
    return rounded(X.hurst_from_vol(v))


@query(
    "variance_ratio",
    _B + _RET + _CEN + f""", q AS (SELECT *, CASE WHEN d >= 4 THEN sum(lr) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS rq FROM c),
    g AS (SELECT symbol, n, var_samp(lr) AS v1, var_samp(rq) AS vq FROM q GROUP BY 1, 2),
    t AS (SELECT a.symbol, pow(2.0e0 * (5 - (b.d - a.d)) / 5, 2) * sum(pow(a.lr - a.m, 2) * pow(b.lr - b.m, 2)) AS th FROM c a JOIN c b
      ON a.symbol = b.symbol AND b.d BETWEEN a.d + 1 AND a.d + 4 GROUP BY a.symbol, b.d - a.d),
    u AS (SELECT g.symbol, any_value(n) AS n, any_value(vq / 5 / v1) AS vr, sum(th / pow(v1 * v1 * n, 2)) AS theta FROM g JOIN t USING (symbol) GROUP BY g.symbol),
    z AS (SELECT *, (vr - 1) / sqrt(greatest(theta, 1.0e0 / n) / n) AS z FROM u)
    SELECT symbol, {r('vr', name='variance_ratio')}, {r('z', name='z_statistic')},
    CASE WHEN vr > 1.05 THEN 'momentum' WHEN vr < 0.95 THEN 'mean_reversion' ELSE 'random_walk' END AS verdict,
    {r('least(1.0e0, abs(vr - 1) / 0.5e0)', name='strength')}, abs(z) > 1.96 AS significant FROM z""",
)
def variance_ratio(spark, d):
    return rounded(X.variance_ratio(_returns(spark, d)))


# expanding estimates: each day t uses rows 0..t-1; the oracle recomputes them from raw rows
@query(
    "rough_vol_features",
    _B + _RET + f""", v AS (SELECT symbol, timestamp, d, lr, ln(greatest(sqrt(lr * lr) * sqrt(252), 1e-10)) + 10 AS lv FROM x),
    p AS (SELECT *, sum(lr) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rq FROM v),
    e AS (SELECT a.symbol, a.d, a.timestamp, avg(b.lv) AS m, var_pop(b.lv) AS c0, var_samp(b.lr) AS v1,
      var_samp(CASE WHEN b.d >= 4 THEN b.rq END) AS vq FROM p a JOIN p b ON a.symbol = b.symbol AND b.d < a.d WHERE a.d >= 60 GROUP BY ALL),
    pp AS (SELECT a.symbol, b.d AS d2, b.d - a.d AS k, a.lv * b.lv AS prod, a.lv + b.lv AS s2 FROM v a JOIN v b ON a.symbol = b.symbol AND b.d BETWEEN a.d + 1 AND a.d + 10),
    cs AS (SELECT symbol, k, d2, sum(prod) OVER w AS sp, sum(s2) OVER w AS ss, count(*) OVER w AS cnt FROM pp WINDOW w AS (PARTITION BY symbol, k ORDER BY d2 ROWS UNBOUNDED PRECEDING)),
    lc AS (SELECT e.symbol, e.d, e.timestamp, e.v1, e.vq, cs.k, ln(greatest(1e-10, abs((sp - m * ss) / cnt + m * m) / c0)) AS lc FROM e JOIN cs ON e.symbol = cs.symbol AND cs.d2 = e.d - 1),
    h AS (SELECT symbol, d, timestamp, v1, vq, greatest(0.01e0, least(0.5e0, sum(w * lc) / 2)) AS hurst FROM lc JOIN (VALUES {_LAGW}) l(k, w) USING (k) GROUP BY ALL),
    j AS (SELECT *, vq / 5 / v1 AS vr, (0.5e0 - hurst) / 0.5e0 AS edge FROM h),
    s AS (SELECT *, stddev_samp(edge) OVER n AS es, avg(edge) OVER n AS em, stddev_samp(vr) OVER n AS vs FROM j WINDOW n AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT v.symbol, v.timestamp, {r('hurst', 5, 'rough_hurst')}, CASE WHEN hurst IS NULL THEN NULL WHEN hurst < 0.3 THEN 1.0e0 ELSE 0.0e0 END AS rough_is_rough,
    CASE WHEN hurst IS NULL THEN NULL WHEN hurst < 0.2 THEN 1.15e0 WHEN hurst < 0.35 THEN 1.05e0 ELSE 1.0e0 END AS rough_size_multiplier,
    {r('vr', 5, 'variance_ratio')}, {r('CASE WHEN vr IS NULL THEN NULL WHEN coalesce(vs, 0) * 3 < 1e-15 THEN 0 ELSE tanh((vr - 1) / (3 * vs)) END', 5, 'vr_signal')}
    FROM v LEFT JOIN s ON v.symbol = s.symbol AND v.d = s.d""",
)
def rough_vol_features(spark, d):
    return rounded(X.rough_vol_features(V.bars_1d(spark, d)).drop("rough_scalping_score"), 5)


@query("rough_vol_scores")
def rough_vol_scores(spark, d):
    days = X.intraday_days(V.bars(spark, d, 300))
    f = X.rough_vol_features(None, days=days, warm_up=20)
    return rounded(f)


_HAR = """, hx AS (SELECT symbol, timestamp, d, rv, CASE WHEN d >= 22 THEN rv END AS y, CASE WHEN d >= 22 THEN lag(rv) OVER o END AS x1,
      CASE WHEN d >= 22 THEN avg(rv) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) END AS x2,
      CASE WHEN d >= 22 THEN avg(rv) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 23 PRECEDING AND 2 PRECEDING) END AS x3,
      lag(rv) OVER o AS f1, avg(rv) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f2,
      avg(rv) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS f3
      FROM (SELECT *, lr * lr AS rv FROM x) WINDOW o AS (PARTITION BY symbol ORDER BY d))"""
_MOM = ", ".join(
    [f"avg({a}) {{o}} AS m{a}" for a in ("y", "x1", "x2", "x3")]
    + [f"covar_pop({a}, {b}) {{o}} AS {a}{b}" for i, a in enumerate(("x1", "x2", "x3")) for b in ("x1", "x2", "x3")[i:]]
    + [f"covar_pop({a}, y) {{o}} AS {a}y" for a in ("x1", "x2", "x3")]
)
# Gaussian elimination on the centred system
_ELIM = """, e1 AS (SELECT *, x2x2 - x1x2 * x1x2 / x1x1 AS a22, x2x3 - x1x2 * x1x3 / x1x1 AS a23, x3x3 - x1x3 * x1x3 / x1x1 AS a33,
      x2y - x1x2 * x1y / x1x1 AS t2, x3y - x1x3 * x1y / x1x1 AS t3 FROM mo),
    e2 AS (SELECT *, (t3 - a23 * t2 / a22) / (a33 - a23 * a23 / a22) AS b3 FROM e1),
    e3 AS (SELECT *, (t2 - a23 * b3) / a22 AS b2 FROM e2), e4 AS (SELECT *, (x1y - x1x2 * b2 - x1x3 * b3) / x1x1 AS b1 FROM e3)"""


@query(
    "har_features",
    _B + _RET + _HAR + ", mo AS (SELECT *, " + _MOM.format(o="OVER w") + """ FROM hx WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    + _ELIM + f""", fc AS (SELECT *, CASE WHEN d >= 30 THEN greatest(0, my + b1 * (f1 - mx1) + b2 * (f2 - mx2) + b3 * (f3 - mx3)) END AS fc FROM e4),
    sg AS (SELECT *, rv - fc AS res, coalesce(stddev_samp(rv - fc) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) AS sd FROM fc)
    SELECT symbol, timestamp, {rs('rv', digits=4)}, {r('fc', 4, 'har_rv_forecast')}, {r('res', 4, 'har_rv_residual')},
    {r('CASE WHEN res IS NULL THEN NULL WHEN 3 * sd < 1e-15 THEN 0 ELSE tanh(res / (3 * sd)) END', 4, 'har_rv_signal')}, false AS har_singular FROM sg""",
)
def har_features(spark, d):
    return rounded(X.har_features(V.bars_1d(spark, d)), 4)


@query(
    "har_fit",
    _B + _RET + _HAR + """, la AS (SELECT symbol, last(rv ORDER BY d) AS l1, count(*) AS n, avg(rv) FILTER (k <= 5) AS l2, avg(rv) FILTER (k <= 22) AS l3, covar_pop(y, y) AS yy
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM hx) GROUP BY symbol),
    mo AS (SELECT symbol, """ + _MOM.format(o="") + " FROM hx GROUP BY symbol)" + _ELIM + f""",
    ff AS (SELECT *, greatest(0, my + b1 * (l1 - mx1) + b2 * (l2 - mx2) + b3 * (l3 - mx3)) AS fc FROM e4 JOIN la USING (symbol))
    SELECT symbol, n AS n_obs, {r('fc', 4, 'forecast_rv')}, {r('sqrt(fc * 252)', 4, 'forecast_vol')}, {r('b1', 4, 'beta_daily')}, {r('b2', 4, 'beta_weekly')}, {r('b3', 4, 'beta_monthly')},
    {r('greatest(0, (b1 * x1y + b2 * x2y + b3 * x3y) / yy)', 4, 'r_squared')} FROM ff""",
)
def har_fit(spark, d):
    return rounded(X.har_fit(_returns(spark, d).withColumn("rv", F.pow("log_return", 2))), 4)


@query("har_intraday_broadcast")
def har_intraday_broadcast(spark, d):
    b = V.bars(spark, d, 300)
    f = X.har_features(None, warm_up=25, days=X.intraday_days(b))
    out = X.broadcast_days(b, f, ["har_rv_forecast"], ["har_rv_residual", "har_rv_signal"])
    return rounded(out.select("symbol", "timestamp", "close", "har_rv_forecast", "har_rv_residual", "har_rv_signal"))


@query(
    "garch_volatility",
    _B + _RET + f""", sd AS (SELECT symbol, var_pop(lr) AS v FROM x GROUP BY 1)
    SELECT a.symbol, a.timestamp, {r('sqrt(sum((0.0001e0 + 0.1e0 * b.lr * b.lr) * pow(0.85e0, a.d - b.d)) + any_value(v) * pow(0.85e0, a.d + 1))', name='garch_vol')}
    FROM x a JOIN x b ON a.symbol = b.symbol AND b.d <= a.d AND b.d > a.d - 400 JOIN sd ON sd.symbol = a.symbol GROUP BY a.symbol, a.timestamp, a.d""",
)
def garch_volatility(spark, d):
    return rounded(X.garch(_returns(spark, d)).select("symbol", "timestamp", "garch_vol"))


def _fw(d, th, mw=10_000):
    return ", ".join(f"({k}, {w!r})" for k, w in enumerate(X.frac_weights(d, th, mw)))


_TK = V.with_views("ticks")


@query(
    "frac_diff",
    _TK + f""", p AS (SELECT side, timestamp, seq, ln(price) AS lp, row_number() OVER (PARTITION BY side ORDER BY timestamp, seq) - 1 AS i FROM ticks),
    w(k, w) AS (VALUES {_fw(0.4, 1e-5)})
    SELECT a.side, a.seq, {r('sum(w * b.lp)', name='frac_diff')} FROM p a JOIN w ON true JOIN p b ON b.side = a.side AND b.i = a.i - k
    GROUP BY 1, 2, a.i HAVING count(*) = (SELECT count(*) FROM w)""",
)
def frac_diff(spark, d):
    """Ticks of each side: two series, longer than the 1 500 weights of this order."""
    p = V.ticks(spark, d).select("side", "timestamp", "seq", F.log("price").alias("log_price"))
    return rounded(X.frac_diff(p, 0.4, "log_price", keys=("side",), order=("timestamp", "seq")).select("side", "seq", "frac_diff"))


@query(
    "frac_diff_incremental",
    _B + f""", p AS (SELECT symbol, timestamp, ln(close) AS lp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars_1d),
    w(k, w) AS (VALUES {_fw(0.35, 1e-5, 50)})
    SELECT a.symbol, a.timestamp, {r('sum(w * b.lp)', name='frac_diff')} FROM p a JOIN w ON true JOIN p b ON b.symbol = a.symbol AND b.i = a.i - k
    GROUP BY 1, 2, a.i HAVING count(*) = 50""",
)
def frac_diff_incremental(spark, d):
    p = V.bars_1d(spark, d).select("symbol", "timestamp", F.log("close").alias("log_price"))
    return rounded(X.frac_diff(p, 0.35, "log_price", max_width=50).select("symbol", "timestamp", "frac_diff"))


_ADF = """, l AS (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY timestamp) AS xl FROM sv),
    a AS (SELECT symbol, covar_pop(v - xl, xl) / var_pop(xl) AS b, count(xl) AS m, count(xl) * var_pop(xl) AS sxx, count(xl) * (var_pop(v - xl) - covar_pop(v - xl, xl) * covar_pop(v - xl, xl) / var_pop(xl)) AS sse FROM l WHERE xl IS NOT NULL GROUP BY symbol),
    t AS (SELECT symbol, b / sqrt(greatest(1e-12, sse / (m - 2) / sxx)) AS t FROM a)"""


@query(
    "stationarity",
    _B + ", sv AS (SELECT symbol, timestamp, ln(close) AS v FROM bars_1d)" + _ADF + f" SELECT symbol, {r('t', name='t_stat')}, t < -2.86 AS stationary FROM t",
)
def stationarity(spark, d):
    p = V.bars_1d(spark, d).select("symbol", "timestamp", F.log("close").alias("log_price"))
    return rounded(X.stationarity(p, "log_price"))


@query(
    "minimum_frac_order",
    _B + f""", p AS (SELECT symbol, timestamp, ln(close) AS lp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars_1d),
    g AS (SELECT i AS step, i / 19.0e0 AS d FROM range(20) t(i)), ks AS (SELECT step, d, j FROM g, range(1, 10000) t(j)),
    ws AS (SELECT step, 0 AS k, 1.0e0 AS w FROM g UNION ALL SELECT step, j, product((j - 1 - d) / j) OVER (PARTITION BY step ORDER BY j) FROM ks),
    w AS (SELECT step, k, w FROM ws WHERE abs(w) >= 1e-5), n AS (SELECT step, count(*) AS n, sum(abs(w)) AS s FROM w GROUP BY 1), tt AS (SELECT step, sum(abs(w)) AS s FROM ws WHERE abs(w) >= 1e-8 GROUP BY 1),
    len AS (SELECT symbol, count(*) AS len FROM p GROUP BY 1),
    f AS (SELECT a.symbol, w.step, a.i, sum(w.w * b.lp) AS y FROM w JOIN n ON n.step = w.step JOIN len ON n.n <= len.len JOIN p a ON a.symbol = len.symbol AND a.i >= n.n - 1 JOIN p b ON b.symbol = a.symbol AND b.i = a.i - w.k GROUP BY 1, 2, 3),
    l AS (SELECT symbol, step, y, lag(y) OVER (PARTITION BY symbol, step ORDER BY i) AS x FROM f),
    m AS (SELECT symbol, step, count(*) AS m, count(*) * var_pop(x) AS sxx, count(*) * covar_pop(y - x, x) AS sxy, count(*) * var_pop(y - x) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT symbol, step, CASE WHEN m + 1 >= 20 AND sxx >= 1e-10 THEN sxy / sxx / sqrt(greatest(1e-12, greatest(0, syy - sxy * sxy / sxx) / (m - 2) / sxx)) END AS t FROM m),
    b AS (SELECT symbol, coalesce(min(step) FILTER (t < -2.86), 19) AS step, count(*) FILTER (t < -2.86) > 0 AS stationary FROM len LEFT JOIN t USING (symbol) GROUP BY 1)
    SELECT b.symbol, {r('step / 19.0e0', name='d')}, n.n AS n_lags, {r('100 * n.s / tt.s', name='memory_retained')}, {r('t.t', 4, 't_stat')}, stationary FROM b JOIN n USING (step) JOIN tt USING (step) LEFT JOIN t USING (symbol, step)""",
)
def minimum_frac_order(spark, d):
    p = V.bars_1d(spark, d).select("symbol", "timestamp", F.log("close").alias("log_price"))
    out = X.minimum_d(p, "log_price", steps=20)
    return rounded(rounded(out.withColumn("t_stat", F.round("t_stat", 4)).withColumn("d", F.round("d", 6)).withColumn("memory_retained", F.round("memory_retained", 6)), None), None)


_GEX = """, gr AS (SELECT timestamp, sum(CASE lower(trim(option_type)) WHEN 'call' THEN -1.0e0 ELSE 1.0e0 END * open_interest * gamma * spot_price * spot_price * 100) / 1e9 AS g,
      max(spot_price) AS s FROM option_chain GROUP BY 1)"""


@query(
    "gex_snapshots",
    V.with_views("option_chain") + _GEX + f" SELECT timestamp, {r('g', 5, 'gex_bn')}, {r('g / s * 1e3', 5, 'gex_normalized_mn')} FROM gr",
)
def gex_snapshots(spark, d):
    g = X.gex_snapshots(V.option_chain(spark, d))
    return rounded(g.select("timestamp", (F.col("gex_raw") / 1e9).alias("gex_bn"), (F.col("gex_normalized") / 1e6).alias("gex_normalized_mn")), 5)


_GEXF = _GEX + f""", gs AS (SELECT *, avg(g) OVER w AS m, stddev_samp(g) OVER w AS sd, count(*) OVER w AS n FROM gr
      WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
    gz AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN sd < 1e-15 THEN 0.0e0 ELSE (g - m) / sd END AS z FROM gs)"""


@query(
    "gex_features",
    V.with_views("option_chain") + _GEXF + f""" SELECT 'IDX' AS symbol, timestamp, {r('z', name='gex_zscore')},
    CASE WHEN z < -1 THEN -1.0e0 WHEN z > 1 THEN 1.0e0 WHEN z IS NOT NULL THEN 0.0e0 END AS gex_regime, {r('tanh(z / 3)', name='gex_signal')} FROM gz""",
)
def gex_features(spark, d):
    s = X.gex_snapshots(V.option_chain(spark, d)).withColumn("symbol", F.lit("IDX"))
    return rounded(X.gex_features(s).select("symbol", "timestamp", "gex_zscore", "gex_regime", "gex_signal"))


@query(
    "gex_attached",
    V.with_views("option_chain") + _GEXF + f""" SELECT o.timestamp, strike, trim(option_type) AS option_type, open_interest, gamma, {r('g', 5, 'gex_bn')}, {r('z', name='gex_zscore')}
    FROM option_chain o LEFT JOIN gz ON o.timestamp = gz.timestamp""",
)
def gex_attached(spark, d):
    c = V.option_chain(spark, d)
    s = X.gex_features(X.gex_snapshots(c).withColumn("symbol", F.lit("IDX")))
    out = c.join(s.select("timestamp", "gex_raw", "gex_zscore"), "timestamp", "left")
    return rounded(
        out.select("timestamp", "strike", F.trim("option_type").alias("option_type"), "open_interest", "gamma", F.round((F.col("gex_raw") / 1e9) + 1.7e-9, 5).alias("gex_bn"), "gex_zscore")
    )


@query(
    "gex_magnet_strikes",
    V.with_views("option_chain") + f""", g AS (SELECT strike, sum(CASE WHEN lower(trim(option_type)) = 'put' THEN -1.0e0 ELSE 1.0e0 END * gamma * open_interest * 100) AS g FROM option_chain GROUP BY 1)
    SELECT strike, {r('g', 4, 'gex')}, CAST(row_number() OVER (ORDER BY abs(g) DESC, strike) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (ORDER BY abs(g) DESC, strike) <= 10""",
)
def gex_magnet_strikes(spark, d):
    return rounded(X.gex_by_strike(V.option_chain(spark, d)), 4)
