"""Performance report queries."""

from pyspark.sql import functions as F

from ..operators import performance as P
from ..operators import trades as T
from ..sources import views as V
from . import query, r, rnd, rounded, rs
from .trades import _PF

_T = V.with_views("trades")
K = ("strategy_id",)


def _eq(cap, keys="strategy_id", src="trades"):
    return f""", dp AS (SELECT {keys}, CAST(exit_time AS DATE) AS day, sum(net_pnl) AS pnl FROM {src} GROUP BY ALL),
    sp AS (SELECT {keys}, min(day) AS a, max(day) AS b FROM dp GROUP BY ALL),
    gr AS (SELECT {keys}, CAST(unnest(generate_series(a - 1, b, INTERVAL 1 DAY)) AS DATE) AS day FROM sp),
    eq AS (SELECT {keys}, day, row_number() OVER w - 1 AS pos, {cap} + sum(coalesce(pnl, 0)) OVER (PARTITION BY {keys} ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM gr LEFT JOIN dp USING ({keys}, day) WINDOW w AS (PARTITION BY {keys} ORDER BY day)),
    rr AS (SELECT {keys}, day, pos, (equity - p) / p AS ret FROM (SELECT *, lag(equity) OVER (PARTITION BY {keys} ORDER BY pos) AS p FROM eq) WHERE p > 0)"""


_EQ = _eq("100000.0e0")


@query(
    "trade_equity_curve",
    _T + f" SELECT trade_id, row_number() OVER w AS trade_no, {r('100000 + sum(net_pnl) OVER w', 2, 'equity')} FROM trades WINDOW w AS (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)",
)
def trade_equity_curve(spark, d):
    return rounded(P.trade_equity(V.trades(spark, d), 100_000.0).select("trade_id", "trade_no", "equity"), 2)


@query("daily_equity_curve", _T + _EQ + f" SELECT strategy_id, CAST(day AS TIMESTAMP) AS day, pos, {r('equity', 2)} FROM eq")
def daily_equity_curve(spark, d):
    return rounded(P.daily_equity(V.trades(spark, d), 100_000.0).withColumn("pos", F.col("pos").cast("long")), 2)


@query("daily_returns", _T + _EQ + f" SELECT strategy_id, CAST(day AS TIMESTAMP) AS day, {r('ret')} FROM rr")
def daily_returns(spark, d):
    return rounded(P.daily_returns(P.daily_equity(V.trades(spark, d), 100_000.0)).drop("pos"))


_DD = """, pk AS (SELECT *, max(equity) OVER (PARTITION BY {k} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
    ds AS (SELECT *, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS dd, min(pos) OVER (PARTITION BY {k}, peak) AS pa FROM pk),
    dd AS (SELECT {k}, max(dd) AS mdd, max(peak - equity) AS mda, sqrt(avg(dd * dd)) AS ulcer, CASE WHEN max(dd) > 0 THEN first(pos - pa ORDER BY dd DESC, pos) ELSE 0 END AS dur, max(pos - pa) AS longest FROM ds GROUP BY {k})"""


@query(
    "drawdown",
    _T + _EQ + _DD.format(k="strategy_id") + f" SELECT strategy_id, {r('mdd', name='max_drawdown')}, {r('mda', 2, 'max_drawdown_absolute')}, {r('ulcer', name='ulcer_index')}, CAST(dur AS BIGINT) AS max_drawdown_duration, CAST(longest AS BIGINT) AS longest_periods FROM dd",
)
def drawdown(spark, d):
    eq = P.daily_equity(V.trades(spark, d), 100_000.0)
    x = P.drawdown(eq).join(P.longest_drawdown(eq).drop("max_drawdown"), "strategy_id")
    x = x.withColumn("max_drawdown_absolute", F.round(F.col("max_drawdown_absolute") + 1.7e-6, 2))
    return rounded(x.withColumn("max_drawdown_duration", F.col("max_drawdown_duration").cast("long")).withColumn("longest_periods", F.col("longest_periods").cast("long")))


_X = ", ex AS (SELECT strategy_id, ret - 0.05e0 / 252 AS x FROM rr)"


@query(
    "risk_ratios",
    _T + _EQ + _X + f""" SELECT strategy_id, count(*) AS n_obs, {r('avg(x) / stddev_samp(x) * sqrt(252)', name='sharpe')}, {r('avg(x) / stddev_samp(x) FILTER (x < 0) * sqrt(252)', name='sortino_negatives')}, {r('avg(x) / sqrt(avg(pow(least(x, 0), 2))) * sqrt(252)', name='sortino')} FROM ex GROUP BY 1""",
)
def risk_ratios(spark, d):
    return rounded(P.risk_ratios(P.daily_returns(P.daily_equity(V.trades(spark, d), 100_000.0)), K))


_MOM = """, mo AS (SELECT strategy_id, count(*) AS n, avg({x}) AS m, stddev_samp({x}) AS s, skewness({x}) AS sk, kurtosis({x}) AS ku FROM {t} GROUP BY 1)"""


@query(
    "return_distribution",
    _T + _EQ + _MOM.format(x="ret", t="rr") + f""", q AS (SELECT strategy_id, quantile_cont(ret, 0.95) AS hi, quantile_cont(ret, 0.05) AS lo FROM rr GROUP BY 1)
    SELECT strategy_id, n AS n_obs, {r('m', name='mean_ret')}, {r('s', name='std_ret')}, {r('sk', 5, 'skewness')}, {r('ku', 5, 'excess_kurtosis')}, {r('CASE WHEN abs(lo) < 1e-12 THEN NULL ELSE abs(hi) / abs(lo) END', 5, 'tail_ratio')} FROM mo JOIN q USING (strategy_id)""",
)
def return_distribution(spark, d):
    x = P.daily_returns(P.daily_equity(V.trades(spark, d), 100_000.0))
    out = P.return_moments(x, K).join(P.tail_ratio(x, K), list(K))
    return rounded(out.withColumns({c: F.round(F.col(c) + 1.7e-9, 5) for c in ("skewness", "excess_kurtosis", "tail_ratio")}))


_Z = """, z AS (SELECT *, m / s AS sr, (1 - sk * (m / s) + (ku + 2) / 4 * (m / s) * (m / s)) / (n - 1) AS v FROM mo)"""


@query(
    "sharpe_significance",
    _T + _EQ + _X + _MOM.format(x="x", t="ex") + _Z + f" SELECT strategy_id, n AS n_obs, {r('sr', name='sr')}, {r('sr / sqrt(v)', 5, 'psr_z')}, {r(f'(sr - sqrt(v) * {P.expected_max(10)!r}) / sqrt(v)', 5, 'dsr_z')} FROM z",
)
def sharpe_significance(spark, d):
    x = P.daily_returns(P.daily_equity(V.trades(spark, d), 100_000.0)).withColumn("ret", F.col("ret") - 0.05 / 252)
    s = P.sharpe_significance(P.return_moments(x, K), n_trials=10).select("strategy_id", "n_obs", "sr", "psr_z", "dsr_z")
    return rounded(s.withColumns({c: F.round(F.col(c) + 1.7e-9, 5) for c in ("psr_z", "dsr_z")}))


# Standard normal distribution by the rational approximation of Abramowitz and Stegun (26.2.17), below 1e-7 off.
def _cdf(z):
    k = f"(1 / (1 + 0.2316419e0 * abs({z})))"
    tail = f"exp(-0.5e0 * ({z}) * ({z})) * 0.3989422804014327e0 * {k} * (0.319381530e0 + {k} * (-0.356563782e0 + {k} * (1.781477937e0 + {k} * (-1.821255978e0 + {k} * 1.330274429e0))))"
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


_PZ, _DZ = "(sr / sqrt(v))", f"((sr - greatest(0, sqrt(greatest(v, 1e-10)) * {P.expected_max(10)!r})) / sqrt(greatest(v, 1e-10)))"


@query(
    "sharpe_probabilities",
    _T + _EQ + _X + _MOM.format(x="x", t="ex") + _Z + f" SELECT strategy_id, {r(_cdf(_PZ), 5, 'psr')}, {r(_cdf(_DZ), 5, 'dsr')}, CASE WHEN sr <= 0 THEN 1000000000 ELSE greatest(1, CAST(ceil(1 + v * (n - 1) * pow(1.6448536269514722e0 / sr, 2)) AS BIGINT)) END AS min_track_record FROM z",
)
def sharpe_probabilities(spark, d):
    x = P.daily_returns(P.daily_equity(V.trades(spark, d), 100_000.0)).withColumn("ret", F.col("ret") - 0.05 / 252)
    s = P.probabilities(P.sharpe_significance(P.return_moments(x, K), n_trials=10))
    s = P.track_record_length(s, F.col("sr") * P.ANNUAL, F.lit(0.0), F.col("skewness"), F.col("excess_kurtosis"))
    return rounded(s.select("strategy_id", "psr", "dsr", "min_track_record"), 5)


@query(
    "strategy_activity",
    _T + f""", g AS (SELECT strategy_id, count(*) AS n, sum(net_pnl) AS p, sum(abs(entry_price * size)) AS nt, greatest(epoch(max(exit_time) - first(entry_time ORDER BY exit_time, trade_id)) / (365.25e0 * 86400), 1 / 365.25e0) AS y,
      avg(0.02e0 * sqrt(abs(entry_price * size) / 1e6) * 1e4 * 0.11e0) AS slip FROM trades GROUP BY 1)
    SELECT strategy_id, n AS trade_count, {r('p', 2, 'total_pnl')}, {r('slip', 4, 'avg_slippage_bps')}, {r('y', 6, 'years')}, {r('100000 + p', 2, 'final_equity')}, {r('CASE WHEN 1 + p / 100000 > 0 THEN pow(1 + p / 100000, 1 / y) - 1 ELSE 0 END', name='cagr')},
    {r('CASE WHEN 100000 + p / 2 > 0 THEN nt / y / (100000 + p / 2) ELSE 0 END', 3, 'annualized_turnover')}, {r('CASE WHEN p > 0 THEN 1e6 * pow(p / nt * 1e4 * 0.25 / 10, 2) END', 2, 'capacity_usd')} FROM g""",
)
def strategy_activity(spark, d):
    a = P.activity(V.trades(spark, d), 100_000.0)
    return rounded(a.withColumns({c: F.round(F.col(c) + 1.7 * 10.0 ** -(k + 4), k) for c, k in (("total_pnl", 2), ("final_equity", 2), ("avg_slippage_bps", 4), ("annualized_turnover", 3), ("capacity_usd", 2))}))


_RG = _eq("1.0e0", "regime").replace("eq AS", "eq AS", 1)


@query(
    "regime_performance",
    _T + _eq("1.0e0", "regime") + _DD.format(k="regime") + f""", b AS (SELECT regime, count(*) AS n, avg((net_pnl > 0)::INT) AS wr, avg(net_pnl) AS ap, sum(net_pnl) AS tp FROM trades GROUP BY 1),
    s AS (SELECT regime, avg(ret - 0.05e0 / 252) / stddev_samp(ret - 0.05e0 / 252) * sqrt(252) AS sh, count(*) AS k FROM rr GROUP BY 1)
    SELECT b.regime, n AS trade_count, {r('wr', name='win_rate')}, {r('ap', 4, 'avg_pnl')}, {r('tp', 2, 'total_pnl')}, {r('CASE WHEN k >= 2 THEN sh ELSE 0 END', 4, 'sharpe')}, {r('mdd', 2, 'max_drawdown')}, {r('ulcer', 2, 'ulcer_index')} FROM b LEFT JOIN s USING (regime) LEFT JOIN dd USING (regime)""",
)
def regime_performance(spark, d):
    x = P.regime_stats(V.trades(spark, d), ("regime",))
    return rounded(x.withColumns({c: F.round(F.col(c) + 1.7 * 10.0 ** -(k + 4), k) for c, k in (("total_pnl", 2), ("avg_pnl", 4), ("sharpe", 4), ("max_drawdown", 2), ("ulcer_index", 2))}))


def _report_sql(k, src, trials):
    """Twin of ``P.report`` for keys ``k`` over ``src``."""
    pz, dz = "sr / sqrt(v)", f"(sr - greatest(0, sqrt(greatest(v, 1e-10)) * {P.expected_max(trials)!r})) / sqrt(greatest(v, 1e-10))"
    return _eq("100000.0e0", k, src) + _DD.format(k=k) + f""", ac AS (SELECT {k}, count(*) AS trade_count, sum(net_pnl) AS p, sum(abs(entry_price * size)) AS nt, greatest(epoch(max(exit_time) - first(entry_time ORDER BY exit_time, trade_id)) / (365.25e0 * 86400), 1 / 365.25e0) AS y,
      avg(0.02e0 * sqrt(abs(entry_price * size) / 1e6) * 1e4 * 0.11e0) AS slip, avg((net_pnl > 0)::INT) AS wr, avg(net_pnl) FILTER (net_pnl > 0) AS aw, -avg(net_pnl) FILTER (net_pnl < 0) AS al, {_PF} AS pf FROM {src} GROUP BY {k}),
    rq AS (SELECT {k}, ret, ret - 0.05e0 / 252 AS x FROM rr),
    m0 AS (SELECT {k}, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, skewness(x) AS xs, kurtosis(x) AS xk, skewness(ret) AS sk, kurtosis(ret) AS ku, sqrt(avg(pow(least(x, 0), 2))) AS lo, quantile_cont(ret, 0.95) AS q95, quantile_cont(ret, 0.05) AS q05 FROM rq GROUP BY {k}),
    m1 AS (SELECT *, m / s AS sr, (1 - xs * (m / s) + (xk + 2) / 4 * (m / s) * (m / s)) / (n - 1) AS v FROM m0),
    m2 AS (SELECT *, {pz} AS pz, {dz} AS dz FROM m1),
    a2 AS (SELECT *, CASE WHEN 1 + p / 100000 > 0 THEN pow(1 + p / 100000, 1 / y) - 1 ELSE 0 END AS cg FROM ac),
    rp AS (SELECT * FROM a2 JOIN m2 USING ({k}) JOIN dd USING ({k}))"""


_REPORT = f"""trade_count, {r('p', 2, 'total_pnl')}, {r('slip', 4, 'avg_slippage_bps')}, {r('y', 5, 'years')}, {r('100000 + p', 2, 'final_equity')}, {r('cg', 5, 'cagr')}, {r('CASE WHEN 100000 + p / 2 > 0 THEN nt / y / (100000 + p / 2) ELSE 0 END', 3, 'annualized_turnover')},
    {r('CASE WHEN p > 0 THEN 1e6 * pow(p / nt * 1e4 * 0.25 / 10, 2) END', 2, 'capacity_usd')}, {r('wr', 5, 'win_rate')}, {r('aw', 4, 'avg_win')}, {r('al', 4, 'avg_loss')}, {r('pf', 4, 'profit_factor')}, {r('m / s * sqrt(252)', 5, 'sharpe')}, {r('m / lo * sqrt(252)', 5, 'sortino')},
    {r('sk', 5, 'skewness')}, {r('ku', 4, 'excess_kurtosis')}, {r('abs(q95) / abs(q05)', 5, 'tail_ratio')}, {r('pz', 5, 'psr_z')}, {r('dz', 5, 'dsr_z')}, {r('mdd', 5, 'max_drawdown')}, {r('mda', 2, 'max_drawdown_absolute')}, {r('ulcer', 5, 'ulcer_index')}, CAST(dur AS BIGINT) AS max_drawdown_duration,
    {r('CASE WHEN mdd = 0 THEN 0 ELSE cg / mdd END', 5, 'calmar')}, {r('CASE WHEN ulcer > 0 THEN (cg - 0.05e0) / ulcer ELSE 0 END', 5, 'martin_ratio')}"""
_DIGITS = {"total_pnl": 2, "final_equity": 2, "capacity_usd": 2, "max_drawdown_absolute": 2, "annualized_turnover": 3, "avg_slippage_bps": 4, "avg_win": 4, "avg_loss": 4, "profit_factor": 4, "excess_kurtosis": 4}


def _report_rounded(x):
    """Amounts to fewer digits than ratios: sums of many rows differ in the last bits between engines."""
    x = x.withColumn("max_drawdown_duration", F.col("max_drawdown_duration").cast("long"))
    return rounded(x.withColumns({c: rnd(c, n) for c, n in _DIGITS.items()}), 5)


@query("performance_report", _T + _report_sql("strategy_id", "trades", 10) + f" SELECT strategy_id, {_REPORT}, {r(_cdf('pz'), 5, 'psr')}, {r(_cdf('dz'), 5, 'dsr')} FROM rp")
def performance_report(spark, d):
    return _report_rounded(P.report(V.trades(spark, d), n_trials=10))


@query("full_report")
def full_report(spark, d):
    x = P.full_report(V.trades(spark, d), n_trials=10, oos_fraction=0.3)
    return _report_rounded(x)


@query(
    "report_breakdowns",
    _T + _eq("1.0e0", "strategy_id, regime") + _DD.format(k="strategy_id, regime") + f""", b AS (SELECT strategy_id, dimension, label, count(*) AS n, avg((net_pnl > 0)::INT) AS wr, avg(net_pnl) AS ap, sum(net_pnl) AS tp
      FROM (SELECT strategy_id, net_pnl, unnest(['regime', 'session', 'signal_type']) AS dimension, unnest([regime, session, signal_type]) AS label FROM trades) GROUP BY ALL),
    s AS (SELECT strategy_id, regime, avg(ret - 0.05e0 / 252) / stddev_samp(ret - 0.05e0 / 252) * sqrt(252) AS sh, count(*) AS k FROM rr GROUP BY ALL),
    e AS (SELECT strategy_id, regime AS label, 'regime' AS dimension, CASE WHEN k >= 2 THEN sh ELSE 0 END AS sh, mdd FROM dd LEFT JOIN s USING (strategy_id, regime)),
    h AS (SELECT strategy_id, sum(tp * tp) / (sum(abs(tp)) * sum(abs(tp))) AS hhi FROM b WHERE dimension = 'regime' GROUP BY 1)
    SELECT b.strategy_id, b.dimension, b.label, n AS trade_count, {r('wr', 5, 'win_rate')}, {r('ap', 4, 'avg_pnl')}, {r('tp', 2, 'total_pnl')}, {r("CASE WHEN b.dimension = 'regime' THEN coalesce(sh, 0) END", 4, 'sharpe')}, {r("mdd", 2, 'max_drawdown')}, {r('hhi', 5, 'regime_concentration')}
    FROM b LEFT JOIN e USING (strategy_id, dimension, label) JOIN h USING (strategy_id)""",
)
def report_breakdowns(spark, d):
    b = P.breakdowns(V.trades(spark, d))
    none = [F.lit(None).cast("double").alias(c) for c in ("sharpe", "max_drawdown")]
    rows = None
    for name, column in (("session", "by_session"), ("signal_type", "by_signal"), ("regime", "by_regime")):
        x = b.select("strategy_id", "regime_concentration", F.lit(name).alias("dimension"), F.inline(column))
        x = x.select("strategy_id", "dimension", "label", "trade_count", "win_rate", "avg_pnl", "total_pnl", *(["sharpe", "max_drawdown"] if name == "regime" else none), "regime_concentration")
        rows = x if rows is None else rows.unionByName(x)
    return rounded(rows.withColumns({c: rnd(c, n) for c, n in (("avg_pnl", 4), ("total_pnl", 2), ("sharpe", 4), ("max_drawdown", 2))}), 5)


_IO = """, o AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM trades),
    st AS (SELECT strategy_id, min(exit_time) AS s FROM o WHERE i >= floor(n * (1.0e0 - 0.3e0)) GROUP BY 1),
    sm AS (SELECT o.*, CASE WHEN i >= floor(n * (1.0e0 - 0.3e0)) THEN 'out' WHEN exit_time < s - INTERVAL 5 DAY THEN 'in' END AS sample FROM o JOIN st USING (strategy_id))"""


@query("in_out_split", _T + _IO + " SELECT trade_id, sample FROM sm")
def in_out_split(spark, d):
    return P.split_in_out(V.trades(spark, d)).select("trade_id", "sample")


_SM = _T + _IO + ", sx AS (SELECT * FROM sm WHERE sample IS NOT NULL)" + _report_sql("strategy_id, sample", "sx", 1)


@query("in_out_report", _SM + f" SELECT strategy_id, sample, {_REPORT} FROM rp")
def in_out_report(spark, d):
    t = P.split_in_out(V.trades(spark, d)).filter("sample IS NOT NULL")
    return _report_rounded(P.report(t, keys=("strategy_id", "sample"), with_probabilities=False))


@query(
    "report_degradation",
    _SM + f""", w AS (SELECT strategy_id, max(m / s * sqrt(252)) FILTER (sample = 'in') AS a, max(m / s * sqrt(252)) FILTER (sample = 'out') AS b, max(trade_count) FILTER (sample = 'in') AS na, max(trade_count) FILTER (sample = 'out') AS nb FROM rp GROUP BY 1)
    SELECT strategy_id, na AS is_trades, nb AS oos_trades, {r('a', 5, 'is_sharpe')}, {r('b', 5, 'oos_sharpe')}, {r('coalesce((a - b) / abs(a) * 100, 0)', 4, 'oos_sharpe_degradation')} FROM w""",
)
def report_degradation(spark, d):
    x = P.in_out_reports(V.trades(spark, d), 0.3)
    x = x.select("strategy_id", F.col("is_report.trade_count").alias("is_trades"), F.col("oos_report.trade_count").alias("oos_trades"), F.col("is_report.sharpe").alias("is_sharpe"), F.col("oos_report.sharpe").alias("oos_sharpe"), "oos_sharpe_degradation")
    return rounded(x.withColumn("oos_sharpe_degradation", rnd("oos_sharpe_degradation", 4)), 5)


@query(
    "cost_sensitivity",
    _T + """, cs AS (SELECT t.strategy_id, scenario, exit_time, net_pnl - abs(entry_price * size) * bps * 2 / 10000 AS net_pnl FROM trades t, (VALUES ('zero', 0.0e0), ('realistic', 10.0e0), ('stress', 20.0e0)) c(scenario, bps))"""
    + _eq("100000.0e0", "strategy_id, scenario", "cs") + f""", s AS (SELECT strategy_id, scenario, avg(ret - 0.05e0 / 252) / stddev_samp(ret - 0.05e0 / 252) * sqrt(252) AS sh FROM rr GROUP BY 1, 2),
    p AS (SELECT strategy_id, scenario, sum(net_pnl) AS p FROM cs GROUP BY 1, 2)
    SELECT strategy_id, {r("max(sh) FILTER (scenario = 'zero')", name='zero_sharpe')}, {r("max(sh) FILTER (scenario = 'realistic')", name='realistic_sharpe')}, {r("max(sh) FILTER (scenario = 'stress')", name='stress_sharpe')},
    max(sh) FILTER (scenario = 'stress') > 0 AND max(p) FILTER (scenario = 'stress') > 0 AS profitable_stress FROM s JOIN p USING (strategy_id, scenario) GROUP BY 1""",
)
def cost_sensitivity(spark, d):
    c = P.cost_sensitivity(V.trades(spark, d), 10.0)
    return rounded(c.select("strategy_id", "zero_sharpe", "realistic_sharpe", "stress_sharpe", "profitable_stress"))


@query("bootstrap_sharpe_interval")
def bootstrap_sharpe_interval(spark, d):
    x = P.daily_returns(P.daily_equity(V.trades(spark, d), 1_000_000.0))
    return rounded(P.bootstrap_interval(x, n_boot=1000))


@query("simulated_value_at_risk")
def simulated_value_at_risk(spark, d):
    x = P.daily_returns(P.daily_equity(V.trades(spark, d), 10_000_000.0))
    return rounded(P.simulated_risk(x, n_paths=1000))
