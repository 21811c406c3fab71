"""Volatility and time-series statistics.

Inputs are bars: at most one row per symbol and interval, so a window per symbol is bounded by the
calendar and one task can hold it. Whole-series statistics are plain aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import add, clamp, log_ratio, pick, quotient, ratio, safe_tanh


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("timestamp")


def log_return(price: str = "close", keys: Sequence[str] = ("symbol",)) -> Column:
    return log_ratio(F.col(price), F.lag(price).over(by_time(*keys)))


def with_returns(bars: DataFrame) -> DataFrame:
    """Log and simple returns against the previous bar (null on the first)."""
    prev = F.lag("close").over(by_time())
    return bars.withColumn("log_return", log_ratio(F.col("close"), prev)).withColumn("simple_return", quotient(F.col("close"), prev) - 1)


def daily_realized(bars: DataFrame, across_zero: bool = False) -> DataFrame:
    """Per symbol and day: realized variance, bipower variation, jump part, annualised volatility.

    A close of 0 makes the day's variance infinite; ``across_zero`` takes the return from the last close
    above 0 instead, and a bar at 0 has none."""
    d = bars.withColumn("day", F.to_date("timestamp"))
    w = by_time("symbol", "day")
    if across_zero:
        some = F.when(F.col("close") > 0, F.col("close"))
        before = F.last(some, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("r", F.log(some / before))
        d = d.withColumn("p", F.abs("r") * F.abs(F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    else:
        d = d.withColumn("r", log_ratio(F.col("close"), F.lag("close").over(w)))
        d = d.withColumn("p", F.abs("r") * F.abs(F.lag("r").over(w)))
    g = d.groupBy("symbol", "day").agg(
        F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("rv"),
        (F.lit(math.pi / 2) * F.coalesce(F.sum("p"), F.lit(0.0))).alias("bv"),
        F.coalesce(F.sum("r"), F.lit(0.0)).alias("day_return"),
        F.count("r").alias("n_returns"),
    )
    jump = F.greatest(F.lit(0.0), F.col("rv") - F.col("bv"))
    share = ratio(jump, F.col("rv"), 0.0)
    n = F.col("n_returns")
    factor = F.when(n <= 50, F.lit(252.0)).otherwise(F.lit(252.0 * 390.0) / F.greatest(n, F.lit(1)))
    return (
        g.withColumn("jump", jump)
        .withColumn("jump_ratio", share)
        .withColumn("has_jump", share > 0.01)
        .withColumn("annual_vol", F.sqrt(F.col("rv") * factor))
    )


def amihud(bars: DataFrame) -> DataFrame:
    r = F.abs(F.col("simple_return")) / F.when(F.col("volume") > 0, F.col("volume"))
    return with_returns(bars).groupBy("symbol").agg(F.coalesce(F.avg(r), F.lit(0.0)).alias("amihud"))


def informed_trading(flows: DataFrame) -> DataFrame:
    """Probability-of-informed-trading estimate from rows (symbol, buy, sell)."""
    d = F.col("buy") - F.col("sell")
    g = flows.groupBy("symbol").agg(
        F.stddev_pop(d).alias("sd"),
        F.avg(F.col("buy") + F.col("sell")).alias("total"),
        F.avg(F.abs(d)).alias("mu"),
        F.avg(F.least("buy", "sell")).alias("eps"),
    )
    x = ratio(F.col("sd"), F.col("total"), 0.0) * F.col("mu")
    return g.select("symbol", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(ratio(x, x + 2 * F.col("eps"), 0.0)).alias("pin"))


def _centered(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    stat = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    return df.join(stat, list(keys)).withColumn("_x", F.col(value) - F.col("_m"))


def ljung_box(series: DataFrame, value: str = "log_return", lags: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Q statistic over the first ``lags`` autocorrelations; flagged above 1.5 * lags."""
    s = _centered(series.filter(F.col(value).isNotNull()), value, keys)
    w = by_time(*keys)
    for k in range(1, lags + 1):
        s = s.withColumn(f"_p{k}", F.col("_x") * F.lag("_x", k).over(w))
    g = s.groupBy(*keys, "_n", "_v").agg(*[F.avg(f"_p{k}").alias(f"_c{k}") for k in range(1, lags + 1)])
    v, n = F.when(F.col("_v") > 0, F.col("_v")), F.col("_n")
    total = add([F.pow(F.col(f"_c{k}") / v, 2) / (n - k) for k in range(1, lags + 1)])
    q = F.when((n < lags + 1) | (F.col("_v") == 0), F.lit(0.0)).otherwise(n * (n + 2) * total)
    return g.select(*keys, q.alias("q_stat"), (q > 1.5 * lags).alias("significant"))


def hurst_rs(series: DataFrame, value: str = "close", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rescaled-range exponent on levels: ln(R/S)/ln(n), 0.5 when undefined or n < 20."""
    s = _centered(series, value, keys)
    s = s.withColumn("_c", F.sum("_x").over(by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy(*keys).agg(
        (F.max("_c") - F.min("_c")).alias("rng"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    rs = F.when((F.col("sd") > 0) & (F.col("rng") > 0), F.col("rng") / F.when(F.col("sd") > 0, F.col("sd")))
    h = F.log(rs) / F.log(F.when(F.col("n") > 1, F.col("n")))
    return g.select(*keys, F.when(F.col("n") < 20, F.lit(0.5)).otherwise(F.coalesce(h, F.lit(0.5))).alias("hurst"))


def tail_correlation(series: DataFrame, benchmark: DataFrame, window: int = 60, value: str = "log_return") -> DataFrame:
    """Correlation of the last ``window`` values of each symbol with those of one benchmark series.

    Values are aligned from the end; 0 when either is constant, null when one is too short."""
    back = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    a = series.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= window)
    b = benchmark.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= window)
    j = a.select("symbol", "_k", F.col(value).alias("x")).join(
        F.broadcast(b.select("_k", F.col(value).alias("y"))), "_k", "left"  # at most ``window`` rows
    )
    g = j.groupBy("symbol").agg(
        F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count("y").alias("n")
    )
    return g.select(
        "symbol", F.when(F.col("n") >= window, ratio(F.col("c"), F.col("sx") * F.col("sy"), 0.0)).alias("correlation")
    )


def moment_matrix(wide: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson matrix of columns as rows (a, b, correlation), from one aggregation with map-side combine.

    Rows with a null or NaN in any column are skipped; constant columns have correlation 0, the diagonal is 1.
    The moments are taken around the column means, which a first small aggregate provides."""
    ok = None
    for x in cols:
        cond = F.col(x).isNotNull() & ~F.isnan(x)
        ok = cond if ok is None else ok & cond
    rows = wide.filter(ok)
    keys = list(keys)
    means = rows.groupBy(*keys).agg(*[F.avg(x).alias(f"_m_{x}") for x in cols])
    rows = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))  # one row
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]
    d = {x: F.col(x) - F.col(f"_m_{x}") for x in cols}
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(d[x] * d[y]).alias(f"_{i}") for i, (x, y) in enumerate(pairs)]
    )
    at = {p: F.col(f"_{i}") for i, p in enumerate(pairs)}

    def rho(x, y):
        if x == y:
            return F.lit(1.0)
        v = at.get((x, y), at.get((y, x)))
        return ratio(v, F.sqrt(at[x, x] * at[y, y]), 0.0)

    out = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), rho(x, y).alias("correlation")) for x in cols for y in cols]))
    return g.select(*keys, "n_rows", out.alias("_o")).select(*keys, "_o.a", "_o.b", "_o.correlation", "n_rows")


def asset_correlations(returns: DataFrame, symbols: Sequence[str], value: str = "log_return") -> DataFrame:
    """Correlation matrix of a given list of symbols over their common timestamps (0 for constant series, 1 on the diagonal).

    The symbols of a timestamp are gathered in one row, as many as the list names, and paired there."""
    known = returns.filter(F.col("symbol").isin(*symbols) & F.col(value).isNotNull() & ~F.isnan(value))
    one = known.groupBy("timestamp", "symbol").agg(F.first(value).alias("x"))
    rows = one.groupBy("timestamp").agg(F.collect_list(F.struct(F.col("symbol").alias("a"), "x")).alias("_all")).filter(F.size("_all") == len(symbols))
    pairs = rows.select("_all", F.explode("_all").alias("p")).select("p", F.explode("_all").alias("q"))
    g = pairs.groupBy(F.col("p.a").alias("a"), F.col("q.a").alias("b")).agg(
        F.covar_pop("p.x", "q.x").alias("c"), F.stddev_pop("p.x").alias("sa"), F.stddev_pop("q.x").alias("sb"), F.count(F.lit(1)).alias("n_rows")
    )
    rho = F.when(F.col("a") == F.col("b"), 1.0).otherwise(ratio(F.col("c"), F.col("sa") * F.col("sb"), 0.0))
    return g.select("a", "b", rho.alias("correlation"), "n_rows")


def cointegration(pairs: DataFrame, keys: Sequence[str] = ("symbol",), significance: float = 0.05) -> DataFrame:
    """Two-step cointegration test of columns y and x over time, per key.

    Least squares of y on x, then the no-constant unit-root regression on the residuals."""
    crit = {0.10: -3.12, 0.05: -3.41, 0.01: -3.96}.get(significance, -3.41)  # fixed values
    fit = pairs.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("hedge_ratio"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    r = pairs.join(fit, list(keys)).withColumn("_r", F.col("y") - (F.col("intercept") + F.col("hedge_ratio") * F.col("x")))
    r = r.withColumn("_l", F.lag("_r").over(by_time(*keys))).withColumn("_d", F.col("_r") - F.col("_l"))
    g = r.groupBy(*keys, "hedge_ratio", "intercept", "n_obs").agg(
        F.sum(F.col("_l") * F.col("_d")).alias("ld"),
        F.sum(F.col("_l") * F.col("_l")).alias("ll"),
        F.sum(F.col("_d") * F.col("_d")).alias("dd"),
        F.count("_d").alias("m"),
    )
    tiny = F.lit(1e-300)
    rho = F.col("ld") / (F.col("ll") + tiny)
    sse = F.greatest(F.lit(0.0), F.col("dd") - 2 * rho * F.col("ld") + rho * rho * F.col("ll"))
    m1 = F.when(F.col("m") > 1, F.col("m") - 1)
    stat = rho / (F.sqrt((sse / m1 + tiny) / (F.col("ll") + tiny)) + tiny)
    ok = F.col("n_obs") >= 10
    return g.select(
        *keys,
        "n_obs",
        F.when(ok, F.col("hedge_ratio")).alias("hedge_ratio"),
        F.when(ok, F.col("intercept")).alias("intercept"),
        F.when(ok, stat).alias("adf_statistic"),
        F.when(ok, F.lit(crit)).alias("critical_value"),
        (ok & (F.coalesce(stat, F.lit(0.0)) < crit)).alias("cointegrated"),
        F.when(ok, "tested").otherwise("insufficient_data").alias("status"),
    )


# -- roughness and variance ratio ------------------------------------------------------------
def _slope_on_log_lag(values: Sequence[Column]) -> Column:
    x = [math.log(k) for k in range(1, len(values) + 1)]
    m = sum(x) / len(x)
    sxx = sum((a - m) ** 2 for a in x)
    return add([F.lit((a - m) / sxx) * v for a, v in zip(x, values)])


def _rough_columns(hurst: Column) -> dict[str, Column]:
    return {
        "is_rough": hurst < 0.3,
        "edge_score": clamp((F.lit(0.5) - hurst) / 0.5, 0.0, 1.0),
        "vol_regime": pick([(hurst < 0.2, "rough"), (hurst < 0.35, "semi_rough")], "classical"),
        "size_adjustment": pick([(hurst < 0.2, 1.15), (hurst < 0.35, 1.05)], 1.0),
    }


def _log_corr(c: Column, c0: Column) -> Column:
    return F.log(F.greatest(F.lit(1e-10), F.coalesce(F.abs(ratio(c, F.when(c0 > 0, c0))), F.lit(1e-10))))


def hurst_from_vol(series: DataFrame, value: str = "vol", lags: int = 10, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exponent from the decay of the log-volatility autocorrelation, with regime and size factor."""
    s = series.withColumn("_lv", F.log(F.greatest(F.col(value), F.lit(1e-10))))
    s = _centered(s, "_lv", keys)
    w = by_time(*keys)
    for k in range(1, lags + 1):
        s = s.withColumn(f"_p{k}", F.col("_x") * F.lag("_x", k).over(w))
    g = s.groupBy(*keys, "_n", "_v").agg(*[F.avg(f"_p{k}").alias(f"_c{k}") for k in range(1, lags + 1)])
    slope = _slope_on_log_lag([_log_corr(F.col(f"_c{k}"), F.col("_v")) for k in range(1, lags + 1)])
    h = F.when(F.col("_n") < lags + 5, F.lit(0.5)).otherwise(clamp(slope / 2, 0.01, 0.5))
    g = g.withColumn("hurst", h)
    extra = _rough_columns(F.col("hurst"))
    return g.select(*keys, "hurst", *[v.alias(k) for k, v in extra.items()])


def variance_ratio(series: DataFrame, value: str = "log_return", q: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Variance of overlapping q-sums against q times the variance, robust z and +-5% verdict."""
    s = _centered(series.filter(F.col(value).isNotNull()), value, keys)
    w = by_time(*keys)
    s = s.withColumn("_i", F.row_number().over(w)).withColumn(
        "_q", F.when(F.col("_i") >= q, F.sum(value).over(w.rowsBetween(-(q - 1), 0)))
    )
    for k in range(1, q):
        s = s.withColumn(f"_s{k}", F.pow("_x", 2) * F.pow(F.lag("_x", k).over(w), 2))
    g = s.groupBy(*keys, "_n").agg(
        F.var_samp(value).alias("v1"), F.var_samp("_q").alias("vq"), *[F.sum(f"_s{k}").alias(f"_d{k}") for k in range(1, q)]
    )
    n = F.col("_n")
    ok = (n >= 2 * q) & (F.col("v1") > 0)
    v1 = F.when(ok, F.col("v1"))
    vr = F.coalesce(F.col("vq") / q / v1, F.lit(1.0))
    theta = add([F.lit((2.0 * (q - k) / q) ** 2) * F.col(f"_d{k}") / F.pow(v1 * v1 * n, 2) for k in range(1, q)])
    z = F.coalesce((vr - 1) / F.sqrt(F.greatest(theta, 1 / n) / n), F.lit(0.0))
    return g.select(
        *keys,
        vr.alias("variance_ratio"),
        z.alias("z_statistic"),
        pick([(vr > 1.05, "momentum"), (vr < 0.95, "mean_reversion")], "random_walk").alias("verdict"),
        F.least(F.lit(1.0), F.abs(vr - 1) / 0.5).alias("strength"),
        (F.abs(z) > 1.96).alias("significant"),
    )


def _squared_returns(bars: DataFrame) -> DataFrame:
    """One row per bar after the first: day index, return, realized variance of that day."""
    r = with_returns(bars).filter(F.col("log_return").isNotNull())
    return r.withColumn("rv", F.pow("log_return", 2)).withColumn("_d", F.row_number().over(by_time()) - 1)


def rough_vol_features(
    bars: DataFrame, warm_up: int = 60, q: int = 5, lags: int = 10, std_window: int = 60, k: float = 3.0, days: DataFrame | None = None
) -> DataFrame:
    """Exponent and variance ratio re-estimated every day on all earlier days.

    Refits become running sums: autocovariances under a moving mean are expanded into raw sums of
    products, so the cost is linear in the series. ``days`` (symbol, timestamp, rv, log_return) replaces
    the squared bar returns when realized variances come from intraday bars."""
    d = _squared_returns(bars) if days is None else days.withColumn("_d", F.row_number().over(by_time()) - 1)
    w = by_time()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    i = F.col("_d")
    d = d.withColumn("_x", F.log(F.greatest(F.sqrt(F.greatest("rv", F.lit(0.0))) * math.sqrt(252), F.lit(1e-10))))
    d = d.withColumn("_x", F.col("_x") + 10.0)  # shift towards zero mean; covariances do not change
    lagged = range(1, lags + 1)
    first = {f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in lagged}
    first["_cum"] = F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first["_rq"] = F.when(i >= q - 1, F.sum("log_return").over(w.rowsBetween(-(q - 1), 0)))
    d = d.withColumns(first)
    second = {f"_p{k}": F.sum(f"_p{k}").over(past) for k in lagged}
    second |= {f"_h{k}": F.sum(F.when(i < k, F.col("_x")).otherwise(0.0)).over(past) for k in lagged}  # x[0..k-1]
    second |= {f"_a{k}": F.lag("_cum", k + 1).over(w) for k in lagged}
    second |= {"_mean": F.avg("_x").over(past), "_var": F.var_pop("_x").over(past), "_all": F.sum("_x").over(past)}
    second |= {"_v1": F.var_samp("log_return").over(past), "_vq": F.var_samp("_rq").over(past)}
    d = d.withColumns(second)
    m = F.col("_mean")
    logs = []
    for lag in lagged:
        c = (F.col(f"_p{lag}") - m * (F.col(f"_a{lag}") + F.col("_all") - F.col(f"_h{lag}"))) / (i - lag) + m * m
        logs.append(_log_corr(F.when(i >= warm_up, c), F.col("_var")))
    ready = i >= warm_up
    d = d.withColumn("rough_hurst", F.when(ready, clamp(_slope_on_log_lag(logs) / 2, 0.01, 0.5)))
    vr = F.when(F.col("_v1") > 0, F.col("_vq") / q / F.when(F.col("_v1") > 0, F.col("_v1"))).otherwise(1.0)
    extra = _rough_columns(F.col("rough_hurst"))
    d = (
        d.withColumn("variance_ratio", F.when(ready, vr))
        .withColumn("rough_is_rough", F.when(ready, extra["is_rough"].cast("double")))
        .withColumn("rough_size_multiplier", F.when(ready, extra["size_adjustment"]))
        .withColumn("_edge", F.when(ready, extra["edge_score"]))
    )
    near = w.rowsBetween(-(std_window - 1), 0)
    sd = lambda c: F.coalesce(F.stddev_samp(c).over(near), F.lit(0.0))
    d = d.withColumns({"_es": sd("_edge"), "_em": F.avg("_edge").over(near), "_vs": sd("variance_ratio")})
    d = (
        d.withColumn("rough_scalping_score", safe_tanh(F.col("_edge") - F.col("_em"), F.lit(k) * F.col("_es")))
        .withColumn("vr_signal", safe_tanh(F.col("variance_ratio") - 1, F.lit(k) * F.col("_vs")))
    )
    return d.select(
        "symbol", "timestamp", "rough_hurst", "rough_is_rough", "rough_scalping_score", "rough_size_multiplier", "variance_ratio", "vr_signal"
    )


# -- heterogeneous autoregression -------------------------------------------------------------
def _har_columns(d: DataFrame) -> DataFrame:
    """Regressors of each day: previous value and the means whose windows end two days back."""
    w = by_time()
    i = F.col("_d")
    use = i >= 22
    return d.withColumns(
        {
            "_y": F.when(use, F.col("rv")),
            "_x1": F.when(use, F.lag("rv").over(w)),
            "_x2": F.when(use, F.avg("rv").over(w.rowsBetween(-6, -2))),
            "_x3": F.when(use, F.avg("rv").over(w.rowsBetween(-23, -2))),
        }
    )


_HAR = ("_x1", "_x2", "_x3", "_y")


def _har_moments(frame) -> dict[str, Column]:
    """Means and co-moments of the regression columns, over a frame or as an aggregate (None)."""
    on = (lambda e: e.over(frame)) if frame is not None else (lambda e: e)
    out = {f"_m{a}": on(F.avg(a)) for a in _HAR}
    for k, a in enumerate(_HAR):
        for b in _HAR[k:]:
            out[f"_c{a}{b}"] = on(F.covar_pop(a, b))
    return out


def _har_solve() -> tuple[Column, Column, Column, Column]:
    """(beta1, beta2, beta3, determinant) of the centred 3x3 normal equations by cofactors."""
    s = lambda a, b: F.col(f"_c_x{min(a, b)}_x{max(a, b)}")
    t = [F.col(f"_c_x{a}_y") for a in (1, 2, 3)]
    minor = lambda a, b, c, e: s(a, c) * s(b, e) - s(a, e) * s(b, c)
    # cofactor matrix of a symmetric 3x3 matrix
    m11, m12, m13 = minor(2, 3, 2, 3), minor(2, 3, 1, 3) * -1, minor(2, 3, 1, 2)
    m22, m23, m33 = minor(1, 3, 1, 3), minor(1, 3, 1, 2) * -1, minor(1, 2, 1, 2)
    det = s(1, 1) * m11 + s(1, 2) * m12 + s(1, 3) * m13
    good = F.abs(det) > F.lit(1e-13) * s(1, 1) * s(2, 2) * s(3, 3)
    safe = F.when(good, det)
    b1 = (m11 * t[0] + m12 * t[1] + m13 * t[2]) / safe
    b2 = (m12 * t[0] + m22 * t[1] + m23 * t[2]) / safe
    b3 = (m13 * t[0] + m23 * t[1] + m33 * t[2]) / safe
    return b1, b2, b3, safe


def har_features(
    bars: DataFrame, warm_up: int = 30, std_window: int = 60, k: float = 3.0, days: DataFrame | None = None
) -> DataFrame:
    """Realized-variance forecast of each day from all earlier days, its residual and scaled signal.

    The daily refit is an expanding frame of co-moments and a closed 3x3 solve. Where the system is
    singular the mean of the earlier values is used and ``har_singular`` is set."""
    d = _squared_returns(bars) if days is None else days.withColumn("_d", F.row_number().over(by_time()) - 1)
    d = _har_columns(d)
    w = by_time()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns(
        {
            **_har_moments(past),
            "_f1": F.lag("rv").over(w),
            "_f2": F.avg("rv").over(w.rowsBetween(-5, -1)),
            "_f3": F.avg("rv").over(w.rowsBetween(-22, -1)),
            "_mean": F.avg("rv").over(past),
        }
    )
    b1, b2, b3, det = _har_solve()
    d = d.withColumn("_b1", b1).withColumn("_b2", b2).withColumn("_b3", b3)
    fit = F.col("_m_y") + add([F.col(f"_b{j}") * (F.col(f"_f{j}") - F.col(f"_m_x{j}")) for j in (1, 2, 3)])
    ready = F.col("_d") >= warm_up
    d = d.withColumn("har_rv_forecast", F.when(ready, F.greatest(F.lit(0.0), F.coalesce(fit, F.col("_mean")))))
    d = d.withColumn("har_singular", ready & fit.isNull())
    d = d.withColumn("har_rv_residual", F.col("rv") - F.col("har_rv_forecast"))
    sd = F.coalesce(F.stddev_samp("har_rv_residual").over(w.rowsBetween(-(std_window - 1), 0)), F.lit(0.0))
    d = d.withColumn("_sd", sd)
    d = d.withColumn("har_rv_signal", safe_tanh(F.col("har_rv_residual"), F.lit(k) * F.col("_sd")))
    return d.select("symbol", "timestamp", "rv", "har_rv_forecast", "har_rv_residual", "har_rv_signal", "har_singular")


def har_fit(daily: DataFrame) -> DataFrame:
    """One fit per symbol on (symbol, timestamp, rv): coefficients, R2 and the next-day forecast."""
    d = _har_columns(daily.withColumn("_d", F.row_number().over(by_time()) - 1))
    back = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    d = d.withColumn("_k", F.row_number().over(back))
    g = d.groupBy("symbol").agg(
        *[e.alias(n) for n, e in _har_moments(None).items()],
        F.count(F.lit(1)).alias("n_obs"),
        F.avg("rv").alias("_mean"),
        F.max(F.when(F.col("_k") == 1, F.col("rv"))).alias("_f1"),
        F.avg(F.when(F.col("_k") <= 5, F.col("rv"))).alias("_f2"),
        F.avg(F.when(F.col("_k") <= 22, F.col("rv"))).alias("_f3"),
    )
    b1, b2, b3, _ = _har_solve()
    ok = F.col("n_obs") >= 25
    g = g.withColumn("_b1", F.when(ok, b1)).withColumn("_b2", F.when(ok, b2)).withColumn("_b3", F.when(ok, b3))
    fit = F.col("_m_y") + add([F.col(f"_b{j}") * (F.col(f"_f{j}") - F.col(f"_m_x{j}")) for j in (1, 2, 3)])
    explained = add([F.col(f"_b{j}") * F.col(f"_c_x{j}_y") for j in (1, 2, 3)])
    zero = F.lit(0.0)
    fc = F.greatest(zero, F.coalesce(fit, F.col("_mean")))
    return g.select(
        "symbol",
        "n_obs",
        fc.alias("forecast_rv"),
        F.sqrt(fc * 252.0).alias("forecast_vol"),
        F.coalesce("_b1", zero).alias("beta_daily"),
        F.coalesce("_b2", zero).alias("beta_weekly"),
        F.coalesce("_b3", zero).alias("beta_monthly"),
        F.coalesce(F.greatest(zero, ratio(explained, F.col("_c_y_y"))), zero).alias("r_squared"),
    )


def broadcast_days(bars: DataFrame, features: DataFrame, forecast: Sequence[str], realized: Sequence[str]) -> DataFrame:
    """Attach daily features to intraday bars: what was known before the day to every bar of it, what
    needs the whole day only to its last bar."""
    b = bars.withColumn("day", F.to_date("timestamp"))
    f = features.select("symbol", F.to_date("timestamp").alias("day"), *forecast, *realized)
    out = b.join(f, ["symbol", "day"], "left")
    nxt = F.lead("day").over(by_time())
    last = nxt.isNull() | (nxt != F.col("day"))
    out = out.withColumn("_last", last)
    for n in realized:
        out = out.withColumn(n, F.when(F.col("_last"), F.col(n)))
    return out.drop("_last", "day")


def intraday_days(bars: DataFrame) -> DataFrame:
    """Daily realized variance and return from intraday bars, for the ``days`` arguments above."""
    d = daily_realized(bars, across_zero=True)
    return d.select("symbol", F.col("day").cast("timestamp").alias("timestamp"), "rv", F.col("day_return").alias("log_return"))


# -- GARCH and fractional differencing --------------------------------------------------------
def garch(series: DataFrame, omega: float = 1e-4, alpha: float = 0.1, beta: float = 0.85, seed_var: str | None = None) -> DataFrame:
    """Conditional volatility after each return.

    By default the recursion starts from the population variance of the whole series, which looks
    ahead; ``seed_var`` names a column holding another starting variance."""
    from ..plans.ordered import Ordered
    from ..plans.recursion import decay

    s = series.filter(F.col("log_return").isNotNull())
    seed = F.col(seed_var) if seed_var else F.var_pop("log_return").over(Window.partitionBy("symbol"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    s = s.withColumn("_seed", seed if seed_var else F.when(n > 1, seed).otherwise(F.lit(omega)))
    spec = Ordered(order=("timestamp",), bucket_seconds=86_400 * 366)
    s = decay(spec.running(s), spec, beta, {"_g": F.lit(omega) + F.lit(alpha) * F.pow("log_return", 2)})
    var = F.col("_g") + F.col("_seed") * F.pow(F.lit(beta), F.col("_i") + 1)
    return s.withColumn("garch_vol", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("_g", "_seed", "_i")


def frac_weights(d: float, threshold: float = 1e-5, max_width: int | None = None) -> list[float]:
    """Binomial weights of (1-L)^d, cut where they fall below the threshold."""
    out, w, k = [1.0], 1.0, 1
    while max_width is None or k < max_width:
        w *= (k - 1.0 - d) / k
        if abs(w) < threshold:
            break
        out.append(w)
        k += 1
    return out


def memory_retained(d: float, n_lags: int) -> float:
    """Share of the absolute weight of order ``d`` in its first ``n_lags`` weights, against 10 000 weights or all above 1e-8."""
    total = sum(map(abs, frac_weights(d, 1e-8, 10_000)))
    return sum(map(abs, frac_weights(d)[:n_lags])) / total if total > 0 else 0.0


def _convolved(x: np.ndarray, w: np.ndarray, spectrum: dict) -> np.ndarray:
    """Weighted sums of the last ``len(w)`` values at every place (short windows at the start are not whole)."""
    if len(w) <= 64:
        return np.convolve(x, w)[: len(x)]
    size = 1 << (len(x) + len(w) - 1).bit_length()
    if size not in spectrum:  # one transform of the rows serves all orders
        spectrum[size] = np.fft.rfft(x, size)
    return np.fft.irfft(spectrum[size] * np.fft.rfft(w, size), size)[: len(x)]


def _whole_windows(x: np.ndarray, n: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``n`` values up to them (``before``: index of the first in its series), and those without a null there."""
    missing = np.concatenate([[0], np.cumsum(np.isnan(x))])
    at = np.arange(len(x))
    start = np.maximum(at - n + 1, 0)
    return before + at >= n - 1, missing[at + 1] == missing[start]


def _series(keys: Sequence[str], order: Sequence[str], n: int):
    from ..plans.ordered import Ordered

    return Ordered(keys=tuple(keys), order=tuple(order), time=order[0], bucket_seconds=86_400 * 366, chunk_rows=max(16_384, 1 << (2 * n).bit_length()))


def frac_diff(series: DataFrame, d: float, value: str, out: str = "frac_diff", threshold: float = 1e-5, max_width: int | None = None, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Fixed-width fractional difference; rows without a full window are dropped, those with a null in it are null.

    Block convolution: a series is cut into chunks of rows, each with the rows that the weights reach back to (overlap and
    save), and a chunk is convolved by a fast transform, so neither a long series nor a wide window makes a row expensive."""
    weights = np.array(frac_weights(d, threshold, max_width))
    n, spec = len(weights), _series(keys, order, len(weights))
    chunks = spec.chunks(series, halo=n - 1)
    names = [*series.columns, out]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        x = pd.to_numeric(rows[value]).to_numpy(float)
        full, known = _whole_windows(x, n, int(rows["_i"].iat[0]))
        y = _convolved(np.nan_to_num(x), weights, {})
        rows[out] = np.where(known, y, np.nan)
        return rows.loc[full & ~rows["_h"].to_numpy(bool), names]

    schema = T.StructType([*series.schema.fields, T.StructField(out, T.DoubleType())])
    found = chunks.groupBy(*keys, "_c").applyInPandas(run, schema)
    return found.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def stationarity(series: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Unit-root check: slope of the change on the demeaned lag, stationary when t < -2.86."""
    w = by_time(*keys)
    s = series.withColumn("_x", F.lag(value).over(w)).filter(F.col("_x").isNotNull()).withColumn("_y", F.col(value) - F.col("_x"))
    g = s.groupBy(*keys).agg(
        F.covar_pop("_x", "_y").alias("cxy"),
        F.var_pop("_x").alias("vx"),
        F.var_pop("_y").alias("vy"),
        F.count(F.lit(1)).alias("m"),
    )
    m = F.col("m")
    sxx = m * F.col("vx")
    beta = F.col("cxy") / F.when(F.col("vx") > 0, F.col("vx"))
    # residuals keep the mean of y; their variance around that mean has m - 2 degrees of freedom
    sse = m * F.greatest(F.lit(0.0), F.col("vy") - beta * F.col("cxy"))
    se = F.sqrt(F.greatest(F.lit(1e-12), sse / F.when(m > 2, m - 2) / F.when(sxx > 0, sxx)))
    t = beta / se
    ok = (m + 1 >= 20) & (sxx >= 1e-10)
    return g.select(*keys, F.when(ok, t).alias("t_stat"), F.coalesce(ok & (t < -2.86), F.lit(False)).alias("stationary"))


def minimum_d(series: DataFrame, value: str, steps: int = 20, low: float = 0.0, high: float = 1.0, threshold: float = 1e-5, max_width: int | None = None, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Smallest order on a grid whose differenced series is stationary (``high`` if none), with the number of weights, the share
    of memory retained (percent) and the test statistic of that order.

    All orders are convolved from one pass over the row chunks; a chunk gives the centred moments of level and change for each
    order, and these are merged, so no row is repeated for an order."""
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    weights = [np.array(frac_weights(d, threshold, max_width)) for d in grid]
    widest = max(map(len, weights))
    spec = _series(keys, order, widest)
    chunks = spec.chunks(series.select(*keys, *order, value), halo=widest)
    schema = T.StructType([series.schema[k] for k in keys] + [T.StructField(c, T.LongType() if c in ("step", "m") else T.DoubleType()) for c in ("step", "m", "mx", "my", "cxx", "cxy", "cyy")])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        x = pd.to_numeric(rows[value]).to_numpy(float)
        own, first, spectrum, out = ~rows["_h"].to_numpy(bool), int(rows["_i"].iat[0]), {}, []
        for step, w in enumerate(weights):
            full, known = _whole_windows(x, len(w), first)
            ok = full & known
            y = _convolved(np.nan_to_num(x), w, spectrum)
            pair = np.flatnonzero(ok[1:] & ok[:-1] & own[1:])
            if first and len(w) == widest:
                pair = pair[pair >= len(w) - 1]
            level, change = y[pair], y[pair + 1] - y[pair]
            if len(pair):
                a, b = level.mean(), change.mean()
                out.append((*(rows[k].iat[0] for k in keys), step, len(pair), a, b, ((level - a) ** 2).sum(), ((level - a) * (change - b)).sum(), ((change - b) ** 2).sum()))
        return pd.DataFrame(out, columns=schema.names)

    c = F.col
    part = chunks.groupBy(*keys, "_c").applyInPandas(run, schema)
    g = part.groupBy(*keys, "step").agg(
        F.sum("m").alias("m"), F.sum(c("m") * c("mx")).alias("sx"), F.sum(c("m") * c("my")).alias("sy"),
        *[(F.sum(f"c{a}{b}") + F.sum(c("m") * c(f"m{a}") * c(f"m{b}")) - F.sum(c("m") * c(f"m{a}")) * F.sum(c("m") * c(f"m{b}")) / F.sum("m")).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")],
    )
    slope = c("sxy") / F.when(c("sxx") > 0, c("sxx"))
    se = F.sqrt(F.greatest(F.lit(1e-12), F.greatest(F.lit(0.0), c("syy") - slope * c("sxy")) / F.when(c("m") > 2, c("m") - 2) / F.when(c("sxx") > 0, c("sxx"))))
    tested = g.select(*keys, "step", F.when((c("m") + 1 >= 20) & (c("sxx") >= 1e-10), slope / se).alias("t_stat"))
    passed = tested.where(c("t_stat") < -2.86).groupBy(*keys).agg(F.min("step").alias("step"))
    chosen = series.select(*keys).distinct().join(passed, list(keys), "left").withColumn("stationary", c("step").isNotNull()).withColumn("step", F.coalesce("step", F.lit(steps - 1).cast("long")))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (c("step") + 1).cast("int"))
    lags = [len(w) for w in weights]
    record = chosen.join(tested, [*keys, "step"], "left")
    kept = [100 * memory_retained(d, n) for d, n in zip(grid, lags)]
    return record.select(*keys, at(grid).alias("d"), at(lags).cast("long").alias("n_lags"), at(kept).alias("memory_retained"), "t_stat", "stationary")


# -- option gamma exposure ---------------------------------------------------------------------
def gex_snapshots(chain: DataFrame, keys: Sequence[str] = (), multiplier: float = 100.0) -> DataFrame:
    """Dealer gamma exposure per timestamp (calls negative), with a check of the spot price."""
    kind = F.lower(F.trim("option_type"))
    sign = F.when(kind == "call", -1.0).when(kind == "put", 1.0)
    v = sign * F.col("open_interest") * F.col("gamma") * F.pow("spot_price", 2) * multiplier
    return (
        chain.groupBy(*keys, "timestamp")
        .agg(
            F.sum(v).alias("gex_raw"),
            F.max("spot_price").alias("spot"),
            (F.max("spot_price") == F.min("spot_price")).alias("spot_consistent"),
            F.count_if(sign.isNull()).alias("n_invalid_type"),
        )
        .withColumn("gex_normalized", ratio(F.col("gex_raw"), F.col("spot")))
    )


def gex_features(snapshots: DataFrame, keys: Sequence[str] = ("symbol",), lookback: int = 252, k: float = 3.0) -> DataFrame:
    """z-score against strictly earlier snapshots, regime at +-1 and scaled signal."""
    w = by_time(*keys).rowsBetween(-lookback, -1)
    d = (
        snapshots.withColumn("_m", F.avg("gex_raw").over(w))
        .withColumn("_sd", F.stddev_samp("gex_raw").over(w))
        .withColumn("_n", F.count("gex_raw").over(w))
    )
    z = F.when(F.col("_sd") < 1e-15, 0.0).otherwise((F.col("gex_raw") - F.col("_m")) / F.when(F.col("_sd") >= 1e-15, F.col("_sd")))
    d = d.withColumn("gex_zscore", F.when(F.col("_n") >= 2, z))
    zc = F.col("gex_zscore")
    regime = F.when(zc < -1, -1.0).when(zc > 1, 1.0).when(zc.isNotNull(), 0.0)
    return d.withColumn("gex_regime", regime).withColumn("gex_signal", F.tanh(zc / k)).drop("_m", "_sd", "_n")


def gex_by_strike(chain: DataFrame, keys: Sequence[str] = (), top: int = 10) -> DataFrame:
    """Net gamma per strike (puts negative, no spot factor) and the strikes with the largest absolute value."""
    sign = F.when(F.lower(F.trim("option_type")) == "put", -1.0).otherwise(1.0)
    g = chain.groupBy(*keys, "strike").agg(F.sum(sign * F.col("gamma") * F.col("open_interest") * 100.0).alias("gex"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.abs("gex").desc(), "strike")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
