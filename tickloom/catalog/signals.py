"""Session tags, regimes and rule models."""

from pyspark.sql import functions as F

from ..functions import sessions as N
from ..functions.columns import quotient
from ..operators import scoring as S
from ..operators import technical as X
from ..operators import orderflow as O
from ..plans.asof import asof_join
from ..sources import views as V
from . import query, r, rounded, rs

_T = V.with_views("ticks")
_M = "hour(timestamp) * 60 + minute(timestamp)"


@query(
    "session_tags",
    _T + f""", m AS (SELECT symbol, seq, timestamp, {_M} AS m, isodow(timestamp) >= 6 AS we, (m - 300 + 1440) % 1440 AS ny FROM ticks)
    SELECT symbol, seq, CASE WHEN we THEN 'weekend' WHEN (m >= 870 AND m < 930) OR (m >= 1200 AND m < 1260) THEN 'us_prime' WHEN m >= 870 AND m < 1260 THEN 'us_normal' WHEN m >= 480 AND m < 600 THEN 'london' WHEN m < 120 THEN 'asian' ELSE 'after_hours' END AS session_utc,
    CASE WHEN we THEN 'weekend' WHEN ny >= 570 AND ny < 630 THEN 'us_open' WHEN ny >= 630 AND ny < 720 THEN 'us_morning' WHEN ny >= 720 AND ny < 810 THEN 'us_lunch' WHEN ny >= 810 AND ny < 900 THEN 'us_afternoon' WHEN ny >= 900 AND ny < 960 THEN 'us_close' WHEN m < 480 THEN 'asian' WHEN m < 810 THEN 'london' ELSE 'after_hours' END AS session_ny,
    CASE WHEN we THEN 0.4e0 WHEN ny >= 570 AND ny < 630 THEN 1.3e0 WHEN ny >= 630 AND ny < 720 THEN 1.0e0 WHEN ny >= 720 AND ny < 810 THEN 0.6e0 WHEN ny >= 810 AND ny < 900 THEN 1.1e0 WHEN ny >= 900 AND ny < 960 THEN 1.2e0 WHEN m < 480 THEN 0.7e0 WHEN m < 810 THEN 0.9e0 ELSE 0.5e0 END AS multiplier,
    NOT we AND ((ny >= 570 AND ny < 630) OR (ny >= 900 AND ny < 960)) AS is_prime,
    CASE WHEN (m >= 870 AND m < 930) OR (m >= 1200 AND m < 1260) THEN 1.2e0 WHEN m >= 480 AND m < 600 THEN 1.1e0 WHEN m < 120 THEN 0.7e0 ELSE 1.0e0 END AS bonus FROM m""",
)
def session_tags(spark, d):
    ts = F.col("timestamp")
    t = V.ticks(spark, d).withColumn("session_utc", N.utc_session(ts)).withColumn("session_ny", N.exchange_session(ts))
    return t.select(
        "symbol", "seq", "session_utc", "session_ny", N.session_multiplier(F.col("session_ny")).alias("multiplier"), N.prime(F.col("session_ny")).alias("is_prime"), N.session_bonus(ts).alias("bonus")
    )


@query(
    "asset_class_inference",
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'ethusdt' WHEN 'view' THEN 'XRPBTC' WHEN 'error' THEN 'BTCX' WHEN 'signup' THEN 'SOLETH' ELSE 'AAPL' END AS s, CASE WHEN user_id % 4 = 0 THEN 'forex' WHEN user_id % 4 = 1 THEN '' END AS e FROM events)
    SELECT event_id, CASE WHEN e <> '' THEN e WHEN regexp_matches(upper(s), '(USDT|BTC|ETH|BNB)$') THEN 'crypto' ELSE 'equity' END AS asset_class FROM x""",
)
def asset_class_inference(spark, d):
    e = V.table(spark, d, "events")
    t = F.col("event_type")
    s = F.when(t == "click", "ethusdt").when(t == "view", "XRPBTC").when(t == "error", "BTCX").when(t == "signup", "SOLETH").otherwise("AAPL")
    x = F.when(F.col("user_id") % 4 == 0, "forex").when(F.col("user_id") % 4 == 1, "")
    return e.select("event_id", N.asset_class(s, x).alias("asset_class"))


@query(
    "cyclical_time",
    _T + f" SELECT symbol, seq, {r('sin(hour(timestamp) * 2 * pi() / 24)', name='hour_sin')}, {r('cos(hour(timestamp) * 2 * pi() / 24)', name='hour_cos')}, {r('sin((isodow(timestamp) - 1) * 2 * pi() / 7)', name='dow_sin')}, {r('cos((isodow(timestamp) - 1) * 2 * pi() / 7)', name='dow_cos')} FROM ticks",
)
def cyclical_time(spark, d):
    c = N.cyclical(F.col("timestamp"))
    return rounded(V.ticks(spark, d).select("symbol", "seq", *[v.alias(k) for k, v in c.items()]))


_MAC = """SELECT event_id, value % 45 AS vix, (user_id % 13) / 10.0e0 - 0.5e0 AS dollar_change, (event_id % 50) / 10.0e0 AS yield_10y, (event_id % 37) / 8.0e0 AS yield_2y, (user_id % 9 - 4) / 100.0e0 AS funding_rate FROM events"""


def _macro(spark, d):
    e = V.table(spark, d, "events")
    c = F.col
    return e.select(
        "event_id", (c("value") % 45).alias("vix"), ((c("user_id") % 13) / 10.0 - 0.5).alias("dollar_change"), ((c("event_id") % 50) / 10.0).alias("yield_10y"),
        ((c("event_id") % 37) / 8.0).alias("yield_2y"), ((c("user_id") % 9 - 4) / 100.0).alias("funding_rate"),
    )


@query(
    "macro_regime",
    f"""WITH m AS ({_MAC}), v AS (SELECT *, CASE WHEN vix >= 35 THEN 'crisis' WHEN vix >= 25 THEN 'high' WHEN vix >= 15 THEN 'normal' ELSE 'low' END AS vol_regime, yield_2y > yield_10y AS inv FROM m)
    SELECT event_id, vol_regime, {r("CASE vol_regime WHEN 'crisis' THEN 0 WHEN 'high' THEN 0.3e0 WHEN 'normal' THEN 1 ELSE 1.2e0 END * CASE WHEN dollar_change > 0.5 THEN 0.7e0 ELSE 1 END * CASE WHEN inv THEN 0.8e0 ELSE 1 END * CASE WHEN abs(funding_rate) > 0.03 THEN 0.9e0 ELSE 1 END", 3, 'macro_mult')},
    CASE WHEN dollar_change > 0.3 OR inv OR vol_regime IN ('crisis','high') THEN 'reduced' ELSE 'normal' END AS risk_mode, inv AS yield_curve_inverted,
    {r("greatest(0, least(1, CASE WHEN vix > 30 THEN 0.6e0 WHEN vix > 20 THEN 0.8e0 ELSE 1 END * CASE WHEN yield_10y - yield_2y < 0 THEN 0.9e0 ELSE 1 END))", name='alt_mult')},
    CASE WHEN vol_regime = 'crisis' THEN 'crisis' WHEN event_id % 7 = 0 THEN 'reduced' WHEN event_id % 11 = 0 THEN 'blocked' WHEN vol_regime = 'high' THEN 'reduced' ELSE 'normal' END AS mode FROM v""",
)
def macro_regime(spark, d):
    m = S.macro_state(_macro(spark, d))
    m = m.withColumn("alt_mult", S.macro_multiplier(F.col("vix"), F.col("yield_10y") - F.col("yield_2y")))
    m = m.withColumn("mode", S.risk_mode(F.col("vol_regime"), F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0))
    return rounded(m.select("event_id", "vol_regime", "macro_mult", "risk_mode", "yield_curve_inverted", "alt_mult", "mode"))


_COMP = """SELECT event_id, value AS price, (user_id % 21 - 10) / 15.0e0 AS ofi, value * (1 + (event_id % 9) / 100.0e0) AS bb_upper, value * (1 - (event_id % 11) / 100.0e0) AS bb_lower,
    (event_id % 17) + 0.0e0 AS ema_fast_1m, (event_id % 13) + 0.0e0 AS ema_slow_1m, CASE WHEN event_id % 19 <> 0 THEN (event_id % 23) + 0.0e0 END AS ema_fast_15m, (event_id % 7) + 0.0e0 AS ema_slow_15m,
    value * (1 + (user_id % 15 - 7) / 100.0e0) AS vwap, CASE WHEN event_id % 5 = 0 THEN 'bullish' WHEN event_id % 5 = 1 THEN 'bearish' END AS rsi_divergence, CASE WHEN event_id % 3 > 0 THEN value * (event_id % 5) / 50.0e0 END AS atr FROM events"""


def _components(spark, d):
    c = F.col
    e = V.table(spark, d, "events")
    return e.select(
        "event_id", c("value").alias("price"), ((c("user_id") % 21 - 10) / 15.0).alias("ofi"), (c("value") * (1 + (c("event_id") % 9) / 100.0)).alias("bb_upper"), (c("value") * (1 - (c("event_id") % 11) / 100.0)).alias("bb_lower"),
        (c("event_id") % 17).cast("double").alias("ema_fast_1m"), (c("event_id") % 13).cast("double").alias("ema_slow_1m"), F.when(c("event_id") % 19 != 0, (c("event_id") % 23).cast("double")).alias("ema_fast_15m"), (c("event_id") % 7).cast("double").alias("ema_slow_15m"),
        (c("value") * (1 + (c("user_id") % 15 - 7) / 100.0)).alias("vwap"), F.when(c("event_id") % 5 == 0, "bullish").when(c("event_id") % 5 == 1, "bearish").alias("rsi_divergence"), F.when(c("event_id") % 3 > 0, c("value") * (c("event_id") % 5) / 50.0).alias("atr"),
    )


_W = {"microstructure": 0.35, "bollinger": 0.25, "ema_mtf": 0.2, "rsi_divergence": 0.15, "vwap": 0.05}
_SC = {"microstructure": "s1", "bollinger": "s2", "ema_mtf": "s3", "rsi_divergence": "s4", "vwap": "s5"}
_LIM = {"bollinger": 0.15, "ema_mtf": 0.1, "rsi_divergence": 0.0, "vwap": 0.002}
_ON = {"microstructure": "abs(ofi) > 0.3", **{k: f"abs({_SC[k]}) > {v}" for k, v in _LIM.items()}}
_SCORES = f"""WITH m AS ({_COMP}), a AS (SELECT *, (price - bb_lower) / CASE WHEN bb_upper > bb_lower THEN bb_upper - bb_lower END AS pos,
      (ema_fast_1m > ema_slow_1m)::INT + (ema_fast_15m > ema_slow_15m)::INT + (price > vwap)::INT AS up FROM m),
    s AS (SELECT *, CASE WHEN ofi = 0 THEN 0.0e0 ELSE greatest(-1.0e0, least(1.0e0, ofi / greatest(abs(ofi), 1e-6))) END AS s1,
      CASE WHEN pos IS NULL THEN 0.0e0 WHEN pos <= 0 THEN 1.0e0 WHEN pos >= 1 THEN -1.0e0 WHEN pos < 0.2 THEN 0.5e0 WHEN pos > 0.8 THEN -0.5e0 ELSE 0.0e0 END AS s2,
      CASE WHEN ema_fast_15m IS NULL THEN 0.0e0 WHEN up = 3 THEN 1.0e0 WHEN up = 2 THEN 0.5e0 WHEN up = 1 THEN -0.5e0 ELSE -1.0e0 END AS s3,
      CASE rsi_divergence WHEN 'bullish' THEN 1.0e0 WHEN 'bearish' THEN -1.0e0 ELSE 0.0e0 END AS s4,
      greatest(-1.0e0, least(1.0e0, (price - vwap) / vwap * -20.0e0)) AS s5 FROM a),
    w AS (SELECT *, {' + '.join(f'({_ON[k]})::INT' for k in _W)} AS n_on, {' + '.join(f'CASE WHEN {_ON[k]} THEN {v}e0 ELSE 0 END' for k, v in _W.items())} AS tw,
      {' + '.join(f'CASE WHEN {_ON[k]} THEN {v}e0 * {_SC[k]} ELSE 0 END' for k, v in _W.items())} AS mx,
      {' + '.join(f'({_ON[k]} AND {_SC[k]} > 0.05)::INT' for k in _W)} AS np, {' + '.join(f'({_ON[k]} AND {_SC[k]} < -0.05)::INT' for k in _W)} AS nn FROM s),
    f AS (SELECT *, CASE WHEN tw > 0 THEN mx / tw ELSE 0 END * CASE WHEN np > 0 AND nn > 0 THEN 0.5e0 ELSE 1 END AS raw FROM w),
    g AS (SELECT *, CASE WHEN n_on >= 2 AND abs(raw) >= 0.2 THEN greatest(-1, least(1, raw)) ELSE 0.0e0 END AS strength FROM f)"""


@query(
    "component_scores",
    _SCORES + f" SELECT event_id, {r('s1', name='score_microstructure')}, {r('s2', name='score_bollinger')}, {r('s3', name='score_ema_mtf')}, {r('s4', name='score_rsi_divergence')}, {r('s5', name='score_vwap')}, {', '.join(f'{_ON[k]} AS on_{k}' for k in _W)} FROM g",
)
def component_scores(spark, d):
    t = S.component_scores(_components(spark, d))
    return rounded(t.select("event_id", *[f"score_{k}" for k in _W], *[f"on_{k}" for k in _W]))


@query(
    "confluence_signal",
    _SCORES + f""", h AS (SELECT *, CASE WHEN strength > 0 THEN 1 WHEN strength < 0 THEN -1 END AS sg, CASE WHEN atr > 0 THEN atr ELSE price * 0.002e0 END AS a FROM g)
    SELECT event_id, {r('strength', 5)}, CASE WHEN sg IS NULL THEN 0 ELSE n_on END AS n_triggers, CASE sg WHEN 1 THEN 'long' WHEN -1 THEN 'short' END AS direction, {r('CASE WHEN sg IS NOT NULL THEN least(1, abs(strength) + n_on / 4.0e0 * 0.3e0) END', 5, 'confidence')},
    {r('CASE WHEN price - sg * 1.5e0 * a <= 0 THEN price * 0.001e0 ELSE price - sg * 1.5e0 * a END', 5, 'stop_loss')}, {r('price + sg * 2 * a', 5, 'target_1')}, {r('price + sg * 3 * a', 5, 'target_2')} FROM h""",
)
def confluence_signal(spark, d):
    t = S.price_levels(S.confluence(S.component_scores(_components(spark, d))))
    return rounded(t.select("event_id", "strength", F.size("triggers").alias("n_triggers"), "direction", "confidence", "stop_loss", "target_1", "target_2"), 5)


_TREND = "CASE WHEN event_id % 3 = 0 THEN 'trending_up' WHEN event_id % 3 = 1 THEN 'ranging' ELSE 'trending_down' END"


@query(
    "fusion_and_sizing",
    f"""WITH m AS ({_MAC}), x AS (SELECT m.*, value, user_id, {_TREND} AS trend, CASE WHEN vix >= 35 THEN 'crisis' WHEN vix >= 25 THEN 'high' WHEN vix >= 15 THEN 'normal' ELSE 'low' END AS vol,
      CASE WHEN m.event_id % 29 = 0 THEN 'crisis' WHEN m.event_id % 31 = 0 THEN 'blocked' ELSE 'normal' END AS mode, (m.event_id % 101) / 100.0e0 AS wr, (user_id % 40) / 10.0e0 AS rr, user_id % 5 AS nt, (m.event_id % 21 - 10) / 10.0e0 AS st, CASE WHEN m.event_id % 6 > 0 THEN (m.event_id % 6) / 5.0e0 END AS al FROM m JOIN events USING (event_id)),
    y AS (SELECT *, CASE WHEN mode = 'crisis' THEN 'blocked' WHEN trend LIKE 'trending%' THEN 'momentum_scalp' ELSE 'mean_reversion' END AS strategy,
      least(0.25e0, greatest(0, (wr * greatest(rr, 0.01e0) - (1 - wr)) / greatest(rr, 0.01e0)) / 4) AS kelly FROM x)
    SELECT event_id, {r('least(2, abs(st) * 0.8e0 * CASE WHEN nt >= 3 THEN 1.35e0 WHEN nt = 2 THEN 1 WHEN nt = 1 THEN 0.5e0 ELSE 0 END * 1.1e0 * coalesce(al, 0.7e0) * CASE WHEN event_id % 2 = 0 THEN 1.1e0 ELSE 1 END)', name='score')}, strategy,
    mode = 'normal' AND CASE strategy WHEN 'momentum_scalp' THEN vol = 'normal' AND trend LIKE 'trending%' WHEN 'mean_reversion' THEN vol IN ('low','normal') AND trend = 'ranging' ELSE false END AS active,
    CASE WHEN mode = 'crisis' THEN 0.0e0 WHEN strategy = 'momentum_scalp' THEN 1.0e0 WHEN strategy = 'mean_reversion' THEN 0.8e0 ELSE 0.0e0 END AS size_multiplier, {r('kelly')},
    {r('least(10000, 100000 * kelly * 0.9e0 * 1.2e0 * greatest(0.1e0, least(1, 1 - funding_rate * 100)) * CASE WHEN event_id % 2 = 0 THEN 0.7e0 ELSE 1 END)', 3, 'size')}, {r('CASE WHEN vix = 0 THEN least(kelly, 0.25e0) ELSE greatest(0, least(kelly * 0.15e0 / (vix / 100), 0.25e0)) END', name='kelly_vol')} FROM y""",
)
def fusion_and_sizing(spark, d):
    c = F.col
    e = V.table(spark, d, "events").select("event_id", "user_id")
    i = c("event_id")
    x = _macro(spark, d).join(e, "event_id")
    trend = F.when(i % 3 == 0, "trending_up").when(i % 3 == 1, "ranging").otherwise("trending_down")
    mode = F.when(i % 29 == 0, "crisis").when(i % 31 == 0, "blocked").otherwise("normal")
    vol = S.volatility_regime(c("vix"))
    k = S.kelly_fraction((i % 101) / 100.0, (c("user_id") % 40) / 10.0)
    x = x.withColumn("kelly", k).withColumn("strategy", S.pick_strategy(trend, vol, mode))
    return rounded(
        rounded(x.select(
            "event_id",
            S.fusion_score((i % 21 - 10) / 10.0, c("user_id") % 5, F.lit(0.8), F.lit(1.1), F.when(i % 6 > 0, (i % 6) / 5.0), i % 2 == 0).alias("score"),
            "strategy",
            S.strategy_active(c("strategy"), trend, vol, mode).alias("active"),
            S.strategy_multiplier(c("strategy"), mode).alias("size_multiplier"),
            "kelly",
            F.round(S.position_size(F.lit(100_000.0), c("kelly"), F.lit(0.9), F.lit(1.2), c("funding_rate"), i % 2 == 0) + 1.7e-7, 3).alias("size"),
            S.vol_adjusted_kelly(c("kelly"), c("vix") / 100).alias("kelly_vol"),
        ), keep=("size",))
    , None)


_META = """SELECT event_id, (event_id % 11) / 10.0e0 AS signal_strength, user_id % 6 AS n_triggers, (event_id % 51) / 100.0e0 AS hurst, (user_id % 100) / 100.0e0 AS vpin, value / 800.0e0 AS forecast_vol, (event_id % 60) + 0.5e0 AS spread_bps, (user_id % 10 + 4) / 10.0e0 AS session_mult, (event_id % 13) / 10.0e0 AS macro_mult FROM events"""


@query(
    "meta_score",
    f"""WITH m AS ({_META}), v AS (SELECT *, CASE WHEN vpin >= 0.9 THEN 'vpin_extreme' WHEN macro_mult <= 0 THEN 'crisis_regime' WHEN spread_bps > 50 THEN 'spread_too_wide' END AS veto,
      greatest(-1, least(1, 0.25e0 * (signal_strength * 2 - 0.5e0) + 0.2e0 * CASE WHEN n_triggers >= 4 THEN 1.0e0 WHEN n_triggers = 3 THEN 0.8e0 WHEN n_triggers = 2 THEN 0.5e0 ELSE -0.5e0 END + 0.15e0 * greatest(-1, least(1, 1 - hurst / 0.5e0 * 2)) + 0.2e0 * (1 - vpin * 2)
        + 0.1e0 * CASE WHEN forecast_vol BETWEEN 0.1 AND 0.3 THEN 1.0e0 WHEN forecast_vol BETWEEN 0.05 AND 0.5 THEN 0.0e0 ELSE -1.0e0 END + 0.05e0 * CASE WHEN spread_bps <= 5 THEN 1.0e0 ELSE greatest(-1.0e0, 1 - (spread_bps - 5) / 15) END + 0.05e0 * (least(1, session_mult / 1.5e0 * macro_mult) * 2 - 1))) AS s FROM m)
    SELECT event_id, {r('CASE WHEN veto IS NULL THEN s ELSE -1 END', name='meta_score')}, {r('CASE WHEN veto IS NULL THEN (s + 1) / 2 ELSE 0 END', name='confidence')},
    {r('CASE WHEN veto IS NULL THEN least(1, (s + 1) / 2 * greatest(0.1e0, 1 - vpin) * greatest(0.5e0, 1 - spread_bps / 100) * macro_mult) ELSE 0 END', name='size_mult')}, veto IS NULL AND s >= 0.15 AS should_trade, coalesce(veto, CASE WHEN s < 0.15 THEN 'score_below_threshold' END) AS blocking_reason FROM v""",
)
def meta_score(spark, d):
    c = F.col
    i, u = c("event_id"), c("user_id")
    e = V.table(spark, d, "events").select(
        "event_id", ((i % 11) / 10.0).alias("signal_strength"), (u % 6).alias("n_triggers"), ((i % 51) / 100.0).alias("hurst"), ((u % 100) / 100.0).alias("vpin"), (c("value") / 800.0).alias("forecast_vol"),
        ((i % 60) + 0.5).alias("spread_bps"), ((u % 10 + 4) / 10.0).alias("session_mult"), ((i % 13) / 10.0).alias("macro_mult"),
    )
    return rounded(S.meta_score(e).select("event_id", "meta_score", "confidence", "size_mult", "should_trade", "blocking_reason"))


@query(
    "hedge_decisions",
    f"""WITH m AS ({_COMP}), x AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS dir, event_id % 101 AS rsi FROM m),
    y AS (SELECT *, ((dir = 'long' AND rsi > 70) OR (dir = 'short' AND rsi < 30))::INT + ((dir = 'long' AND price >= bb_upper) OR (dir = 'short' AND price <= bb_lower))::INT + (abs(ofi) < 0.1)::INT + (event_id % 41 = 0)::INT AS n FROM x)
    SELECT event_id, n AS n_reasons, n > 0 AS hedge, CASE WHEN n > 0 THEN CASE dir WHEN 'long' THEN 'short' ELSE 'long' END END AS hedge_direction, {r('CASE WHEN n > 0 THEN price * 0.3e0 END', name='hedge_size')} FROM y""",
)
def hedge_decisions(spark, d):
    x = _components(spark, d).withColumn("direction", F.when(F.col("event_id") % 2 == 0, "long").otherwise("short"))
    x = x.withColumn("rsi", (F.col("event_id") % 101).cast("double")).withColumn("event_active", F.col("event_id") % 41 == 0).withColumn("reference_size", F.col("price"))
    h = S.hedge(x)
    return rounded(h.select("event_id", F.size("hedge_reasons").alias("n_reasons"), "hedge", "hedge_direction", "hedge_size"))


@query(
    "surprise_multiplier",
    V.with_views("economic_events") + f""", x AS (SELECT event_id, CASE WHEN consensus = 0 THEN 0 ELSE (actual - consensus) / abs(consensus) END AS s, CASE impact_score WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS imp, (event_id % 30) + 0.0e0 AS h FROM economic_events)
    SELECT event_id, {r('s', name='surprise')}, {r("CASE WHEN h >= 24 THEN 1 ELSE 1 + s * CASE imp WHEN 'high' THEN 0.3e0 WHEN 'medium' THEN 0.15e0 ELSE 0.05e0 END * greatest(0, least(1, 1 - (h - 2) / 22)) END", name='multiplier')} FROM x""",
)
def surprise_multiplier(spark, d):
    e = V.economic_events(spark, d).withColumn("surprise", S.surprise(F.col("actual"), F.col("consensus")))
    imp = F.when(F.col("impact_score") == 3, "high").when(F.col("impact_score") == 2, "medium").otherwise("low")
    return rounded(e.select("event_id", "surprise", S.surprise_multiplier(F.col("surprise"), imp, (F.col("event_id") % 30).cast("double")).alias("multiplier")))


_DAYRET = """, dr AS (SELECT symbol, timestamp, close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS ret FROM bars_1h)"""


@query(
    "risk_appetite",
    V.with_views("bars_1h") + _DAYRET + f""", g AS (SELECT timestamp, avg(ret) FILTER (symbol IN ('S0','S1','S2')) AS gr, avg(ret) FILTER (symbol IN ('S3','S4','S5')) AS df FROM dr GROUP BY 1)
    SELECT timestamp, {r('gr', name='growth')}, {r('df', name='defensive')}, CASE WHEN gr - df > 0.005 THEN 'risk_on' WHEN gr - df < -0.005 THEN 'risk_off' ELSE 'neutral' END AS appetite FROM g""",
)
def risk_appetite(spark, d):
    from ..operators.volatility import with_returns

    x = with_returns(V.bars(spark, d)).withColumnRenamed("simple_return", "ret")
    return rounded(S.risk_appetite(x, ("S0", "S1", "S2"), ("S3", "S4", "S5")))


@query(
    "sector_ranking",
    V.with_views("bars_1h") + f""", s AS (SELECT symbol, last(close ORDER BY timestamp) / first(close ORDER BY timestamp) - 1 AS ret FROM bars_1h GROUP BY 1)
    SELECT symbol, {r('ret')}, CAST(row_number() OVER (ORDER BY ret DESC) AS INTEGER) AS rank FROM s""",
)
def sector_ranking(spark, d):
    from ..operators.queries import top_rank

    b = V.bars(spark, d).groupBy("symbol").agg((F.max_by("close", "timestamp") / F.min_by("close", "timestamp") - 1).alias("ret"))
    return rounded(top_rank(b, "ret"))


@query(
    "energy_impact",
    f"""WITH x AS (SELECT event_id, (user_id % 11 - 5) / 100.0e0 AS a, (event_id % 13 - 6) / 100.0e0 AS b FROM events), y AS (SELECT event_id, greatest(0, least(1, (abs(a) + abs(b)) / 2.0e0 * 2.0e0)) AS s FROM x)
    SELECT event_id, {r('s', name='impact')}, CASE WHEN s > 0.05 THEN 4 WHEN s > 0.02 THEN 2 ELSE 0 END AS n_sectors FROM y""",
)
def energy_impact(spark, d):
    e = V.table(spark, d, "events").select("event_id", S.energy_impact((F.col("user_id") % 11 - 5) / 100.0, (F.col("event_id") % 13 - 6) / 100.0).alias("impact"))
    return rounded(e.withColumn("n_sectors", F.size(S.energy_sectors(F.col("impact")))))


# The provided texts are invented prose, so this query uses syllable words that occur in them.
_GATE, _UP, _DN = ("tion", "the"), ("re", "en", "eau"), ("er", "on", "ou")


@query(
    "statement_surprise",
    "WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), y AS (SELECT doc_id, "
    + " + ".join(f"contains(t, '{w}')::INT" for w in _GATE) + " AS g, " + " + ".join(f"contains(t, '{w}')::INT" for w in _UP) + " AS h, " + " + ".join(f"contains(t, '{w}')::INT" for w in _DN)
    + " AS d FROM x) SELECT doc_id, CASE WHEN g > 0 THEN CASE WHEN h > d THEN 'hawkish_surprise' WHEN d > h THEN 'dovish_surprise' END END AS kind FROM y",
)
def statement_surprise(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.statement_surprise(F.col("text"), _GATE, _UP, _DN).alias("kind"))


@query("funding_extreme", "SELECT event_id, CASE WHEN (user_id % 9 - 4) / 10000.0e0 > 0.0001e0 THEN 'long_crowded' WHEN (user_id % 9 - 4) / 10000.0e0 < -0.0001e0 THEN 'short_crowded' END AS crowd FROM events")
def funding_extreme(spark, d):
    return V.table(spark, d, "events").select("event_id", S.funding_extreme((F.col("user_id") % 9 - 4) / 10000.0).alias("crowd"))


@query(
    "impact_estimate",
    _T + f""", x AS (SELECT symbol, seq, quantity, price, (seq % 400) * 20.0e0 AS adv, 0.25e0 AS vol, 0.001e0 AS kl, 4.0e0 AS sp FROM ticks),
    y AS (SELECT *, CASE WHEN adv > 0 THEN quantity / adv ELSE 0 END AS part, abs(kl * quantity / price) * 1e4 AS lin, CASE WHEN adv > 0 AND quantity > 0 THEN 0.5e0 * vol / sqrt(252) * sqrt(quantity / adv) * 1e4 ELSE 0 END AS sq FROM x)
    SELECT symbol, seq, {r('part', name='participation')}, {r('lin', name='linear_bps')}, {r('sq', name='sqrt_bps')}, CASE WHEN part > 0.01 THEN 'sqrt' ELSE 'linear' END AS model, {r('sp / 2 + CASE WHEN part > 0.01 THEN sq ELSE lin END', name='total_bps')} FROM y""",
)
def impact_estimate(spark, d):
    t = V.ticks(spark, d).select("symbol", "seq", "quantity", "price", ((F.col("seq") % 400) * 20.0).alias("adv"), F.lit(0.25).alias("annual_vol"), F.lit(0.001).alias("kyle_lambda"), F.lit(4.0).alias("spread_bps"))
    return rounded(S.impact_estimate(t).select("symbol", "seq", "participation", "linear_bps", "sqrt_bps", "model", "total_bps"))


@query(
    "execution_schedule",
    f"""WITH x AS (SELECT event_id, 20 + (event_id % 50) * 40.0e0 AS vol FROM events), k AS (SELECT event_id, vol, sqrt(greatest(0, 1e-6 / 0.5e0 * (vol / sqrt(252)) * (vol / sqrt(252)))) AS k FROM x),
    p AS (SELECT event_id, vol, i, CASE WHEN i < 9 THEN ((exp(k * (1 - i / 10.0e0)) - exp(-k * (1 - i / 10.0e0))) / (exp(k) - exp(-k))) ELSE 0 END AS keep FROM k, range(10) t(i)),
    q AS (SELECT *, coalesce(product(keep) OVER (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * (1 - keep) AS s FROM p)
    SELECT event_id, {r('max(s) FILTER (i = 1)', name='second')}, {r('max(s) FILTER (i = 9)', name='last')}, {r('0.5e0 * sum(s * s) * 1e4', 4, 'expected_cost')} FROM q GROUP BY event_id""",
)
def execution_schedule(spark, d):
    e = V.table(spark, d, "events").select("event_id", (20 + (F.col("event_id") % 50) * 40.0).alias("annual_vol"))
    x = S.execution_schedule(e)
    return rounded(rounded(x.select("event_id", F.col("schedule")[1].alias("second"), F.col("schedule")[9].alias("last"), F.round(F.col("expected_cost") + 1.7e-8, 4).alias("expected_cost")), keep=("expected_cost",)), None)


@query(
    "stress_table",
    V.with_views("trades") + f""", n AS (SELECT strategy_id, sum(abs(size * entry_price)) AS n FROM trades GROUP BY 1)
    SELECT strategy_id, scenario, shock AS price_shock, {r('n * abs(shock)', 2, 'estimated_loss')} FROM n, (VALUES ('flash_crash', -0.2e0), ('vol_spike', -0.05e0), ('liquidity_gone', 0.0e0), ('cb_hike_200bps', -0.08e0), ('cb_cut_200bps', -0.05e0)) s(scenario, shock)""",
)
def stress_table(spark, d):
    return rounded(S.stress_table(V.trades(spark, d), 1e6, ("strategy_id",)).select("strategy_id", "scenario", "price_shock", "estimated_loss"), 2)


@query(
    "bet_pnl",
    V.with_views("bars_1h") + __import__("tickloom.catalog.labels", fromlist=["_LONG"])._LONG + f""", b2 AS (SELECT symbol, t0, (i0 % 11) / 10.0e0 AS p, ln(exit_price / entry_price) AS lr FROM lab)
    SELECT symbol, t0, scenario, {r('2 * p - 1', name='bet')}, {r('lr * (2 * p - 1)', name='gross')}, {r('lr * (2 * p - 1) - 2 * bps / 1e4 * abs(2 * p - 1)', name='net')} FROM b2, (VALUES ('zero', 0.0e0), ('realistic', 5.0e0), ('stress', 15.0e0)) s(scenario, bps)""",
)
def bet_pnl(spark, d):
    from ..operators.queries import exact_lookup
    from .labels import _labels

    b = X.indexed(V.bars(spark, d))
    j = exact_lookup(_labels(spark, d).select("symbol", "t0", "t1"), b).join(b.select("symbol", F.col("timestamp").alias("t0"), F.col("_i")), ["symbol", "t0"])
    return rounded(S.bet_pnl(j.withColumn("p", (F.col("_i") % 11) / 10.0)).select("symbol", "t0", "scenario", "bet", "gross", "net"))


@query(
    "weighted_fusion",
    V.with_views("bars_1h") + f""", f AS (SELECT symbol, timestamp, unnest(['range','body','vol']) AS feature, unnest([(high - low) / close, (close - open) / open, CASE WHEN trade_count > 1 THEN volume / 100 END]) AS value FROM bars_1h),
    w(feature, ir) AS (VALUES ('range', 0.8e0), ('body', -0.5e0), ('vol', 0.3e0))
    SELECT symbol, timestamp, {r('CASE WHEN count(value) = 3 THEN sum(value * abs(ir) / 1.6e0) END', name='fused_signal')} FROM f JOIN w USING (feature) GROUP BY 1, 2""",
)
def weighted_fusion(spark, d):
    b = V.bars(spark, d)
    v = {"range": quotient(F.col("high") - F.col("low"), F.col("close")), "body": quotient(F.col("close") - F.col("open"), F.col("open")), "vol": F.when(F.col("trade_count") > 1, F.col("volume") / 100)}
    t = b.select("symbol", "timestamp", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), e.alias("value")) for k, e in v.items()])).alias("x")).select("symbol", "timestamp", "x.*")
    w = spark.createDataFrame([("range", 0.8), ("body", -0.5), ("vol", 0.3)], "feature string, ic_ir double")
    return rounded(S.weighted_fusion(t, w))


@query(
    "cross_asset_block",
    "SELECT event_id, event_id % 2 = 0 AND (user_id % 11) / 10.0e0 > 0.7 AND (event_id % 7 - 4) / 2.0e0 < -0.5 AS blocked FROM events",
)
def cross_asset_block(spark, d):
    e = V.table(spark, d, "events")
    dr = F.when(F.col("event_id") % 2 == 0, "long").otherwise("short")
    return e.select("event_id", S.cross_asset_block((F.col("user_id") % 11) / 10.0, (F.col("event_id") % 7 - 4) / 2.0, dr).alias("blocked"))


@query("live_signals")
def live_signals(spark, d):
    """Signals at every 5-minute bar: indicators of three timeframes joined as of the bar, components, levels."""
    t = V.ticks(spark, d)
    tf = {"1m": 60, "5m": 300, "15m": 900}
    b = X.timeframe_bars(t, tf)
    one = lambda n: b.filter(F.col("timeframe") == n).drop("timeframe")
    m5 = X.atr(X.bollinger(X.rsi_divergence(one("5m"))))
    fl = O.session_vwap(O.recent_microstructure(t)).groupBy("symbol", F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / 300) * 300).alias("timestamp"))
    k = F.struct(F.col("timestamp"), F.col("seq"))
    m5 = m5.join(fl.agg(F.max_by("ofi", "seq").alias("ofi"), F.max_by("vwap", "seq").alias("vwap")), ["symbol", "timestamp"])
    m5 = m5.withColumn("closed", F.timestamp_seconds(F.unix_seconds("timestamp") + 300)).withColumnRenamed("close", "price")
    for n in ("1m", "15m"):
        e = X.ema(X.ema(one(n), 8, "f"), 21, "s")
        e = e.select("symbol", F.timestamp_seconds(F.unix_seconds("timestamp") + tf[n]).alias("at"), F.col("f").alias(f"ema_fast_{n}"), F.col("s").alias(f"ema_slow_{n}"))
        m5 = asof_join(m5.drop("_i"), e, ["symbol"], "closed", "at", [f"ema_fast_{n}", f"ema_slow_{n}"], strict=False)
    s = S.price_levels(S.confluence(S.component_scores(m5))).filter("direction IS NOT NULL")
    return rounded(s.select("symbol", "timestamp", "price", "direction", "strength", "confidence", "stop_loss", "target_1", "target_2", F.concat_ws(",", "triggers").alias("triggers")))
