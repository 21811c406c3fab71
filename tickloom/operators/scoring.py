"""Rule models evaluated per row, as column expressions over whole tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add, clamp, pick, quotient, ratio


# -- regimes ------------------------------------------------------------------------------------
def volatility_regime(vix: Column) -> Column:
    """Missing readings count as normal."""
    return pick([(vix.isNull(), "normal"), (vix >= 35, "crisis"), (vix >= 25, "high"), (vix >= 15, "normal")], "low")


def macro_state(df: DataFrame, vix="vix", dollar="dollar_change", y10="yield_10y", y2="yield_2y", funding="funding_rate") -> DataFrame:
    """Volatility regime, risk mode and size multiplier from the latest macro readings."""
    v, dx = F.col(vix), F.col(dollar)
    inverted = F.col(y2) > F.col(y10)
    reg = volatility_regime(v)
    base = pick([(reg == "crisis", 0.0), (reg == "high", 0.3), (reg == "normal", 1.0)], 1.2)
    mult = (
        base
        * F.when(dx > 0.5, 0.7).otherwise(1.0)
        * F.when(inverted, 0.8).otherwise(1.0)
        * F.when(F.abs(funding) > 0.03, 0.9).otherwise(1.0)
    )
    reduced = (dx > 0.3) | inverted | reg.isin("crisis", "high")
    return (
        df.withColumn("vol_regime", reg)
        .withColumn("macro_mult", F.round(mult + 1e-12, 3))
        .withColumn("risk_mode", F.when(reduced, "reduced").otherwise("normal"))
        .withColumn("yield_curve_inverted", inverted)
    )


def macro_multiplier(vix: Column, yield_spread: Column) -> Column:
    """Null-tolerant multiplier in [0, 1]."""
    m = pick([(vix > 30, 0.6), (vix > 20, 0.8)], 1.0) * F.when(yield_spread < 0, 0.9).otherwise(1.0)
    return clamp(m, 0.0, 1.0)


def risk_mode(vol_regime: Column, event_active: Column, breaker_open: Column) -> Column:
    """Crisis, then event, then breaker, then high volatility."""
    return pick(
        [(vol_regime == "crisis", "crisis"), (event_active, "reduced"), (breaker_open, "blocked"), (vol_regime == "high", "reduced")],
        "normal",
    )


# -- signal components and confluence ------------------------------------------------------------
# Component weights.
COMPONENT_WEIGHTS = {"microstructure": 0.35, "bollinger": 0.25, "ema_mtf": 0.20, "rsi_divergence": 0.15, "vwap": 0.05}


def component_scores(df: DataFrame) -> DataFrame:
    """Score and trigger flag of the five components.

    Needs price, ofi, bb_upper, bb_lower, ema_fast_1m, ema_slow_1m, ema_fast_15m, ema_slow_15m, vwap,
    rsi_divergence."""
    from .technical import band_score, vote_score

    p, vwap = F.col("price"), F.col("vwap")
    emas = [F.col(x) for x in ("ema_fast_1m", "ema_slow_1m", "ema_fast_15m", "ema_slow_15m")]
    missing = emas[0].isNull() | emas[1].isNull() | emas[2].isNull() | emas[3].isNull()
    dev = (p - vwap) / F.when(vwap > 0, vwap)
    big = F.greatest(F.abs("ofi"), F.lit(1e-6))
    scores = {
        "microstructure": (F.coalesce(clamp(F.col("ofi") / big, -1.0, 1.0), F.lit(0.0)), F.abs("ofi") > 0.3),
        "bollinger": (band_score(p, F.col("bb_upper"), F.col("bb_lower")), None),
        "ema_mtf": (F.when(missing, 0.0).otherwise(vote_score(*emas, F.coalesce(p > vwap, F.lit(False)))), None),
        "rsi_divergence": (pick([(F.col("rsi_divergence") == "bullish", 1.0), (F.col("rsi_divergence") == "bearish", -1.0)], 0.0), None),
        "vwap": (F.coalesce(clamp(dev * -20.0, -1.0, 1.0), F.lit(0.0)), None),
    }
    limits = {"bollinger": 0.15, "ema_mtf": 0.10, "rsi_divergence": 0.0, "vwap": 0.002}
    for n, (s, _) in scores.items():
        df = df.withColumn(f"score_{n}", s)
    for n, (_, trig) in scores.items():
        flag = trig if trig is not None else F.abs(f"score_{n}") > limits[n]
        df = df.withColumn(f"on_{n}", F.coalesce(flag, F.lit(False)))
    return df


def confluence(df: DataFrame, weights: Mapping[str, float] = COMPONENT_WEIGHTS, min_active: int = 2, min_strength: float = 0.20) -> DataFrame:
    """Weighted strength of the triggered components, halved on conflicting signs, 0 below the minimum."""
    z = F.lit(0.0)
    on = {n: F.col(f"on_{n}") for n in weights}
    sc = {n: F.col(f"score_{n}") for n in weights}
    n_on = add([o.cast("int") for o in on.values()])
    total = add([F.when(on[n], F.lit(w)).otherwise(z) for n, w in weights.items()])
    mix = add([F.when(on[n], F.lit(w) * sc[n]).otherwise(z) for n, w in weights.items()])
    pos = add([(on[n] & (sc[n] > 0.05)).cast("int") for n in weights])
    neg = add([(on[n] & (sc[n] < -0.05)).cast("int") for n in weights])
    raw = ratio(mix, total, 0.0) * F.when((pos > 0) & (neg > 0), 0.5).otherwise(1.0)
    fin = clamp(raw, -1.0, 1.0)
    live = (n_on >= min_active) & (F.abs(fin) >= min_strength)
    names = F.array_compact(F.array(*[F.when(on[n], F.lit(n)) for n in weights]))
    return (
        df.withColumn("strength", F.when(live, fin).otherwise(z))
        .withColumn("triggers", F.when(live, names).otherwise(F.array().cast("array<string>")))
        .withColumn("direction", F.when(F.col("strength") > 0, "long").when(F.col("strength") < 0, "short"))
        .withColumn(
            "confidence",
            F.when(F.col("direction").isNotNull(), F.least(F.lit(1.0), F.abs("strength") + F.size("triggers") / 4.0 * 0.3)),
        )
    )


def price_levels(df: DataFrame, entry: str = "price", atr: str = "atr") -> DataFrame:
    """Stop at 1.5 and targets at 2 and 3 average ranges; 0.2% of price without a range."""
    e = F.col(entry)
    a = F.when(F.col(atr) > 0, F.col(atr)).otherwise(e * 0.002)
    s = F.when(F.col("direction") == "long", 1.0).when(F.col("direction") == "short", -1.0)
    stop = e - s * 1.5 * a
    return (
        df.withColumn("stop_loss", F.when(stop <= 0, e * 0.001).otherwise(stop))
        .withColumn("target_1", e + s * 2.0 * a)
        .withColumn("target_2", e + s * 3.0 * a)
    )


# -- fusion -------------------------------------------------------------------------------------
def fusion_score(strength: Column, n_triggers: Column, macro_mult: Column, session_bonus: Column, alignment: Column, us_prime: Column) -> Column:
    """Capped product; a missing alignment counts 0.7, a missing session bonus 1."""
    bonus = pick([(n_triggers >= 3, 1.35), (n_triggers == 2, 1.00), (n_triggers == 1, 0.50)], 0.0)
    score = (
        F.abs(strength)
        * macro_mult
        * bonus
        * F.coalesce(session_bonus, F.lit(1.0))
        * F.coalesce(alignment, F.lit(0.7))
        * F.when(us_prime, 1.10).otherwise(1.0)
    )
    return F.least(score, F.lit(2.0))


def pick_strategy(trend: Column, vol: Column, mode: Column) -> Column:
    return pick(
        [
            (mode == "crisis", "blocked"),
            (trend.isin("trending_up", "trending_down"), "momentum_scalp"),
            (trend == "ranging", "mean_reversion"),
            (vol == "high", "spike_scalp"),
        ],
        "momentum_scalp",
    )


# Volatility regimes, trend regimes, whether either suffices, size multiplier.
STRATEGIES = {
    "momentum_scalp": (("normal",), ("trending_up", "trending_down"), False, 1.0),
    "mean_reversion": (("low", "normal"), ("ranging",), False, 0.8),
    "spike_scalp": (("high",), (), False, 0.5),
    "short_momentum": (("high", "crisis"), ("trending_down",), True, 0.6),
}


def strategy_active(strategy: Column, trend: Column, vol: Column, mode: Column) -> Column:
    rules = []
    for name, (vols, trends, either, _) in STRATEGIES.items():
        v = vol.isin(*vols) if vols else F.lit(True)
        t = trend.isin(*trends) if trends else F.lit(True)
        rules.append((strategy == name, (v | t) if either else (v & t)))
    return ~mode.isin("blocked", "crisis") & pick(rules, False)


def strategy_multiplier(strategy: Column, mode: Column) -> Column:
    return F.when(mode == "crisis", 0.0).otherwise(pick([(strategy == n, s[3]) for n, s in STRATEGIES.items()], 0.0))


def kelly_fraction(win_rate: Column, reward_risk: Column, divisor: float = 4.0) -> Column:
    p, b = clamp(win_rate, 0.0, 1.0), F.greatest(reward_risk, F.lit(0.01))
    return F.least(F.greatest((p * b - (1 - p)) / b, F.lit(0.0)) / divisor, F.lit(0.25))


def position_size(capital: Column, kelly: Column, regime_mult: Column, session_mult: Column, price_impact: Column, is_crypto: Column) -> Column:
    damp = clamp(1 - price_impact * 100.0, 0.1, 1.0)
    size = capital * kelly * regime_mult * session_mult * damp * F.when(is_crypto, 0.70).otherwise(1.0)
    return F.least(size, capital * 0.10)


def vol_adjusted_kelly(kelly: Column, forecast_vol: Column, target: float = 0.15, cap: float = 0.25) -> Column:
    scaled = kelly * target / F.when(forecast_vol > 0, forecast_vol)
    return F.when(forecast_vol <= 0, F.least(kelly, F.lit(cap))).otherwise(clamp(scaled, 0.0, cap))


# Weights of the rule-based trade filter.
META_WEIGHTS = {"signal_strength": 0.25, "confluence": 0.20, "hurst": 0.15, "vpin": 0.20, "vol_regime": 0.10, "spread": 0.05, "regime": 0.05}


def meta_score(df: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Veto rules, then seven weighted terms.

    Needs signal_strength, n_triggers, hurst, vpin, forecast_vol, spread_bps, session_mult, macro_mult."""
    c = F.col
    v, sp, n = c("forecast_vol"), c("spread_bps"), c("n_triggers")
    veto = pick([(c("vpin") >= 0.90, "vpin_extreme"), (c("macro_mult") <= 0, "crisis_regime"), (sp > 50, "spread_too_wide")], F.lit(None).cast("string"))
    terms = {
        "signal_strength": c("signal_strength") * 2.0 - 0.5,
        "confluence": pick([(n >= 4, 1.0), (n == 3, 0.8), (n == 2, 0.5)], -0.5),
        "hurst": clamp(1 - c("hurst") / 0.5 * 2.0, -1.0, 1.0),
        "vpin": 1 - c("vpin") * 2.0,
        "vol_regime": pick([((v >= 0.10) & (v <= 0.30), 1.0), ((v >= 0.05) & (v <= 0.50), 0.0)], -1.0),
        "spread": F.when(sp <= 5, 1.0).otherwise(F.greatest(F.lit(-1.0), 1 - (sp - 5.0) / 15.0)),
        "regime": F.least(F.lit(1.0), c("session_mult") / 1.5 * c("macro_mult")) * 2.0 - 1.0,
    }
    soft = clamp(add([F.lit(w) * terms[k] for k, w in META_WEIGHTS.items()]), -1.0, 1.0)
    df = df.withColumn("_veto", veto).withColumn("_soft", soft)
    blocked = c("_veto").isNotNull()
    conf = clamp((c("_soft") + 1) / 2, 0.0, 1.0)
    size = F.least(
        F.lit(1.0), conf * F.greatest(F.lit(0.1), 1 - c("vpin")) * F.greatest(F.lit(0.5), 1 - sp / 100.0) * c("macro_mult")
    )
    return (
        df.withColumn("meta_score", F.when(blocked, -1.0).otherwise(c("_soft")))
        .withColumn("confidence", F.when(blocked, 0.0).otherwise(conf))
        .withColumn("size_mult", F.when(blocked, 0.0).otherwise(size))
        .withColumn("should_trade", ~blocked & (c("_soft") >= threshold))
        .withColumn("blocking_reason", F.coalesce(c("_veto"), F.when(c("_soft") < threshold, "score_below_threshold")))
        .drop("_veto", "_soft")
    )


def hedge(df: DataFrame, share: float = 0.30) -> DataFrame:
    """Reasons to hedge, the opposite side and 30% of the reference size.

    Needs direction, price, rsi, bb_upper, bb_lower, ofi, event_active, reference_size."""
    c = F.col
    long, short = c("direction") == "long", c("direction") == "short"
    rules = [
        ("rsi_extreme", (long & (c("rsi") > 70)) | (short & (c("rsi") < 30))),
        ("band_breach", c("bb_upper").isNotNull() & c("bb_lower").isNotNull() & ((long & (c("price") >= c("bb_upper"))) | (short & (c("price") <= c("bb_lower"))))),
        ("flow_pinned", F.abs("ofi") < 0.1),
        ("event_active", c("event_active")),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules]))
    df = df.withColumn("hedge_reasons", reasons)
    need = F.size("hedge_reasons") > 0
    return (
        df.withColumn("hedge", need)
        .withColumn("hedge_direction", F.when(need, F.when(long, "short").otherwise("long")))
        .withColumn("hedge_size", F.when(need, c("reference_size") * share))
    )


def weighted_fusion(features: DataFrame, weights: DataFrame, names: Sequence[str] | None = None, ir: str = "ic_ir") -> DataFrame:
    """Fused signal per (symbol, timestamp) from a tall feature table; weights |IC_IR| / sum.

    ``weights`` has one row per feature. Rows of a timestamp that lack a feature give a null signal."""
    w = weights.select("feature", F.abs(ir).alias("_w"))
    tot = w.agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = w.crossJoin(tot).select("feature", (F.col("_w") / F.col("_t")).alias("weight"), "_k")  # one-row total
    j = features.join(w, "feature")
    g = j.groupBy("symbol", "timestamp").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"), F.count("value").alias("_n"), F.max("_k").alias("_k"))
    return g.select("symbol", "timestamp", F.when(F.col("_n") == F.col("_k"), F.col("_s")).alias("fused_signal"))


# -- macro ---------------------------------------------------------------------------------------
def surprise(actual: Column, consensus: Column) -> Column:
    return ratio(actual - consensus, F.abs(consensus), 0.0)


def surprise_multiplier(s: Column, impact: Column, hours: Column) -> Column:
    """1 plus the weighted surprise, full for two hours, fading to nothing after a day."""
    weight = pick([(impact == "high", 0.3), (impact == "medium", 0.15), (impact == "low", 0.05)], 0.1)
    fade = clamp(1 - (hours - 2.0) / 22.0, 0.0, 1.0)
    return F.when(hours >= 24, 1.0).otherwise(1 + s * weight * fade)


def risk_appetite(returns: DataFrame, growth: Sequence[str], defensive: Sequence[str], keys: Sequence[str] = ("timestamp",), value: str = "ret", margin: float = 0.005) -> DataFrame:
    """Growth against defensive sectors: risk_on, risk_off or neutral."""
    g = returns.groupBy(*keys).agg(
        F.avg(F.when(F.col("symbol").isin(*growth), F.col(value))).alias("growth"),
        F.avg(F.when(F.col("symbol").isin(*defensive), F.col(value))).alias("defensive"),
    )
    d = F.col("growth") - F.col("defensive")
    return g.withColumn("appetite", pick([(d > margin, "risk_on"), (d < -margin, "risk_off")], "neutral"))


def energy_impact(a: Column, b: Column) -> Column:
    return clamp((F.abs(a) + F.abs(b)) / 2.0 * 2.0, 0.0, 1.0)


def energy_sectors(impact: Column) -> Column:
    hit = F.array_compact(
        F.array(*[F.when(impact > lim, F.lit(n)) for n, lim in (("XLE", 0.02), ("XOM", 0.02), ("XLB", 0.05), ("airlines_negative", 0.05))])
    )
    return hit


# Word lists of the statement classifier.
SURPRISE_WORDS = ("unexpected", "emergency", "surprise")
HAWKISH_WORDS = ("raise", "hike", "tighten", "inflation concern")
DOVISH_WORDS = ("cut", "ease", "lower", "stimulus", "support")


def statement_surprise(
    text: Column, gate: Sequence[str] = SURPRISE_WORDS, hawkish: Sequence[str] = HAWKISH_WORDS, dovish: Sequence[str] = DOVISH_WORDS
) -> Column:
    """Which word list occurs with more distinct entries, for texts containing a gate word."""
    t = F.lower(text)
    hits = lambda words: add([F.contains(t, F.lit(w)).cast("int") for w in words])
    h, d = hits(hawkish), hits(dovish)
    return F.when(hits(gate) > 0, F.when(h > d, "hawkish_surprise").when(d > h, "dovish_surprise"))


def funding_extreme(rate: Column) -> Column:
    return F.when(rate > 0.0001, "long_crowded").when(rate < -0.0001, "short_crowded")


# -- execution ------------------------------------------------------------------------------------
def sqrt_impact_bps(quantity: Column, adv: Column, annual_vol: Column, eta: float = 0.5) -> Column:
    part = quantity / F.when(adv > 0, adv)
    ok = (adv > 0) & (quantity > 0)
    return F.when(ok, F.lit(eta * 10_000.0) * annual_vol / math.sqrt(252.0) * F.sqrt(F.when(ok, part))).otherwise(0.0)


def impact_estimate(df: DataFrame) -> DataFrame:
    """Linear below 1% participation, square root above; plus half the spread. The linear impact on a price of 0 is infinite.

    Needs quantity, adv, annual_vol, price, kyle_lambda, spread_bps."""
    c = F.col
    part = ratio(c("quantity"), F.when(c("adv") > 0, c("adv")), 0.0)
    linear = F.abs(quotient(c("kyle_lambda") * c("quantity"), c("price"))) * 10_000.0
    df = (
        df.withColumn("participation", part)
        .withColumn("linear_bps", linear)
        .withColumn("sqrt_bps", sqrt_impact_bps(c("quantity"), c("adv"), c("annual_vol")))
    )
    large = F.col("participation") > 0.01
    return df.withColumn("model", F.when(large, "sqrt").otherwise("linear")).withColumn(
        "total_bps", c("spread_bps") / 2 + F.when(large, c("sqrt_bps")).otherwise(c("linear_bps"))
    )


def sqrt_slippage_bps(notional: Column, adv: Column, daily_vol: Column, eta: float = 0.01, gamma: float = 0.1) -> dict[str, Column]:
    """Temporary, permanent and total square-root impact in basis points; null without volume."""
    root = F.sqrt(F.abs(notional) / F.when(adv > 0, adv))
    base = F.when(adv > 0, F.when((notional == 0) | (daily_vol <= 0), 0.0).otherwise(daily_vol * root * 10_000.0))
    return {"temporary_bps": base * eta, "permanent_bps": base * gamma, "total_bps": base * (eta + gamma)}


def execution_schedule(df: DataFrame, vol: str = "annual_vol", periods: int = 10, risk: float = 1e-6, eta: float = 0.5) -> DataFrame:
    """Fractions to trade per period with expected and variance cost.

    The remaining share after period i is multiplied by sinh(k(1-i/n))/sinh(k); below k = 1e-6 the order
    is split evenly."""
    sigma = F.col(vol) / math.sqrt(252.0)
    df = df.withColumn("_k", F.sqrt(F.greatest(F.lit(0.0), F.lit(risk / eta) * sigma * sigma)))
    even = F.array_repeat(F.lit(1.0 / periods), periods)
    k = F.when(F.col("_k") >= 1e-6, F.col("_k"))
    keep = F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda i: F.sinh(k * (1 - i / F.lit(float(periods)))) / F.sinh(k))
    step = lambda acc, x: F.struct(
        (acc.rem * x).alias("rem"), F.concat(acc.out, F.array(acc.rem * (1 - x))).alias("out")
    )
    start = F.struct(F.lit(1.0).alias("rem"), F.array().cast("array<double>").alias("out"))
    df = df.withColumn("_a", F.aggregate(F.slice(keep, 1, periods - 1), start, step))
    df = df.withColumn("schedule", F.when(F.col("_k") < 1e-6, even).otherwise(F.concat("_a.out", F.array("_a.rem"))))
    sq = F.aggregate("schedule", F.lit(0.0), lambda s, x: s + x * x)
    return df.withColumn("expected_cost", eta * sq * 10_000.0).withColumn("variance_cost", sigma * sigma * sq * 10_000.0).drop("_k", "_a")


# Round-trip cost per side in basis points, and stress shocks.
COST_SCENARIOS = {"zero": 0.0, "realistic": 5.0, "stress": 15.0}
STRESS_SHOCKS = {"flash_crash": -0.20, "vol_spike": -0.05, "liquidity_gone": 0.00, "cb_hike_200bps": -0.08, "cb_cut_200bps": -0.05}


def explode_scenarios(df: DataFrame, scenarios: Mapping[str, float], name: str, value: str) -> DataFrame:
    """Repeat every row for each entry of a small fixed table."""
    arr = F.array(*[F.struct(F.lit(k).alias(name), F.lit(float(v)).alias(value)) for k, v in scenarios.items()])
    return df.withColumn("_s", F.explode(arr)).select("*", f"_s.{name}", f"_s.{value}").drop("_s")


def stress_table(positions: DataFrame, capital: float, keys: Sequence[str] = ()) -> DataFrame:
    tot = positions.groupBy(*keys).agg(F.sum(F.abs(F.col("size") * F.col("entry_price"))).alias("notional"))
    out = explode_scenarios(tot, STRESS_SHOCKS, "scenario", "price_shock")
    loss = F.col("notional") * F.abs("price_shock")
    return out.withColumn("estimated_loss", loss).withColumn("pct_capital", loss / capital if capital > 0 else F.lit(0.0))


def cross_asset_block(correlation: Column, benchmark_return_pct: Column, direction: Column) -> Column:
    return (direction == "long") & (correlation > 0.70) & (benchmark_return_pct < -0.5)


def r_multiples(df: DataFrame) -> DataFrame:
    """Net result over the price move times size, and over the price move alone (0 counts as 1)."""
    move = F.abs(F.col("entry_price") - F.col("exit_price"))
    return df.withColumn("r_multiple", ratio(F.col("net_pnl"), move * F.col("size"))).withColumn(
        "r_multiple_unit", F.col("net_pnl") / F.when(move == 0, 1.0).otherwise(move)
    )


def bet_pnl(bets: DataFrame, probability: str = "p", scenarios: Mapping[str, float] = COST_SCENARIOS) -> DataFrame:
    """Result of sizing by 2p-1 on (value_0, value_1), net of two-sided costs, per cost scenario."""
    b = bets.withColumn("bet", 2 * F.col(probability) - 1).withColumn("log_return", F.log(F.col("value_1") / F.col("value_0")))
    b = explode_scenarios(b, scenarios, "scenario", "bps")
    gross = F.col("log_return") * F.col("bet")
    return b.withColumn("gross", gross).withColumn("net", gross - 2 * F.col("bps") / 10_000.0 * F.abs("bet"))
