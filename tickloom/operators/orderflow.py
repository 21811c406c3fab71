"""Order-flow and liquidity features on ticks.

All of them use trailing frames of bounded length, evaluated on row chunks (plans.ordered).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import add, pick, ratio, safe_tanh, seconds
from ..plans.ordered import CHUNK, INDEX, TICKS, Ordered


def signed_quantity() -> Column:
    """Sell labels count negative, everything else positive."""
    return F.when(F.upper("side").isin("SELL", "S", "ASK"), -F.col("quantity")).otherwise(F.col("quantity"))


def order_flow(
    ticks: DataFrame,
    windows: Sequence[int] = (10, 50, 100),
    weights: Sequence[float] = (0.5, 0.3, 0.2),
    std_window: int = 60,
    k: float = 3.0,
    s: Ordered = TICKS,
) -> DataFrame:
    """Mean order-flow imbalance per window and the combined, scaled signal.

    Book mode (bid_size and ask_size present) uses changes of queue size, trade mode signed quantity.
    Window means are differences of a running sum inside the chunk.
    """
    book = {"bid_size", "ask_size"} <= set(ticks.columns)
    full = max(windows) - 1

    def fn(t: DataFrame) -> DataFrame:
        w = s.window()
        depth = F.col("bid_size") - F.col("ask_size")
        t = t.withColumn("_f", F.coalesce(depth - F.lag(depth).over(w), F.lit(0.0)) if book else signed_quantity())
        t = s.sums_over(t, {f"ofi_{n}": (F.col("_f"), n) for n in windows})
        means = {f"ofi_{n}": F.when(F.col(INDEX) >= n - 1, F.col(f"ofi_{n}") / n) for n in windows}
        t = t.withColumns(means)
        x = F.when(F.col(INDEX) >= full, add([F.lit(wt) * F.col(f"ofi_{n}") for n, wt in zip(windows, weights)]))
        t = t.withColumn("_x", x)
        moved = F.when(F.col("_x") != F.lag("_x").over(w), 1.0).otherwise(0.0)
        t = t.withColumn("_mv", F.when(F.col(INDEX) > full, moved).otherwise(0.0))
        t = s.sums_over(t, {"_s1": (F.col("_x"), std_window), "_s2": (F.col("_x") * F.col("_x"), std_window), "_cx": (F.col("_mv"), std_window - 1)})
        m = F.least(F.col(INDEX) - full + 1, F.lit(std_window)).cast("double")
        var = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.when(m > 0, m)) / F.when(m > 1, m - 1)
        # no change inside the window: exactly flat
        sd = F.when(F.col("_cx") > 0, F.sqrt(F.greatest(F.lit(0.0), F.coalesce(var, F.lit(0.0))))).otherwise(0.0)
        return t.withColumn("ofi_signal", safe_tanh(F.col("_x"), F.lit(k) * sd)).drop("_f", "_x", "_mv", "_s1", "_s2", "_cx")

    # The first tick of a chunk's halo has no predecessor, hence one row more.
    return s.windowed(ticks, full + std_window + 1, fn)


def cvd_kyle(
    ticks: DataFrame,
    cvd_window: int = 20,
    kyle_window: int = 100,
    z_lookback: int = 252,
    divergence_k: float = 3.0,
    liquidity_k: float = 3.0,
    weights: tuple[float, float] = (0.5, 0.5),
    s: Ordered = TICKS,
) -> DataFrame:
    """Cumulative volume delta, its divergence from price, price impact, its z-score and signals."""
    base = s.running(ticks, sums={"cvd": signed_quantity()})

    def fn(t: DataFrame) -> DataFrame:
        w = s.window()
        i = F.col(INDEX)
        q = signed_quantity()
        t = t.withColumns(
            {
                "_q": q,
                "_dp": F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0)),
                "_mq": F.when(q != F.lag(q).over(w), 1.0).otherwise(0.0),
            }
        )
        near = s.trailing(cvd_window)
        x, y, k = F.col("_q"), F.col("_dp"), float(kyle_window)
        dc = F.when(i == 0, F.lit(0.0)).otherwise(x)
        # Least squares from window sums. A constant regressor has slope 0 (minimum-norm solution), which
        # the number of changes inside the window tells exactly; negative slopes are clamped.
        t = s.sums_over(
            t,
            {
                "_x": (x, kyle_window, True),
                "_y": (y, kyle_window, True),
                "_xy": (x * y, kyle_window, True),
                "_xx": (x * x, kyle_window, True),
                "_ch": (F.col("_mq"), kyle_window - 1, True),
            },
            {"_cov": F.covar_pop(y, dc).over(near), "_sp": F.stddev_pop(y).over(near), "_sc": F.stddev_pop(dc).over(near)},
        )
        flat = (F.col("_sp") < 1e-15) | (F.col("_sc") < 1e-15)
        corr = F.col("_cov") / F.when(~flat, F.col("_sp") * F.col("_sc"))
        div = F.when(flat, F.lit(0.0)).otherwise(F.tanh(-corr * divergence_k))
        den = F.lit(k) * F.col("_xx") - F.col("_x") * F.col("_x")
        slope = F.when((F.col("_ch") > 0) & (den > 0), (F.lit(k) * F.col("_xy") - F.col("_x") * F.col("_y")) / F.when(den > 0, den))
        t = t.withColumns(
            {
                "cvd_divergence": F.when(i >= cvd_window - 1, div),
                "kyle_lambda": F.when(i >= kyle_window, F.greatest(F.coalesce(slope, F.lit(0.0)), F.lit(0.0))),
            }
        )
        # z-score against the last values, again from sums; no change inside the window means score 0
        lam = F.col("kyle_lambda")
        changed = F.when(lam != F.lag(lam).over(w), 1.0).otherwise(0.0)
        t = t.withColumn("_ml", F.when(i > kyle_window, changed).otherwise(0.0))
        t = s.sums_over(t, {"_cl": (F.col("_ml"), z_lookback - 1)})
        # sums of the frame alone: impacts of 1e-4 would drown in running sums that hold larger ones
        t = s.frame_sums(t, {"_s1": lam, "_s2": lam * lam}, z_lookback)
        n = F.least(i - kyle_window + 1, F.lit(z_lookback)).cast("double")
        n1 = F.when(n > 1, n - 1)
        sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.when(n > 0, n)) / n1))
        t = t.withColumns({"_m": F.col("_s1") / F.when(n > 0, n), "_sd": sd})
        flat_l = (F.col("_cl") == 0) | (F.col("_sd") < 1e-15)
        score = F.when(flat_l, F.lit(0.0)).otherwise((lam - F.col("_m")) / F.when(~flat_l, F.col("_sd")))
        t = t.withColumn("kyle_lambda_zscore", F.when(i >= kyle_window + 1, score))
        t = t.withColumn("liquidity_signal", F.tanh(F.col("kyle_lambda_zscore") / liquidity_k))
        mixed = weights[0] * F.col("cvd_divergence") + weights[1] * F.col("liquidity_signal")
        t = t.withColumn("combined_signal", F.tanh(mixed))
        return t.drop("_q", "_dp", "_mq", "_cov", "_sp", "_sc", "_x", "_y", "_xy", "_xx", "_ch", "_ml", "_s1", "_s2", "_cl", "_m", "_sd")

    # The oldest slope needed looks back kyle_window rows, whose first price change needs one more.
    return s.windowed(base, kyle_window + z_lookback + 1, fn)


def recent_microstructure(ticks: DataFrame, window: int = 100, s: Ordered = TICKS) -> DataFrame:
    """State over the last ``window`` ticks after each tick: price-based flow imbalance, volume delta,
    price impact (flow against the next change), mean spread, trades per second, absorption flag."""
    buy = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(F.lit(0.0))
    sell = F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(F.lit(0.0))
    bid, ask = F.coalesce("bid", F.lit(0.0)), F.coalesce("ask", F.lit(0.0))

    def fn(t: DataFrame) -> DataFrame:
        w, last, pairs = s.window(), s.trailing(window), s.trailing(window - 1)
        n = F.least(F.col(INDEX) + 1, F.lit(window))
        net = buy - sell
        valid = (bid > 0) & (ask > bid)
        t = t.withColumns(
            {
                "_bid": bid,
                "_ask": ask,
                "_sell": sell,
                "_net": net,
                "_bp": F.when(valid, (ask - bid) / ((bid + ask) / 2) * 10_000.0),
                "_dp": F.when(F.col(INDEX) > 0, F.col("price") - F.lag("price").over(w)),
                "_prev": F.when(F.col(INDEX) > 0, F.lag(net).over(w)),
                "_us": F.unix_millis("timestamp"),
            }
        )
        # Each change is paired with the flow of the tick before it; the oldest tick of the window
        # contributes its flow only, so window-1 pairs end at the current tick.
        t = t.withColumns(
            {
                "_vol": F.sum("quantity").over(last),
                "_imb": (F.col("_bid") - F.first("_bid").over(last)) - (F.col("_ask") - F.first("_ask").over(last)),
                "_delta": F.sum("_net").over(last),
                "_var": F.var_samp("_prev").over(pairs),
                "_cov": F.covar_samp("_dp", "_prev").over(pairs),
                "_bps": F.avg("_bp").over(last),
                "_ms": F.col("_us") - F.first("_us").over(last),
                "_sm": F.avg("_sell").over(last),
                "_ss": F.stddev_samp("_sell").over(last),
                "_ad": F.avg(F.abs("_dp")).over(pairs),
                "_mv": F.abs(F.col("price") - F.lag("price", 5).over(w)),
            }
        )
        zero = F.lit(0.0)
        few = n < 2
        t = (
            t.withColumn("ofi", F.when(few, zero).otherwise(ratio(F.col("_imb"), F.col("_vol"), 0.0)))
            .withColumn("cvd", F.when(few, zero).otherwise(ratio(F.col("_delta"), F.col("_vol"), 0.0)))
            .withColumn("kyle_lambda", F.when(n < 3, zero).otherwise(F.coalesce(ratio(F.col("_cov"), F.col("_var"), 0.0), zero)))
            .withColumn("spread_bps", F.when(few, zero).otherwise(F.coalesce(F.col("_bps"), zero)))
            .withColumn("trade_intensity", F.when(F.col("_ms") > 0, n / (F.when(F.col("_ms") > 0, F.col("_ms")) / 1000.0)).otherwise(zero))
            .withColumn(
                "absorption",
                F.coalesce(
                    (n >= 10)
                    & (F.col("_sell") > F.col("_sm") + 2 * F.col("_ss"))
                    & (ratio(F.col("_mv"), F.col("_ad")) < 1.0),
                    F.lit(False),
                ),
            )
        )
        return t.drop(
            *("_bid", "_ask", "_sell", "_net", "_bp", "_dp", "_prev", "_us"),
            *("_vol", "_imb", "_delta", "_var", "_cov", "_bps", "_ms", "_sm", "_ss", "_ad", "_mv"),
        )

    return s.windowed(ticks, window, fn)


def session_vwap(ticks: DataFrame, s: Ordered = TICKS) -> DataFrame:
    """Running volume-weighted average price, restarted every UTC day."""
    t = ticks.withColumn("day", F.to_date("timestamp"))
    t = s.running(t, {"_pv": F.col("price") * F.col("quantity"), "_v": F.col("quantity")}, reset=("day",), index=None)
    return t.withColumn("vwap", ratio(F.col("_pv"), F.col("_v"))).drop("_pv", "_v")


# Toxicity levels from the top, with the position-size multiplier of each.
TOXICITY = ((0.95, "extreme", 0.0), (0.85, "high", 0.25), (0.70, "elevated", 0.50), (0.50, "normal", 1.0))
TOXICITY_LOW = ("low", 1.10)


def volume_buckets(ticks: DataFrame, bucket_size: float, s: Ordered = TICKS) -> DataFrame:
    """Buy and sell volume per complete volume bucket of fixed size.

    The cumulative volume places every tick on the volume axis; a tick crossing bucket borders is split
    between buckets in its own buy/sell mix. Partial sums are combined before the shuffle by bucket.
    """
    share = (
        F.when(F.col("side") == "BUY", 1.0)
        .when(F.col("side") == "SELL", 0.0)
        .when(F.col("bid").isNull() | F.col("ask").isNull(), 0.5)
        .when(F.col("price") >= (F.col("bid") + F.col("ask")) / 2, 0.6)
        .otherwise(0.4)
    )
    t = s.running(ticks, {"_cum": F.col("quantity")}, index=None).filter(F.col("quantity") > 0)
    size = F.lit(float(bucket_size))
    lo, hi = F.col("_cum") - F.col("quantity"), F.col("_cum")
    first = F.floor(lo / size)
    last = F.greatest(first, F.ceil(hi / size) - 1)
    parts = t.select("symbol", "timestamp", lo.alias("lo"), hi.alias("hi"), share.alias("buy"), F.explode(F.sequence(first, last)).alias("bucket"))
    vol = F.least(F.col("hi"), (F.col("bucket") + 1) * size) - F.greatest(F.col("lo"), F.col("bucket") * size)
    out = parts.withColumn("v", vol).groupBy("symbol", "bucket").agg(
        F.max("timestamp").alias("timestamp"),
        F.sum(F.col("v") * F.col("buy")).alias("buy_volume"),
        F.sum(F.col("v") * (1 - F.col("buy"))).alias("sell_volume"),
    )
    return out.filter(F.col("buy_volume") + F.col("sell_volume") >= size * (1 - 1e-9))


def vpin(buckets: DataFrame, window: int = 50, chunk: int = 65_536) -> DataFrame:
    """Share of one-sided volume over the last buckets, toxicity level and size multiplier.

    The bucket number is already a dense index, so chunks need no further index."""
    s = Ordered(order=("bucket",), chunk_rows=chunk)

    def fn(t: DataFrame) -> DataFrame:
        w = s.trailing(window)
        total = F.sum(F.col("buy_volume") + F.col("sell_volume")).over(w)
        imbalance = F.sum(F.abs(F.col("buy_volume") - F.col("sell_volume"))).over(w)
        return t.withColumn("vpin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(imbalance, total, 0.0)))).withColumn(
            "buy_volume_pct", ratio(F.sum("buy_volume").over(w), total, 0.5)
        ).withColumn("n_buckets", F.count(F.lit(1)).over(w))

    out = s.windowed(buckets.withColumn(INDEX, F.col("bucket")), window, fn)
    return out.withColumn("toxicity", toxicity(F.col("vpin"))).withColumn("size_multiplier", toxicity(F.col("vpin"), True))


def toxicity(v: Column, multiplier: bool = False) -> Column:
    j = 2 if multiplier else 1
    return pick([(v >= t[0], t[j]) for t in TOXICITY], TOXICITY_LOW[1 if multiplier else 0])


def adv_bucket_size(daily_volume: DataFrame, default: float = 1000.0, per_day: int = 50, alpha: float = 0.1) -> DataFrame:
    """Bucket size after each day: exponential approach to (daily volume / per_day).

    One row per symbol and day, so the series is short; zero-volume days change nothing."""
    from ..plans.recursion import decay

    d = daily_volume.filter(F.col("volume") > 0)
    s = Ordered(order=("timestamp",), bucket_seconds=86_400 * 366)
    d = decay(s.running(d), s, 1 - alpha, {"_x": F.lit(alpha) * F.col("volume") / per_day})
    decayed = F.lit(default) * F.pow(F.lit(1 - alpha), F.col(INDEX) + 1)
    return d.withColumn("bucket_size", F.col("_x") + decayed).drop("_x", INDEX)
