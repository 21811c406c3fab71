"""Aggregates over trade records and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..functions.sessions import asset_class
from ..plans.ordered import INDEX, Ordered

TRADES = Ordered(keys=("strategy_id",), order=("exit_time", "trade_id"), time="exit_time", bucket_seconds=86_400)


def _won() -> Column:
    return (F.col("net_pnl") > 0).cast("double")


def group_stats(trades: DataFrame, dims: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, win rate, mean and total result per key and value of each dimension, all in one pass."""
    t = trades.select(*keys, "net_pnl", *[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dims])
    g = t.groupingSets([[*[F.col(k) for k in keys], F.col(d)] for d in dims], *[F.col(c) for c in (*keys, *dims)]).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(_won()).alias("win_rate"), F.avg("net_pnl").alias("avg_pnl"), F.sum("net_pnl").alias("total_pnl")
    )
    name = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    return g.select(*keys, name.alias("dimension"), F.coalesce(*[F.col(d) for d in dims]).alias("label"), "trade_count", "win_rate", "avg_pnl", "total_pnl")


def best_configurations(trades: DataFrame, dims: Sequence[str], k: int = 3) -> DataFrame:
    """Combinations with the highest mean over deviation (0 where the deviation is 0)."""
    g = trades.groupBy(*dims).agg(F.avg("net_pnl").alias("m"), F.stddev_samp("net_pnl").alias("s"))
    score = F.when(F.col("s") > 0, F.col("m") / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0)
    return g.select(*dims, score.alias("sharpe")).orderBy(F.desc("sharpe"), *dims).limit(k)


def win_loss(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Win rate, profit factor (infinite without losses), mean win and loss."""
    p = F.col("net_pnl")
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.avg(_won()).alias("win_rate"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_w"),
        F.coalesce(-F.sum(F.when(p < 0, p)), F.lit(0.0)).alias("_l"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(-F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
    )
    pf = F.when(F.col("_l") == 0, F.when(F.col("_w") > 0, float("inf")).otherwise(0.0)).otherwise(ratio(F.col("_w"), F.col("_l")))
    return g.withColumn("profit_factor", pf).drop("_w", "_l")


def concentration(group_totals: DataFrame, keys: Sequence[str] = (), value: str = "total_pnl") -> DataFrame:
    """Sum of squared shares of |value|."""
    g = group_totals.groupBy(*keys).agg(F.sum(F.abs(value)).alias("a"), F.sum(F.col(value) * F.col(value)).alias("b"))
    return g.select(*keys, ratio(F.col("b"), F.col("a") * F.col("a"), 0.0).alias("hhi"))


def kelly_inputs(trades: DataFrame, key: str = "symbol", last: int = 50, minimum: int = 5) -> DataFrame:
    """Win rate and reward-to-risk over the last trades per key; 1.5 without losses.

    The rank filter runs per key; Spark trims each partition before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("exit_time"), F.desc("trade_id"))
    t = trades.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    pct = F.abs(F.col("exit_price") / F.col("entry_price") - 1)
    won = F.col("net_pnl") > 0
    g = t.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(_won()).alias("win_rate"),
        F.coalesce(F.avg(F.when(won, pct)), F.lit(0.0)).alias("w"),
        F.coalesce(F.avg(F.when(~won, pct)), F.lit(0.0)).alias("l"),
    )
    return g.filter(F.col("n_trades") >= minimum).select(key, "n_trades", "win_rate", ratio(F.col("w"), F.col("l"), 1.5).alias("avg_rr"))


def realized(trades: DataFrame, keys: Sequence[str] = (), day: Column | None = None) -> DataFrame:
    """Realized result and trade count, optionally of one UTC day."""
    t = trades if day is None else trades.filter((F.col("exit_time") >= day) & (F.col("exit_time") < day + F.expr("INTERVAL 1 DAY")))
    return t.groupBy(*keys).agg(F.sum("net_pnl").alias("realized_pnl"), F.count(F.lit(1)).alias("trade_count"))


def open_positions(records: DataFrame) -> DataFrame:
    """Valid positions from loosely typed records (symbol, size, entry_price, entry, asset_class as text)."""
    size = F.abs(F.col("size").try_cast("double"))
    entry = F.coalesce(F.col("entry_price"), F.col("entry")).try_cast("double")
    p = records.select("symbol", size.alias("size"), entry.alias("entry_price"), asset_class(F.col("symbol"), F.col("asset_class")).alias("asset_class"))
    return p.filter((F.col("size") > 0) & (F.col("entry_price") > 0))


def unrealized(positions: DataFrame, prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Open result at the latest prices; positions without price, entry or size do not count."""
    p = positions.filter((F.col("entry_price") > 0) & (F.col("size") > 0))
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    j = p.join(prices.select("symbol", F.col("price").alias("_last")), "symbol")
    return j.groupBy(*keys).agg(F.sum((F.col("_last") - F.col("entry_price")) * F.col("size") * sign).alias("unrealized_pnl"))


def exposure(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return positions.groupBy(*keys).agg(F.sum(F.col("size") * F.col("entry_price")).alias("exposure"), F.count(F.lit(1)).alias("n_positions"))


def rolling_win_rate(trades: DataFrame, window: int = 50, baseline: float | None = None, s: Ordered = TRADES) -> DataFrame:
    """Win rate over the last trades after each trade, and drift flags against the baseline.

    Without a fixed ``baseline`` the win rate of the whole series is used."""

    def fn(t: DataFrame) -> DataFrame:
        return t.withColumn("win_rate", F.avg(_won()).over(s.trailing(window)))

    t = s.windowed(trades, window, fn, keep_index=True)
    if baseline is None:
        t = t.join(trades.groupBy(*s.keys).agg(F.avg(_won()).alias("baseline")), list(s.keys))
    else:
        t = t.withColumn("baseline", F.lit(baseline))
    drop = F.col("baseline") - F.col("win_rate")
    return (
        t.withColumn("relative_drift", (F.col(INDEX) >= window - 1) & (ratio(drop, F.col("baseline"), 0.0) >= 0.10))
        .withColumn("absolute_drift", drop > 0.10)
        .drop(INDEX)
    )


def outcome_correlation(signals: DataFrame, trades: DataFrame, key: str = "trade_id", keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of predicted strength with the result, joined by trade."""
    j = signals.select(key, F.col("strength").alias("_s")).join(trades.select(key, *keys, "net_pnl"), key)
    g = j.groupBy(*keys).agg(F.covar_pop("_s", "net_pnl").alias("c"), F.stddev_pop("_s").alias("a"), F.stddev_pop("net_pnl").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "n", F.when(F.col("n") < 2, 0.0).otherwise(ratio(F.col("c"), F.col("a") * F.col("b"))).alias("correlation"))


def unique_trades(trades: DataFrame) -> DataFrame:
    """First occurrence per trade id."""
    return trades.dropDuplicates(["trade_id"])


def placed(trades: DataFrame, s: Ordered = TRADES) -> DataFrame:
    """Trades with their number in the series and the running sum ``_cum`` of their returns on the notional."""
    notional = F.abs(F.col("entry_price") * F.col("size"))
    return s.running(trades.withColumn("_ret", ratio(F.col("net_pnl"), notional, 0.0)), {"_cum": F.col("_ret")}).drop("_ret")


def decay_half_life(trades: DataFrame, minimum: int = 10, s: Ordered = TRADES) -> DataFrame:
    """Half-life in days of the rolling mean trade return, from a log-linear fit on its positive part.

    The window is a tenth of the series, so it can exceed any fixed halo: rolling means come from
    running sums looked up ``window`` rows back by an equi join on the dense index. Trades may come :func:`placed`."""
    keys = list(s.keys)
    run = (trades if INDEX in trades.columns else placed(trades, s)).select(*keys, INDEX, "_cum")
    stat = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("exit_time").alias("a"), F.max("exit_time").alias("b"))
    stat = stat.withColumn("win", F.greatest(F.lit(3), F.floor(F.col("n") / 10)))
    r = run.join(stat, keys)
    old = run.select(*keys, F.col(INDEX).alias("_j"), F.col("_cum").alias("_before"))
    r = r.filter(F.col(INDEX) >= F.col("win") - 1).withColumn("_j", F.col(INDEX) - F.col("win"))
    r = r.join(old, [*keys, "_j"], "left")
    edge = (F.col("_cum") - F.coalesce("_before", F.lit(0.0))) / F.col("win")
    r = r.withColumn("_x", (F.col(INDEX) - F.col("win") + 1).cast("double")).withColumn("_e", edge).filter(F.col("_e") > 0)
    r = r.withColumn("_y", F.log("_e"))
    g = r.groupBy(*keys, "n", "a", "b").agg(
        F.regr_slope("_y", "_x").alias("k"), F.regr_r2("_y", "_x").alias("r2"), F.count(F.lit(1)).alias("m")
    )
    days = (F.unix_micros("b") - F.unix_micros("a")) / 1e6 / 86_400
    hl = F.lit(0.6931471805599453) / F.when(F.col("k") < 0, -F.col("k")) * days / F.greatest(F.col("n") - 1, F.lit(1))
    ok = (F.col("n") >= minimum) & (F.col("m") >= 3) & (F.col("r2") >= 0.3) & (days > 0)
    return stat.select(*keys).join(g.select(*keys, F.when(ok, hl).alias("half_life_days")), keys, "left")
