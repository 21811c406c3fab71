"""Event selection, barrier labels and sample weights on bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.spans import concurrency, span_sums


def threshold_events(signals: DataFrame, signal: str, threshold: float) -> DataFrame:
    """One long event per row whose signal exceeds the threshold."""
    return signals.filter(F.col(signal) > threshold).select("symbol", "timestamp", F.lit(1).cast("byte").alias("direction"))


def signal_violations(signals: DataFrame, signal: str) -> DataFrame:
    """Rows that make a signal series unusable: missing values and repeated timestamps, as counts."""
    bad = F.col(signal).isNull() | F.isnan(signal)
    per = signals.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("b"))
    return per.groupBy("symbol").agg(
        F.sum("b").alias("n_missing"), F.sum(F.col("n") - 1).alias("n_repeated_times"), F.sum("n").alias("n_rows")
    )


def barrier_labels(
    bars: DataFrame,
    upper: float = 2.0,
    lower: float = 1.0,
    horizon: int = 60,
    lookback: int = 20,
    side: Column | None = None,
) -> DataFrame:
    """Outcome of a position opened at every bar (with a full volatility window).

    Volatility is the deviation of the log returns among the ``lookback`` closes before the bar. The
    first of the next ``horizon`` closes at or beyond a barrier decides; the profit side is tested first.
    ``side`` is +1 (default) or -1. Frames are bounded by ``horizon``."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    b = bars.withColumn("_i", F.row_number().over(w) - 1)
    b = b.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    b = b.withColumn("sigma", F.when(F.col("_i") >= lookback, F.stddev_samp("_r").over(w.rowsBetween(-(lookback - 1), -1))))
    ahead = w.rowsBetween(1, horizon)
    b = b.withColumn("_p", F.collect_list("close").over(ahead)).withColumn("_t", F.collect_list("timestamp").over(ahead))
    b = b.withColumn("side", F.lit(1) if side is None else side).filter(F.col("sigma") > 0)
    long = F.col("side") == 1
    move = F.col("sigma") * F.col("close")
    target = F.when(long, F.col("close") + upper * move).otherwise(F.col("close") - lower * move)
    stop = F.when(long, F.col("close") - lower * move).otherwise(F.col("close") + upper * move)
    b = b.withColumn("_tp", target).withColumn("_sl", stop)
    up, dn = F.greatest("_tp", "_sl"), F.least("_tp", "_sl")
    b = b.withColumn("_up", up).withColumn("_dn", dn)
    hit = F.array_position(F.transform("_p", lambda x: (x >= F.col("_up")) | (x <= F.col("_dn"))), True)
    b = b.withColumn("_hit", hit.cast("int"))
    n = F.when(F.col("_hit") > 0, F.col("_hit")).otherwise(F.size("_p"))
    b = b.withColumn("holding_periods", n)
    at = F.when(F.col("holding_periods") > 0, F.col("holding_periods"))
    b = b.withColumn("exit_price", F.coalesce(F.try_element_at("_p", at), F.col("close")))
    b = b.withColumn("t1", F.coalesce(F.try_element_at("_t", at), F.col("timestamp")))
    won = F.when(long, F.col("exit_price") >= F.col("_tp")).otherwise(F.col("exit_price") <= F.col("_tp"))
    kind = F.when(F.col("_hit") == 0, "vertical").when(won, "upper").otherwise("lower")
    b = b.withColumn("barrier_hit", kind)
    label = F.when(kind == "upper", 1).when(kind == "lower", -1).otherwise(0)
    return b.select(
        "symbol",
        F.col("timestamp").alias("t0"),
        "t1",
        F.col("close").alias("entry_price"),
        "exit_price",
        label.cast("byte").alias("ternary_label"),
        (label == 1).cast("byte").alias("binary_target"),
        "barrier_hit",
        F.col("holding_periods").cast("int").alias("holding_periods"),
        "side",
        "sigma",
    )


def label_events(events: DataFrame, bars: DataFrame, **kw) -> DataFrame:
    """Labels of the given events (symbol, timestamp)."""
    e = events.select("symbol", F.col("timestamp").alias("t0"))
    return barrier_labels(bars, **kw).join(e, ["symbol", "t0"], "left_semi")


def event_violations(events: DataFrame, bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Events that cannot be labelled, with the reason: no bar at that time, or within the warm-up."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    b = bars.select("symbol", "timestamp", (F.row_number().over(w) - 1).alias("_i"))
    j = events.select("symbol", "timestamp").join(b, ["symbol", "timestamp"], "left")
    why = F.when(F.col("_i").isNull(), "orphan").when(F.col("_i") < lookback, "warm_up")
    return j.withColumn("reason", why).filter(F.col("reason").isNotNull()).drop("_i")


def label_diagnostics(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Class and barrier shares, holding-time quantiles (floor index), mean return per class, sanity flags.

    Quantiles come from the counts per holding time, which are few, instead of a sorted list."""
    keys = list(keys)
    share = lambda c: F.avg(c.cast("double"))
    ret = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")
    one = F.col("binary_target") == 1
    main = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        share(one).alias("binary_pct_one"),
        share(~one).alias("binary_pct_zero"),
        *[share(F.col("ternary_label") == v).alias(f"ternary_pct_{n}") for n, v in (("up", 1), ("flat", 0), ("down", -1))],
        *[share(F.col("barrier_hit") == v).alias(f"barrier_pct_{v}") for v in ("upper", "lower", "vertical")],
        F.min("holding_periods").alias("holding_min"),
        F.max("holding_periods").alias("holding_max"),
        F.coalesce(F.avg(F.when(one, ret)), F.lit(0.0)).alias("mean_return_label_one"),
        F.coalesce(F.avg(F.when(~one, ret)), F.lit(0.0)).alias("mean_return_label_zero"),
    )
    h = labels.groupBy(*keys, "holding_periods").agg(F.count(F.lit(1)).alias("c"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    h = h.withColumn("cum", F.sum("c").over(part.orderBy("holding_periods").rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("n", F.sum("c").over(part))
    q = lambda p, n: F.min(F.when(F.col("cum") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("holding_periods"))).cast("double").alias(n)
    qs = h.groupBy(*keys).agg(q(0.25, "holding_p25"), q(0.5, "holding_median"), q(0.75, "holding_p75"))
    out = main.join(qs, keys) if keys else main.crossJoin(qs)  # one row each
    return out.withColumn("sanity_label_one_positive", F.col("mean_return_label_one") > 0).withColumn(
        "sanity_label_zero_nonpositive", F.col("mean_return_label_zero") <= 0
    )


def sample_weights(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Uniqueness, return attribution and the combined weight (summing to the sample count per symbol)."""
    c = concurrency(labels, bars.select("symbol", "timestamp", "close"))
    lr = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("timestamp")))
    c = c.withColumn("_r", F.coalesce(lr, F.lit(0.0)))
    inv = F.when(F.col("concurrency") > 0, 1 / F.when(F.col("concurrency") > 0, F.col("concurrency")))
    s = span_sums(labels, c, {"_u": inv, "_a": F.col("_r") * inv})
    s = s.withColumn("uniqueness", F.col("_u") / F.col("n_bars")).withColumn("attribution", F.abs("_a"))
    s = s.withColumn("_w", F.col("uniqueness") * F.col("attribution"))
    tot = s.groupBy("symbol").agg(F.sum("_w").alias("_sw"), F.count(F.lit(1)).alias("_n"))
    s = s.join(tot, "symbol")
    w = F.when(F.col("_sw") > 0, F.col("_w") * F.col("_n") / F.when(F.col("_sw") > 0, F.col("_sw"))).otherwise(F.col("_w"))
    return s.withColumn("weight", w).drop("_u", "_a", "_w", "_sw", "_n")
