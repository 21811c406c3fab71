"""Technical indicators on bars. Recursive averages use the block form of plans.recursion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, pick, ratio
from ..plans.ordered import INDEX, Ordered
from ..plans.recursion import decay


def _spec(keys: Sequence[str]) -> Ordered:
    return Ordered(keys=tuple(keys), order=("timestamp",))


def indexed(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Dense bar number per series (bars are bounded by the calendar)."""
    if INDEX in bars.columns:
        return bars
    return bars.withColumn(INDEX, F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")) - 1)


def smoothed(
    bars: DataFrame, terms: Mapping[str, Column], alpha: float, period: int, keys: Sequence[str], first: int = 0
) -> DataFrame:
    """Exponential averages seeded with the mean of the first ``period`` terms (from row ``first``)."""
    df = indexed(bars, keys)
    w = Window.partitionBy(*keys).orderBy(INDEX)
    seed_at = first + period - 1
    i = F.col(INDEX)
    for n, e in terms.items():
        df = df.withColumn(f"_z{n}", e)
    for n in terms:
        mean = F.avg(f"_z{n}").over(w.rowsBetween(-(period - 1), 0))
        df = df.withColumn(f"_y{n}", F.when(i < seed_at, 0.0).when(i == seed_at, mean).otherwise(F.lit(alpha) * F.col(f"_z{n}")))
    df = df.drop(*[f"_z{n}" for n in terms])
    df = decay(df, _spec(keys), 1 - alpha, {n: F.col(f"_y{n}") for n in terms})
    for n in terms:
        df = df.withColumn(n, F.when(F.col(INDEX) >= seed_at, F.col(n)))
    return df.drop(*[f"_y{n}" for n in terms])


def ema(bars: DataFrame, period: int, out: str | None = None, price: str = "close", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return smoothed(bars, {out or f"ema_{period}": F.col(price)}, 2.0 / (period + 1.0), period, keys)


def rsi(bars: DataFrame, period: int = 14, out: str = "rsi", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Relative strength with Wilder smoothing; 100 when there was no loss."""
    df = indexed(bars, keys)
    change = F.col("close") - F.lag("close").over(Window.partitionBy(*keys).orderBy(INDEX))
    df = df.withColumn("_ch", change)
    up, down = F.greatest(F.col("_ch"), F.lit(0.0)), F.greatest(-F.col("_ch"), F.lit(0.0))
    df = smoothed(df, {"_up": up, "_dn": down}, 1.0 / period, period, keys, first=1)
    value = F.when(F.col("_dn") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(F.col("_up"), F.col("_dn"))))
    return df.withColumn(out, F.when(F.col(INDEX) >= period, value)).drop("_ch", "_up", "_dn")


def atr(bars: DataFrame, period: int = 14, out: str = "atr", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    df = indexed(bars, keys)
    prev = F.lag("close").over(Window.partitionBy(*keys).orderBy(INDEX))
    df = df.withColumn("_pc", prev)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    df = df.withColumn("_tr", F.when(F.col("_pc").isNotNull(), tr))
    return smoothed(df, {out: F.col("_tr")}, 1.0 / period, period, keys, first=1).drop("_pc", "_tr")


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bands and the squeeze flag (band width at its minimum over six bars)."""
    df = indexed(bars, keys)
    w = Window.partitionBy(*keys).orderBy(INDEX)
    near = w.rowsBetween(-(period - 1), 0)
    full = F.col(INDEX) >= period - 1
    df = df.withColumn("bb_middle", F.when(full, F.avg("close").over(near))).withColumn(
        "_sd", F.when(full, F.stddev_samp("close").over(near))
    )
    return (
        df.withColumn("bb_upper", F.col("bb_middle") + width * F.col("_sd"))
        .withColumn("bb_lower", F.col("bb_middle") - width * F.col("_sd"))
        .withColumn("bb_squeeze", (F.col(INDEX) >= period + 5) & (F.col("_sd") <= F.min("_sd").over(w.rowsBetween(-5, 0))))
        .drop("_sd")
    )


def _rsi_of(closes: Column, period: int = 14) -> Column:
    """Relative strength of a short array of closes (oldest first); null when too short."""
    moves = F.zip_with(F.slice(closes, F.lit(2), F.greatest(F.size(closes) - 1, F.lit(0))), closes, lambda b, a: b - a)
    moves = F.filter(moves, lambda m: m.isNotNull())

    def wilder(side):
        g = F.transform(moves, lambda m: F.greatest(side * m, F.lit(0.0)))
        seed = F.aggregate(F.slice(g, 1, period), F.lit(0.0), lambda acc, x: acc + x) / period
        rest = F.slice(g, F.lit(period + 1), F.greatest(F.size(g) - period, F.lit(0)))
        return F.aggregate(rest, seed, lambda acc, x: (acc * (period - 1) + x) / period)

    up, down = wilder(F.lit(1.0)), wilder(F.lit(-1.0))
    value = F.when(down == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + ratio(up, down)))
    return F.when(F.size(closes) >= period + 1, value)


def rsi_divergence(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Disagreement between price and strength over two halves of the last 42 bars."""
    df = indexed(bars, keys)
    w = Window.partitionBy(*keys).orderBy(INDEX).rowsBetween(-41, 0)
    df = df.withColumn("_a", F.collect_list("close").over(w))
    a = F.col("_a")
    mid = F.floor(F.size(a) / 2).cast("int")
    older = F.slice(a, F.lit(1), F.greatest(mid, F.lit(1)))
    newer = F.slice(a, mid + 1, F.size(a) - mid)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    df = df.withColumn("_ro", _rsi_of(older)).withColumn("_rn", _rsi_of(a)).withColumn("_pu", mean(newer) > mean(older))
    ok = (F.size(a) >= 28) & F.col("_ro").isNotNull() & F.col("_rn").isNotNull()
    ru = F.col("_rn") > F.col("_ro")
    kind = F.when(ok & ~F.col("_pu") & ru, "bullish").when(ok & F.col("_pu") & ~ru, "bearish")
    return df.withColumn("rsi_divergence", kind).drop("_a", "_ro", "_rn", "_pu")


def band_score(price: Column, upper: Column, lower: Column, bandwidth_pct: Column | None = None) -> Column:
    """+1/-1 at or beyond a band, +-0.5 near it, 0 inside; stronger when the band width is in its lowest fifth."""
    width = upper - lower
    pos = (price - lower) / F.when(width != 0, width)
    base = pick([(pos <= 0, 1.0), (pos >= 1, -1.0), (pos < 0.2, 0.5), (pos > 0.8, -0.5)], 0.0)
    boost = F.lit(1.0) if bandwidth_pct is None else F.when(bandwidth_pct < 20, 1.3).otherwise(1.0)
    return F.when(upper.isNull() | lower.isNull() | (width == 0), F.lit(0.0)).otherwise(clamp(base * boost, -1.0, 1.0))


def trend_regime(bars: DataFrame, fast: int = 20, slow: int = 50, margin: float = 0.001, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    df = ema(ema(bars, fast, "_f", keys=keys), slow, "_s", keys=keys)
    kind = pick(
        [(F.col("_f") > F.col("_s") * (1 + margin), "trending_up"), (F.col("_f") < F.col("_s") * (1 - margin), "trending_down")],
        "ranging",
    )
    return df.withColumn("trend", F.when(F.col("_s").isNull(), "ranging").otherwise(kind)).drop("_f", "_s")


def monotone_trend(df: DataFrame, value: str, readings: int = 5, out: str = "trend", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """'rising'/'falling' when the last ``readings`` values are strictly monotone."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    last = w.rowsBetween(-(readings - 2), 0)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    full = F.count("_d").over(last) == readings - 1
    lo, hi = F.min("_d").over(last), F.max("_d").over(last)
    return d.withColumn(out, F.when(full & (lo > 0), "rising").when(full & (hi < 0), "falling")).drop("_d")


def vote_score(fast_1m: Column, slow_1m: Column, fast_15m: Column, slow_15m: Column, above_vwap: Column) -> Column:
    """Three votes (1m trend, 15m trend, side of the average price): +-1 unanimous, +-0.5 two to one."""
    up = lambda c: F.when(c, 1).otherwise(0)
    n = up(fast_1m > slow_1m) + up(fast_15m > slow_15m) + up(above_vwap)
    return pick([(n == 3, 1.0), (n == 2, 0.5), (n == 1, -0.5)], -1.0)


def alignment_share(stances: DataFrame, keys: Sequence[str] = ("symbol",), direction: str = "direction", target: str = "target") -> DataFrame:
    """Share of the five standard timeframes whose stance agrees with the target direction."""
    tfs = ["1d", "4h", "1h", "15m", "5m"]  # fixed values
    s = stances.filter(F.col("timeframe").isin(tfs))
    return s.groupBy(*keys, target).agg(F.avg((F.col(direction) == F.col(target)).cast("double")).alias("alignment"))


def timeframe_bars(ticks: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Bars of several sizes in one long table (symbol, timeframe, timestamp, ...)."""
    from .bars import resample_many

    return resample_many(ticks, tuple(sizes), keep_last=None)
