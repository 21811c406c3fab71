"""Bars from ticks, and volume/price histograms over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import order_key

# Bar sizes in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def _ohlcv() -> list[Column]:
    k = order_key("timestamp", "seq")
    return [
        F.min_by("price", k).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", k).alias("close"),
        F.sum("quantity").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
    ]


def _floor(seconds: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col("timestamp")) / seconds) * seconds)


def resample(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLCV per (symbol, interval); intervals without ticks do not appear."""
    return ticks.groupBy("symbol", _floor(F.lit(seconds)).alias("bar_time")).agg(*_ohlcv()).withColumnRenamed(
        "bar_time", "timestamp"
    )


def resample_many(ticks: DataFrame, timeframes: Sequence[str] = tuple(TIMEFRAMES), keep_last: int | None = None) -> DataFrame:
    """All timeframes, built from the finest up: each coarser bar aggregates finer bars, not ticks. ``keep_last`` bars for each
    symbol and timeframe, all by default."""
    tfs = sorted(timeframes, key=TIMEFRAMES.get)
    fine = resample(ticks, TIMEFRAMES[tfs[0]])
    if any(TIMEFRAMES[t] % TIMEFRAMES[tfs[0]] for t in tfs):
        raise ValueError("timeframes must be multiples of the finest")
    frames = F.explode(F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(TIMEFRAMES[t]).alias("s")) for t in tfs]))
    out = (
        fine.withColumn("_f", frames)
        .groupBy("symbol", F.col("_f.tf").alias("timeframe"), _floor(F.col("_f.s")).alias("bar_time"))
        .agg(
            F.min_by("open", "timestamp").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "timestamp").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("trade_count").alias("trade_count"),
        )
        .withColumnRenamed("bar_time", "timestamp")
    )
    return last_per_key(out, ("symbol", "timeframe"), ("timestamp",), keep_last) if keep_last else out


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Keep the last ``n`` rows per key (the rank filter is applied before the shuffle where it can)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def volume_profile(bars: DataFrame, bins: int = 50, area: float = 0.70) -> DataFrame:
    """Point of control and value area per symbol from equal-width bins of (high+low)/2."""
    b = bars.select("symbol", ((F.col("high") + F.col("low")) / 2).alias("p"), "volume")
    rng = b.groupBy("symbol").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    # An edge value belongs to the bin below it.
    idx = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col("p") - F.col("lo")) / width) - 1))
    hist = (
        b.join(rng, "symbol")
        .withColumn("bin", F.when(F.col("hi") > F.col("lo"), idx).otherwise(F.lit(0)).cast("int"))
        .groupBy("symbol", "lo", "hi", "bin")
        .agg(F.sum("volume").alias("v"))
    )
    center = F.when(
        F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + F.lit(0.5)) * (F.col("hi") - F.col("lo")) / bins
    ).otherwise(F.col("lo"))
    by_volume = Window.partitionBy("symbol").orderBy(F.desc("v"), F.desc("bin"))
    ranked = hist.select(
        "symbol",
        "bin",
        "v",
        center.alias("center"),
        F.sum("v").over(by_volume.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.sum("v").over(Window.partitionBy("symbol")).alias("total"),
    )
    inside = F.coalesce(F.col("above"), F.lit(0.0)) < F.col("total") * area
    poc = F.max_by("center", F.struct(F.col("v"), -F.col("bin")))
    return ranked.groupBy("symbol").agg(
        poc.alias("poc"),
        F.coalesce(F.max(F.when(inside, F.col("center"))), poc).alias("vah"),
        F.coalesce(F.min(F.when(inside, F.col("center"))), poc).alias("val"),
    )


def price_clusters(df: DataFrame, price: str = "close") -> DataFrame:
    """Strict local maxima of the price histogram per symbol; min(50, max(10, n/5)) bins."""
    stat = df.groupBy("symbol").agg(F.count(price).alias("n"), F.min(price).alias("lo"), F.max(price).alias("hi"))
    stat = stat.filter(F.col("n") >= 10).withColumn(
        "bins", F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("n") / 5))).cast("int")
    )
    # A constant series is centred in a range of width one.
    flat = F.col("lo") == F.col("hi")
    stat = stat.withColumn("a", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn(
        "width", F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    )
    bin_ = F.least(F.floor((F.col(price) - F.col("a")) / F.col("width") * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = (
        df.select("symbol", price)
        .join(stat, "symbol")
        .groupBy("symbol", bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    grid = stat.select("symbol", "a", "width", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    full = grid.join(counts, ["symbol", "bin"], "left").fillna(0, ["cnt"])
    w = Window.partitionBy("symbol").orderBy("bin")
    full = full.withColumn("_l", F.lag("cnt").over(w)).withColumn("_r", F.lead("cnt").over(w))
    peak = full.filter((F.col("cnt") > F.col("_l")) & (F.col("cnt") > F.col("_r")))
    return peak.select(
        "symbol", "bin", "cnt", (F.col("a") + (F.col("bin") + 0.5) * F.col("width") / F.col("bins")).alias("center")
    )


def liquidation_ladder(ticks: DataFrame, last: int = 200, min_rows: int = 20) -> DataFrame:
    """Price levels at 0.5..2.5 sample deviations of the last ``last`` prices around the last price."""
    steps = (0.5, 1.0, 1.5, 2.0, 2.5)
    recent = last_per_key(ticks.select("symbol", "timestamp", "seq", "price"), ("symbol",), ("timestamp", "seq"), last)
    s = recent.groupBy("symbol").agg(
        F.max_by("price", F.struct("timestamp", "seq")).alias("p"),
        F.stddev_samp("price").alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    lv = s.filter(F.col("n") >= min_rows).select("symbol", "p", "sd", F.explode(F.array(*[F.lit(x) for x in steps])).alias("m"))
    out = lv.select(
        "symbol",
        F.col("m").alias("multiple"),
        F.explode(
            F.array(
                F.struct(F.lit("longs").alias("side"), (F.col("p") - F.col("m") * F.col("sd")).alias("level")),
                F.struct(F.lit("shorts").alias("side"), (F.col("p") + F.col("m") * F.col("sd")).alias("level")),
            )
        ).alias("x"),
    )
    return out.select("symbol", "multiple", "x.side", "x.level").filter((F.col("side") == "shorts") | (F.col("level") > 0))
