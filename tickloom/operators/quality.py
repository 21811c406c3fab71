"""Data-quality checks: every row carries an array of issues; reports and splits derive from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..plans.ordered import INDEX, TICKS, Ordered
from ..plans.sliding import Frame, sliding

# Thresholds of the checks.
OUTLIER_WARN, OUTLIER_FAIL, OUTLIER_WINDOW = 4.0, 8.0, 100
STALE_SECONDS = {"crypto": 300, "equity": 900}
STALE_OTHER = 93_600
SPIKE_FACTOR, SPIKE_LOOKBACK = 10.0, 20
SPREAD_MAX, GAP_FACTOR, FUTURE_SECONDS, MIN_YEAR = 0.50, 1.5, 60, 2000
BAR_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800, "1M": 2592000}


def _issue(when: Column, kind: str, severity: str | Column, shown: bool = True, **details: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    body = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details and shown else F.lit("{}")
    return F.when(when, F.struct(F.lit(kind).alias("check_type"), sev.alias("severity"), body.alias("details")))


def weekend_between(a: Column, b: Column) -> Column:
    """True when stepping day by day from a towards b meets a weekend day, or b is one."""
    steps = F.ceil((F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400e6))
    return (F.weekday(a) + steps - 1 >= 5) | (F.weekday(b) >= 5)


def _time_issues(time: Column, as_of: Column, shown: bool = True) -> list[Column]:
    future = F.unix_micros(time) > F.unix_micros(as_of) + FUTURE_SECONDS * 1_000_000
    early = F.year(time) < MIN_YEAR
    unlisted = F.to_date(time) < F.col("listing_date")
    return [
        _issue(future, "timestamp_future", "FAIL"),
        _issue(~future & early, "timestamp_epoch", "FAIL", shown, year=F.year(time)),
        _issue(~future & ~early & F.coalesce(unlisted, F.lit(False)), "timestamp_pre_listing", "FAIL", shown, listing_date=F.col("listing_date").cast("string")),
    ]


def _outlier_issue(value: str, shown: bool = True) -> Column:
    """From columns _m and _sd of the previous rows and _n, their number."""
    full = F.col("_n") == OUTLIER_WINDOW
    dev = F.abs(F.col(value) - F.col("_m"))
    flat = F.col("_sd") == 0
    z = F.when(flat, F.when(dev != 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(ratio(dev, F.col("_sd")))
    sev = F.when(z > OUTLIER_FAIL, "FAIL").otherwise("WARN")
    return _issue(full & (z > OUTLIER_WARN), "outlier", sev, shown, z_score=F.round(z, 4))


def flag_bars(bars: DataFrame, assets: DataFrame, bar_size: str, as_of: Column, allow_negative: bool = False, details: bool = True) -> DataFrame:
    """Bars (symbol, timestamp, OHLCV) with ``issues``; ``assets`` gives asset_class and listing_date per symbol. Without ``details``
    (JSON for each issue) they are empty."""
    b = bars.join(assets.select("symbol", "asset_class", "listing_date"), "symbol", "left")
    w = Window.partitionBy("symbol").orderBy("timestamp")
    b = b.withColumns({"_at": F.row_number().over(w), "_prev": F.lag("timestamp").over(w)})
    b = sliding(b, "_at", {"_c": Frame("close", OUTLIER_WINDOW, 1), "_s": Frame("volume", SPIKE_LOOKBACK, 1)})
    b = b.withColumnsRenamed({"_c_m": "_m", "_c_sd": "_sd", "_c_n": "_n", "_s_m": "_v"}).drop("_at", "_s_n", "_s_sd")
    t = F.col("timestamp")
    step = (F.unix_micros(t) - F.unix_micros("_prev")) / 1e6
    expected = BAR_SECONDS[bar_size]
    weekend = (F.col("asset_class") == "equity") & weekend_between(F.col("_prev"), t)
    mid = (F.col("high") + F.col("low")) / 2
    spread = ratio(F.col("high") - F.col("low"), F.when(mid > 0, mid))
    v = F.col("volume")
    nonpos = (F.col("close") <= 0) & (F.coalesce(F.col("asset_class"), F.lit("")) != "future") & F.lit(not allow_negative)
    issues = [
        _issue(F.coalesce((step > expected * GAP_FACTOR) & ~F.coalesce(weekend, F.lit(False)), F.lit(False)), "gap", "WARN", details, expected_seconds=F.lit(expected), actual_seconds=step),
        _outlier_issue("close", details),
        _issue(nonpos, "price_non_positive", "FAIL", details, close=F.col("close")),
        _issue(F.col("high") < F.col("low"), "price_high_lt_low", "WARN"),
        _issue((F.col("close") > F.col("high")) | (F.col("close") < F.col("low")), "price_close_outside_range", "WARN"),
        _issue(F.coalesce(spread > SPREAD_MAX, F.lit(False)), "price_excessive_spread", "WARN", details, spread_pct=F.round(spread, 4)),
        *_time_issues(t, as_of, details),
        _issue(v < 0, "volume_negative", "FAIL"),
        _issue(v == 0, "volume_zero", "WARN"),
        _issue(F.coalesce((v > 0) & (F.col("_v") > 0) & (v > F.col("_v") * SPIKE_FACTOR), F.lit(False)), "volume_spike", "WARN", details, average=F.round("_v", 2)),
    ]
    return b.withColumn("issues", F.array_compact(F.array(*issues))).drop("_prev", "_m", "_sd", "_n", "_v")


def flag_ticks(ticks: DataFrame, assets: DataFrame, as_of: Column, allow_negative: bool = False, s: Ordered = TICKS) -> DataFrame:
    """Ticks (symbol, timestamp, seq, price, quantity) with ``issues``; outliers look at the previous 100."""

    def fn(t: DataFrame) -> DataFrame:
        w = s.past(OUTLIER_WINDOW)
        return t.withColumns({"_m": F.avg("price").over(w), "_sd": F.stddev_pop("price").over(w), "_n": F.count("price").over(w)})

    t = s.windowed(ticks, OUTLIER_WINDOW, fn).join(assets.select("symbol", "asset_class", "listing_date"), "symbol", "left")
    nonpos = (F.col("price") <= 0) & (F.coalesce(F.col("asset_class"), F.lit("")) != "future") & F.lit(not allow_negative)
    issues = [
        _outlier_issue("price"),
        _issue(nonpos, "price_non_positive", "FAIL"),
        *_time_issues(F.col("timestamp"), as_of),
        _issue(F.col("quantity") < 0, "quantity_negative", "FAIL"),
    ]
    return t.withColumn("issues", F.array_compact(F.array(*issues))).drop("_m", "_sd", "_n")


def issue_table(flagged: DataFrame) -> DataFrame:
    return flagged.select("symbol", "timestamp", F.explode("issues").alias("i")).select("symbol", "timestamp", "i.check_type", "i.severity", "i.details")


def with_status(flagged: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL per row; an issue counts for every row of its symbol at its time."""
    level = F.when(F.exists("issues", lambda i: i.severity == "FAIL"), 2).when(F.size("issues") > 0, 1).otherwise(0)
    worst = F.max("_lv").over(Window.partitionBy("symbol", "timestamp"))
    out = flagged.withColumn("_lv", level).withColumn("_w", worst)
    return out.withColumn("status", F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("_w") + 1)).drop("_lv", "_w")


def clean(flagged: DataFrame) -> DataFrame:
    return with_status(flagged).filter("status <> 'FAIL'").drop("issues", "status")


def rejected(flagged: DataFrame) -> DataFrame:
    return with_status(flagged).filter("status = 'FAIL'")


def quality_report(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = with_status(flagged).groupBy(*keys)
    return g.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warnings"), ("FAIL", "failures"))],
        F.avg((F.col("status") == "PASS").cast("double")).alias("pass_rate"),
    )


def staleness(rows: DataFrame, assets: DataFrame, as_of: Column) -> DataFrame:
    """Assets whose newest row is older than their class allows."""
    last = rows.groupBy("symbol").agg(F.max("timestamp").alias("last_timestamp")).join(assets.select("symbol", "asset_class"), "symbol", "left")
    limit = F.lit(STALE_OTHER)
    for k, v in STALE_SECONDS.items():
        limit = F.when(F.col("asset_class") == k, v).otherwise(limit)
    age = (F.unix_micros(as_of) - F.unix_micros("last_timestamp")) / 1e6
    return last.select("symbol", "last_timestamp", age.alias("age_seconds"), limit.alias("threshold_seconds")).filter(
        F.col("age_seconds") > F.col("threshold_seconds")
    )


def coverage_gaps(rows: DataFrame, expected_seconds: float, start: Column, end: Column, expected: DataFrame | None = None) -> DataFrame:
    """Gaps longer than 1.5 intervals within [start, end], including head and tail.

    ``expected`` (symbol) adds symbols without any row: their whole range is one gap if longer than one interval."""
    limit = expected_seconds * GAP_FACTOR
    span = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    w = Window.partitionBy("symbol").orderBy("timestamp")
    r = rows.select("symbol", "timestamp").withColumn("prev", F.lag("timestamp").over(w)).withColumn("next", F.lead("timestamp").over(w))
    t = F.col("timestamp")
    cand = F.array(
        F.struct(F.coalesce(F.col("prev"), start).alias("gap_start"), t.alias("gap_end")),
        F.when(F.col("next").isNull(), F.struct(t.alias("gap_start"), end.alias("gap_end"))),
    )
    g = r.select("symbol", F.explode(F.array_compact(cand)).alias("g")).select("symbol", "g.gap_start", "g.gap_end")
    g = g.filter(span(F.col("gap_start"), F.col("gap_end")) > limit)
    if expected is not None:
        empty = expected.select("symbol").distinct().join(rows.select("symbol").distinct(), "symbol", "left_anti")
        empty = empty.select("symbol", start.alias("gap_start"), end.alias("gap_end"))
        g = g.unionByName(empty.filter(span(F.col("gap_start"), F.col("gap_end")) > expected_seconds))
    return g


def repeated_times(rows: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "timestamp") -> DataFrame:
    """Times that occur more than once in a series (order check for tables, which have no row order)."""
    return rows.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def feed_latency(rows: DataFrame, source: str, time: str) -> DataFrame:
    """Percentiles of the gaps between consecutive rows of a source.

    Gaps within a time bucket and across buckets come from the chunked order, so a busy source is split;
    the percentiles are taken from counts per gap in milliseconds."""
    s = Ordered(keys=(source,), order=(time,), time=time, bucket_seconds=3600)

    def fn(t: DataFrame) -> DataFrame:
        return t.withColumn("_g", F.unix_millis(time) - F.lag(F.unix_millis(time)).over(s.window()))

    g = s.windowed(rows.select(source, time), 1, fn).filter(F.col("_g").isNotNull())
    counts = g.groupBy(source, "_g").agg(F.count(F.lit(1)).alias("_f"))
    return counts.groupBy(source).agg(
        *[F.expr(f"percentile(_g, {p}, _f)").alias(f"p{int(p * 100)}_ms") for p in (0.5, 0.95, 0.99)], F.sum("_f").alias("n_gaps")
    )
