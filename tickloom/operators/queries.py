"""Range queries and lookups over stored tables. Filters stay on raw columns so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def time_range(df: DataFrame, start: str, end: str, time: str = "timestamp", limit: int | None = None, closed: bool = False, **equal) -> DataFrame:
    """Rows with start <= time < end (``closed``: <= end) and the given column values, in time order."""
    t = dict(df.dtypes)[time]
    lo, hi = F.lit(start).cast(t), F.lit(end).cast(t)
    out = df.filter((F.col(time) >= lo) & ((F.col(time) <= hi) if closed else (F.col(time) < hi)))
    for k, v in equal.items():
        if v is not None:
            out = out.filter(F.col(k) == F.lit(v))
    out = out.orderBy(time)
    return out.limit(limit) if limit else out


def upcoming(events: DataFrame, as_of: str, minutes: int, time: str = "scheduled_time") -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return events.filter((F.col(time) >= now) & (F.col(time) < now + F.make_dt_interval(mins=F.lit(minutes)))).orderBy(time)


def search_assets(assets: DataFrame, prefix: str = "", asset_class: str | None = None) -> DataFrame:
    """Case-insensitive prefix search."""
    out = assets.filter(F.upper("symbol").startswith(prefix.upper()))
    return out.filter(F.col("asset_class") == asset_class) if asset_class else out


def resolve(rows: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ("symbol", "exchange")) -> DataFrame:
    """Attach asset_id by natural key; unknown keys get null."""
    return rows.join(assets.select(*keys, "asset_id"), list(keys), "left")


def new_assets(rows: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ("symbol", "exchange")) -> DataFrame:
    """Natural keys without an asset yet, with a stable id derived from the key."""
    fresh = rows.select(*keys).distinct().join(assets, list(keys), "left_anti")
    return fresh.withColumn("asset_id", F.sha2(F.concat_ws("|", *keys), 256).substr(1, 32))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key of both tables; on equal versions the incoming row wins."""
    cols = current.columns
    both = current.withColumn("_in", F.lit(0)).unionByName(incoming.select(*cols).withColumn("_in", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_in"))).alias("_v"))
    return latest.select(*keys, "_v.*").select(*cols)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order`` (aggregated map-side, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def previous_value(series: DataFrame, seconds: int, keys: tuple[str, ...] = ("series_id",), value: str = "value") -> DataFrame:
    """Value at or before (time - seconds), else the oldest value of the series."""
    from ..plans.asof import asof_join

    left = series.withColumn("_at", F.timestamp_micros(F.unix_micros("timestamp") - seconds * 1_000_000))
    right = series.select(*keys, F.col("timestamp").alias("_rt"), F.col(value).alias("previous_value"))
    j = asof_join(left, right, keys, "_at", "_rt", ["previous_value"], strict=False)
    first = series.groupBy(*keys).agg(F.min_by(value, "timestamp").alias("_first"))
    j = j.join(first, list(keys))
    return j.withColumn("previous_value", F.coalesce("previous_value", "_first")).drop("_at", "_first")


def pair_lookup(pairs: DataFrame, matrix: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Correlation of unordered pairs (a, b); equal names count as 1, unknown pairs pass."""
    norm = lambda d: d.withColumn("_lo", F.least(F.upper("a"), F.upper("b"))).withColumn("_hi", F.greatest(F.upper("a"), F.upper("b")))
    m = norm(matrix).groupBy("_lo", "_hi").agg(F.max("correlation").alias("correlation"))
    j = norm(pairs).join(m, ["_lo", "_hi"], "left").drop("_lo", "_hi")
    rho = F.when(F.upper("a") == F.upper("b"), F.lit(1.0)).otherwise(F.col("correlation"))
    return j.withColumn("correlation", rho).withColumn("blocked", F.coalesce(rho > threshold, F.lit(False)))


def information_ratio(returns: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("symbol",), periods: float = 252.0) -> DataFrame:
    """Annualised mean over deviation of the return difference on common dates."""
    j = returns.select(*keys, "timestamp", F.col("ret").alias("_a")).join(benchmark.select("timestamp", F.col("ret").alias("_b")), "timestamp")
    d = F.col("_a") - F.col("_b")
    g = j.groupBy(*keys).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count(F.lit(1)).alias("n_obs"))
    ir = F.when(F.col("s") > 0, F.col("m") / F.when(F.col("s") > 0, F.col("s")) * (periods**0.5)).otherwise(0.0)
    return g.select(*keys, "n_obs", ir.alias("information_ratio"))


def exact_lookup(events: DataFrame, bars: DataFrame, value: str = "close") -> DataFrame:
    """Value at t0 and at t1 of each event; both times must exist (see :func:`orphans`)."""
    p = bars.select("symbol", F.col("timestamp").alias("t0"), F.col(value).alias("value_0"))
    q = bars.select("symbol", F.col("timestamp").alias("t1"), F.col(value).alias("value_1"))
    return events.join(p, ["symbol", "t0"]).join(q, ["symbol", "t1"])


def orphans(events: DataFrame, bars: DataFrame, time: str) -> DataFrame:
    """Events whose ``time`` is not a bar of their symbol."""
    return events.join(bars.select("symbol", F.col("timestamp").alias(time)), ["symbol", time], "left_anti")


def missing_features(required: list[str], present: DataFrame, column: str = "feature") -> DataFrame:
    """Required names absent from a column of names."""
    spark = present.sparkSession
    need = spark.createDataFrame([(x,) for x in required], f"{column} string")
    return need.join(present.select(column).distinct(), column, "left_anti")


def distinct_features(values: DataFrame) -> DataFrame:
    return values.select("feature").distinct()


def top_rank(df: DataFrame, by: str, keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """1-based rank by descending value (a report over few rows per key)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(by))))
