"""Data-quality queries."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import views as V
from . import query, r, rounded, rs

_AS_OF = "2001-06-01 00:00:00"
_B = V.with_views("bars_1d")
_FLAG = f""", a AS (SELECT s_suppkey AS symbol, CASE s_suppkey % 3 WHEN 0 THEN 'crypto' WHEN 1 THEN 'equity' ELSE 'forex' END AS cls, DATE '2000-03-01' AS listed FROM supplier),
    w AS (SELECT b.*, cls, listed, lag(timestamp) OVER o AS prev, avg(close) OVER p AS m, stddev_pop(close) OVER p AS sd, count(close) OVER p AS n,
      avg(volume) OVER q AS v20 FROM bars_1d b LEFT JOIN a USING (symbol) WINDOW o AS (PARTITION BY symbol ORDER BY timestamp),
      p AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, abs(close - m) / sd AS z, epoch(timestamp - prev) AS step FROM w),
    iss AS (SELECT symbol, timestamp, 'gap' AS check_type, 'WARN' AS severity FROM z WHERE step > 129600 AND NOT (cls = 'equity' AND
        (isodow(timestamp) >= 6 OR EXISTS (SELECT 1 FROM range(0, 7) k(k) WHERE k * 86400 < step AND isodow(prev + to_days(CAST(k AS INTEGER))) >= 6)))
      UNION ALL SELECT symbol, timestamp, 'outlier', CASE WHEN z > 8 THEN 'FAIL' ELSE 'WARN' END FROM z WHERE n = 100 AND z > 4
      UNION ALL SELECT symbol, timestamp, 'price_excessive_spread', 'WARN' FROM z WHERE (high - low) / ((high + low) / 2) > 0.5
      UNION ALL SELECT symbol, timestamp, 'timestamp_future', 'FAIL' FROM z WHERE timestamp > TIMESTAMP '{_AS_OF}' + INTERVAL 60 SECOND
      UNION ALL SELECT symbol, timestamp, 'timestamp_epoch', 'FAIL' FROM z WHERE year(timestamp) < 2000
      UNION ALL SELECT symbol, timestamp, 'timestamp_pre_listing', 'FAIL' FROM z WHERE year(timestamp) >= 2000 AND CAST(timestamp AS DATE) < listed
      UNION ALL SELECT symbol, timestamp, 'volume_spike', 'WARN' FROM z WHERE volume > 10 * v20),
    st AS (SELECT b.symbol, b.timestamp, CASE max(CASE severity WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status
      FROM bars_1d b LEFT JOIN iss ON iss.symbol = b.symbol AND iss.timestamp = b.timestamp GROUP BY 1, 2)"""


def _assets(spark, d):
    a = V.assets(spark, d)
    return a.select(F.col("asset_id").alias("symbol"), "asset_class", F.lit("2000-03-01").cast("date").alias("listing_date"))


def _flagged(spark, d):
    return Q.flag_bars(V.bars_1d(spark, d), _assets(spark, d), "1d", F.lit(_AS_OF).cast("timestamp"), details=False)


@query("bar_quality_issues", _B + _FLAG + " SELECT * FROM iss")
def bar_quality_issues(spark, d):
    return rounded(Q.issue_table(_flagged(spark, d)).drop("details"))


@query("bar_quality_split", _B + _FLAG + " SELECT * FROM st")
def bar_quality_split(spark, d):
    return rounded(Q.with_status(_flagged(spark, d)).select("symbol", "timestamp", "status"))


@query(
    "bar_quality_report",
    _B + _FLAG + f""" SELECT symbol, count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warnings, count(*) FILTER (status = 'FAIL') AS failures,
    {r("avg((status = 'PASS')::INT)", name='pass_rate')} FROM st GROUP BY symbol""",
)
def bar_quality_report(spark, d):
    return rounded(Q.quality_report(_flagged(spark, d), ("symbol",)))


@query(
    "tick_quality_issues",
    V.with_views("ticks") + """, w AS (SELECT *, avg(price) OVER p AS m, stddev_pop(price) OVER p AS sd, count(*) OVER p AS n FROM ticks WINDOW p AS (PARTITION BY symbol ORDER BY timestamp, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
    SELECT symbol, timestamp, 'outlier' AS check_type, CASE WHEN abs(price - m) / sd > 8 THEN 'FAIL' ELSE 'WARN' END AS severity FROM w WHERE n = 100 AND abs(price - m) / sd > 4
    UNION ALL SELECT symbol, timestamp, 'timestamp_future', 'FAIL' FROM ticks WHERE timestamp > TIMESTAMP '2024-01-28 00:01:00'""",
)
def tick_quality_issues(spark, d):
    a = V.ticks(spark, d).select("symbol").distinct().withColumn("asset_class", F.lit("crypto")).withColumn("listing_date", F.lit(None).cast("date"))
    f = Q.flag_ticks(V.ticks(spark, d), a, F.lit("2024-01-28").cast("timestamp"))
    return rounded(Q.issue_table(f).drop("details"))


@query(
    "staleness",
    V.with_views("ticks") + f""", l AS (SELECT symbol, max(timestamp) AS last_timestamp, CASE WHEN symbol IN ('S1','S2','S3') THEN 900 ELSE 300 END AS threshold_seconds FROM ticks GROUP BY 1)
    SELECT symbol, last_timestamp, {r("epoch(TIMESTAMP '2024-01-31 00:00:00' - last_timestamp)", name='age_seconds')}, threshold_seconds FROM l WHERE epoch(TIMESTAMP '2024-01-31 00:00:00' - last_timestamp) > threshold_seconds""",
)
def staleness(spark, d):
    t = V.ticks(spark, d)
    a = t.select("symbol").distinct().withColumn("asset_class", F.when(F.col("symbol").isin("S1", "S2", "S3"), "equity").otherwise("crypto"))
    return rounded(Q.staleness(t, a, F.lit("2024-01-31").cast("timestamp")))


@query(
    "coverage_gaps",
    V.with_views("bars_1h") + """, x AS (SELECT symbol, timestamp, coalesce(lag(timestamp) OVER w, TIMESTAMP '2023-12-31') AS p, lead(timestamp) OVER w AS n FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
    g AS (SELECT symbol, p AS gap_start, timestamp AS gap_end FROM x UNION ALL SELECT symbol, timestamp, TIMESTAMP '2024-02-02' FROM x WHERE n IS NULL)
    SELECT * FROM g WHERE epoch(gap_end - gap_start) > 5400 UNION ALL SELECT 'S99', TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-02'""",
)
def coverage_gaps(spark, d):
    b = V.bars(spark, d)
    extra = b.select("symbol").distinct().unionByName(spark.range(1).select(F.lit("S99").alias("symbol")))
    ts = lambda x: F.lit(x).cast("timestamp")
    return rounded(Q.coverage_gaps(b, 3600, ts("2023-12-31"), ts("2024-02-02"), extra))


@query(
    "repeated_times",
    "SELECT l_suppkey AS symbol, l_shipdate AS timestamp, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def repeated_times(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("timestamp"))
    return rounded(Q.repeated_times(li))


@query(
    "feed_latency",
    f"""WITH g AS (SELECT event_type, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM events)
    SELECT event_type, {r('quantile_cont(g, 0.5)', 3, 'p50_ms')}, {r('quantile_cont(g, 0.95)', 3, 'p95_ms')}, {r('quantile_cont(g, 0.99)', 3, 'p99_ms')}, count(g) AS n_gaps FROM g GROUP BY 1""",
)
def feed_latency(spark, d):
    e = V.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return rounded(Q.feed_latency(e, "event_type", "ts"), 3)
