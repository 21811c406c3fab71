"""Feature store queries."""

from pyspark.sql import functions as F

from ..operators import queries as X
from ..operators import store as S
from ..sources import views as V
from . import query, r, rounded, rs

_H = V.with_views("bars_1h")
# Two versions per symbol: the second recomputes half of the symbols later.
_FV = """, fv AS (SELECT symbol, feature, 'v1' AS version, timestamp, value, TIMESTAMP '2024-02-01' AS computed_at FROM (SELECT symbol, timestamp, 'range' AS feature, high - low AS value FROM bars_1h UNION ALL SELECT symbol, timestamp, 'body', close - open FROM bars_1h)
    UNION ALL SELECT symbol, 'range', 'v2', timestamp, 2 * (high - low), TIMESTAMP '2024-03-01' FROM bars_1h WHERE symbol IN ('S0','S2','S4') AND trade_count > 1)"""


def _values(spark, d):
    b = V.bars(spark, d).withColumn("range", F.col("high") - F.col("low")).withColumn("body", F.col("close") - F.col("open"))
    one = S.tall(b, ["range", "body"], "v1", "2024-02-01")
    two = b.filter(F.col("symbol").isin("S0", "S2", "S4") & (F.col("trade_count") > 1)).withColumn("range", 2 * F.col("range"))
    return one.unionByName(S.tall(two, ["range"], "v2", "2024-03-01"))


@query("feature_versions", _H + _FV + " SELECT symbol, feature, version, min(computed_at) AS computed_at, count(*) AS row_count, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM fv GROUP BY 1, 2, 3")
def feature_versions(spark, d):
    return rounded(S.catalog_rows(_values(spark, d)).drop("content_hash"))


@query("latest_versions", _H + _FV + " SELECT symbol, feature, last(version ORDER BY computed_at) AS version FROM fv WHERE computed_at <= TIMESTAMP '2024-02-15' GROUP BY 1, 2")
def latest_versions(spark, d):
    v = S.catalog_rows(_values(spark, d)).drop("content_hash")
    return S.latest_version(v, "2024-02-15")


@query(
    "point_in_time_load",
    _H + _FV + f""", lv AS (SELECT symbol, feature, last(version ORDER BY computed_at) AS version FROM fv WHERE computed_at <= TIMESTAMP '2024-04-01' GROUP BY 1, 2)
    SELECT symbol, timestamp, {r("max(value) FILTER (feature = 'range')", name='range')}, {r("max(value) FILTER (feature = 'body')", name='body')} FROM fv JOIN lv USING (symbol, feature, version) WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
)
def point_in_time_load(spark, d):
    v = _values(spark, d)
    vers = v.select(*S.VERSION_KEYS, "computed_at").distinct()
    return rounded(S.load(v, vers, ["range", "body"], "2024-01-05", "2024-01-20", "2024-04-01"))


@query("look_ahead_check", _H + _FV + " SELECT feature, count(*) AS n FROM fv WHERE computed_at > TIMESTAMP '2024-02-15' GROUP BY 1")
def look_ahead_check(spark, d):
    return S.look_ahead(_values(spark, d), "2024-02-15")


@query("version_conflicts", _H + _FV + " SELECT DISTINCT symbol, feature, version FROM fv WHERE version = 'v2'")
def version_conflicts(spark, d):
    v = _values(spark, d)
    return S.conflicts(v, v.filter("version = 'v2'"))


@query("list_features", _H + _FV + " SELECT DISTINCT feature FROM fv")
def list_features(spark, d):
    return X.distinct_features(_values(spark, d))


@query("missing_features", "SELECT 'vol' AS feature")
def missing_features(spark, d):
    return X.missing_features(["range", "body", "vol"], _values(spark, d))


@query("content_hash")
def content_hash(spark, d):
    v = _values(spark, d)
    return S.content_hash(v.select(*S.VERSION_KEYS, "timestamp", "value"), S.VERSION_KEYS)


@query(
    "feature_coverage",
    V.with_views("ticks") + """, i AS (SELECT row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) - 1 AS i FROM ticks), n AS (SELECT count(*) AS n FROM i WHERE i >= 50)
    SELECT n AS n_rows, 'ofi_10' AS "column", 0 AS n_null FROM n UNION ALL SELECT n, 'ofi_50', 0 FROM n UNION ALL SELECT n, 'ofi_100', (SELECT count(*) FROM i WHERE i BETWEEN 50 AND 98) FROM n""",
)
def feature_coverage(spark, d):
    from ..plans.ordered import INDEX, TICKS

    t = S.run_calculators(V.ticks(spark, d), ["order_flow"])
    return S.coverage(TICKS.running(t), ["ofi_10", "ofi_50", "ofi_100"], INDEX, 50)


@query("calculator_chain")
def calculator_chain(spark, d):
    t = S.run_calculators(V.ticks(spark, d), ["order_flow", "cvd_kyle", "session_vwap"])
    f = S.tall(t.groupBy("symbol", "timestamp").agg(*[F.max_by(c, "seq").alias(c) for c in ("ofi_signal", "combined_signal", "vwap")]), ["ofi_signal", "combined_signal", "vwap"], S.version_name("chain", {"windows": [10, 50, 100]}, "2024-02-01T00:00:00+00:00"), "2024-02-01")
    return rounded(f.groupBy("feature", "version").agg(F.count("value").alias("n_values"), F.avg("value").alias("mean")), 5)
