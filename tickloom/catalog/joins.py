"""Range queries, lookups, point-in-time and interval joins."""

from pyspark.sql import functions as F

from ..operators import queries as X
from ..operators import orderflow as O
from ..operators import bars as B
from ..plans.asof import asof_join, missing_matches
from ..plans.spans import interval_join
from ..sources import views as V
from . import query, r, rounded, rs
from .labels import _LONG, _labels
from .orderflow import _BOOK, _ofi_sql

_T = V.with_views("ticks")
_ts = lambda c: F.col(c).cast("timestamp_ntz")


@query(
    "bar_range_query",
    V.with_views("bars_1h") + " SELECT symbol, timestamp, open, high, low, close, volume FROM bars_1h WHERE symbol = 'S3' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-15' ORDER BY timestamp LIMIT 100",
)
def bar_range_query(spark, d):
    q = X.time_range(V.bars(spark, d), "2024-01-05", "2024-01-15", limit=100, symbol="S3")
    return rounded(q.drop("trade_count"), None)


@query(
    "tick_range_query",
    _T + " SELECT symbol, timestamp, seq, price, quantity FROM ticks WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-06'",
)
def tick_range_query(spark, d):
    q = X.time_range(V.ticks(spark, d), "2024-01-05", "2024-01-06")
    return rounded(q.select("symbol", "timestamp", "seq", "price", "quantity"), None)


@query(
    "macro_range_query",
    V.with_views("macro_series") + f" SELECT series_id, timestamp, {r('value', 2)} FROM macro_series WHERE series_id = 'NATION_3' AND timestamp >= TIMESTAMP '1997-01-01' AND timestamp < TIMESTAMP '1998-01-01'",
)
def macro_range_query(spark, d):
    return rounded(X.time_range(V.macro_series(spark, d), "1997-01-01", "1998-01-01", series_id="NATION_3"), 2)


@query(
    "fundamentals_query",
    V.with_views("fundamentals_wide") + f""", f AS (SELECT asset_id, report_date, coalesce(period_type, 'annual') AS period_type, unnest(['size','retail_price']) AS metric_name, unnest([size, retail_price]) AS value FROM fundamentals_wide)
    SELECT asset_id, CAST(report_date AS TIMESTAMP) AS report_date, period_type, metric_name, {r('value', 2)} FROM f WHERE value IS NOT NULL AND period_type = 'annual' AND report_date >= DATE '2020-01-05' AND report_date < DATE '2020-02-10'""",
)
def fundamentals_query(spark, d):
    from ..sources.ingest import unpivot_statements

    f = unpivot_statements(V.fundamentals_wide(spark, d), ["asset_id"], {"size": "size", "retail_price": "retail_price"})
    return rounded(X.time_range(f, "2020-01-05", "2020-02-10", time="report_date", period_type="annual"), 2)


@query(
    "economic_event_query",
    V.with_views("economic_events") + f" SELECT event_id, event_type, scheduled_time, {rs('actual', 'consensus', digits=2)}, impact_score FROM economic_events WHERE event_type = 'cpi' AND impact_score >= 2 AND scheduled_time >= TIMESTAMP '1996-01-01' AND scheduled_time < TIMESTAMP '1999-01-01'",
)
def economic_event_query(spark, d):
    e = V.economic_events(spark, d).filter("impact_score >= 2")
    return rounded(X.time_range(e, "1996-01-01", "1999-01-01", time="scheduled_time", event_type="cpi"), 2)


@query(
    "upcoming_events",
    V.with_views("economic_events") + " SELECT event_id, event_type, scheduled_time FROM economic_events WHERE scheduled_time >= TIMESTAMP '1997-01-01' AND scheduled_time < TIMESTAMP '1997-01-01' + INTERVAL 86400 MINUTE",
)
def upcoming_events(spark, d):
    return rounded(X.upcoming(V.economic_events(spark, d), "1997-01-01", 86400).select("event_id", "event_type", "scheduled_time"))


@query("asset_search", V.with_views("assets") + " SELECT asset_id, symbol, asset_class FROM assets WHERE upper(symbol) LIKE 'SUPPLIER#00000001%' AND asset_class = 'equity'")
def asset_search(spark, d):
    return X.search_assets(V.assets(spark, d), "supplier#00000001", "equity").select("asset_id", "symbol", "asset_class")


@query(
    "asset_resolve",
    V.with_views("assets") + """ SELECT c_custkey, symbol, exchange, asset_id FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS symbol, r_name AS exchange
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x LEFT JOIN assets USING (symbol, exchange)""",
)
def asset_resolve(spark, d):
    return X.resolve(_wanted(spark, d), V.assets(spark, d)).select("c_custkey", "symbol", "exchange", "asset_id")


def _wanted(spark, d):
    c, n, rg = (V.table(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(rg, n.n_regionkey == rg.r_regionkey)
    return x.select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("symbol"), F.col("r_name").alias("exchange"))


@query(
    "asset_resolve_or_create",
    V.with_views("assets") + """ SELECT symbol, exchange, substr(sha256(symbol || '|' || exchange), 1, 32) AS asset_id FROM (SELECT DISTINCT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS symbol, r_name AS exchange
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.symbol = x.symbol AND a.exchange = x.exchange)""",
)
def asset_resolve_or_create(spark, d):
    return X.new_assets(_wanted(spark, d), V.assets(spark, d)).select("symbol", "exchange", "asset_id")


@query(
    "asset_upsert",
    f"""WITH c AS (SELECT c_custkey % 500 AS asset_id, c_name AS symbol, c_custkey AS version, {r('c_acctbal', 2, 'balance')} FROM customer)
    SELECT asset_id, symbol, version, balance FROM c QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY version DESC) = 1""",
)
def asset_upsert(spark, d):
    c = V.table(spark, d, "customer").select((F.col("c_custkey") % 500).alias("asset_id"), F.col("c_name").alias("symbol"), F.col("c_custkey").alias("version"), F.col("c_acctbal").alias("balance"))
    return rounded(X.upsert(c.filter("version < 1000"), c.filter("version >= 1000"), ["asset_id"], "version"), 2)


@query("latest_per_key", _T + " SELECT symbol, timestamp, seq, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) = 1")
def latest_per_key(spark, d):
    t = V.ticks(spark, d).select("symbol", "timestamp", "seq", "price")
    return rounded(X.latest_per_key(t, ["symbol"], ["timestamp", "seq"]), None)


@query("keep_last_rows", _T + " SELECT symbol, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) <= 500")
def keep_last_rows(spark, d):
    return B.last_per_key(V.ticks(spark, d), ["symbol"], ["timestamp", "seq"], 500).select("symbol", "seq")


def _signals(spark, d):
    t = O.order_flow(V.ticks(spark, d)).filter("ofi_signal IS NOT NULL")
    return t.groupBy("symbol", "timestamp").agg(F.max_by("ofi_signal", "seq").alias("ofi_signal"))


_SIG = _ofi_sql(_BOOK) + ", sig AS (SELECT symbol, timestamp, last(ofi_signal ORDER BY seq) AS ofi_signal FROM ofi WHERE ofi_signal IS NOT NULL GROUP BY 1, 2)"


@query(
    "asof_join_strict",
    V.with_views("bars_1h") + _SIG + f" SELECT b.symbol, b.timestamp, {r('s.ofi_signal', name='ofi_signal')} FROM bars_1h b ASOF LEFT JOIN sig s ON b.symbol = s.symbol AND b.timestamp > s.timestamp",
)
def asof_join_strict(spark, d):
    j = asof_join(V.bars(spark, d).select("symbol", "timestamp"), _signals(spark, d), ["symbol"], "timestamp", "timestamp", ["ofi_signal"], strict=True)
    return rounded(j)


_REG = """, reg AS (SELECT n_name AS symbol, o_orderdate AS timestamp, max(o_orderpriority) AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    pt AS (SELECT o_orderkey, n_name AS symbol, o_orderdate AS timestamp FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _states(spark, d):
    o, c, n = (V.table(spark, d, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    x = x.select("o_orderkey", "o_orderpriority", F.col("n_name").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    return x.select("o_orderkey", "symbol", "timestamp"), x.groupBy("symbol", "timestamp").agg(F.max("o_orderpriority").alias("state"))


# Codes of the ordered states (fixed values of this query).
_CODES = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 0}


@query(
    "asof_join_states",
    "WITH x AS (SELECT 1)" + _REG + f" SELECT o_orderkey, state, CASE state {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in _CODES.items())} END AS code FROM pt ASOF LEFT JOIN reg ON pt.symbol = reg.symbol AND pt.timestamp >= reg.timestamp",
)
def asof_join_states(spark, d):
    pt, reg = _states(spark, d)
    j = asof_join(pt, reg, ["symbol"], "timestamp", "timestamp", ["state"], strict=False)
    code = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return j.select("o_orderkey", "state", F.try_element_at(code, F.col("state")).alias("code"))


@query(
    "asof_missing",
    "WITH x AS (SELECT 1)" + _REG + " SELECT count(*) FILTER (state IS NULL) AS n_missing, count(*) AS n_rows FROM pt ASOF LEFT JOIN reg ON pt.symbol = reg.symbol AND pt.timestamp >= reg.timestamp",
)
def asof_missing(spark, d):
    pt, reg = _states(spark, d)
    return missing_matches(asof_join(pt, reg, ["symbol"], "timestamp", "timestamp", ["state"], strict=False), "state")


@query(
    "previous_value",
    V.with_views("macro_series") + f""", j AS (SELECT a.series_id, a.timestamp, a.value, b.value AS pv FROM (SELECT *, timestamp - INTERVAL 7 DAY AS at FROM macro_series) a ASOF LEFT JOIN macro_series b ON a.series_id = b.series_id AND a.at >= b.timestamp)
    SELECT series_id, timestamp, {rs('value', digits=2)}, {r('coalesce(pv, first(value) OVER (PARTITION BY series_id ORDER BY timestamp))', 2, 'previous_value')} FROM j""",
)
def previous_value(spark, d):
    return rounded(X.previous_value(V.macro_series(spark, d), 7 * 86_400), 2)


_EV = """, ee AS (SELECT event_id, DATE '2024-01-01' + CAST(event_id % 31 AS INTEGER) + to_hours(CAST(event_id % 24 AS BIGINT)) AS ev FROM (SELECT o_orderkey AS event_id FROM orders))"""


def _calendar(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    t = F.timestamp_seconds(F.lit(1704067200) + (F.col("event_id") % 31) * 86400 + (F.col("event_id") % 24) * 3600)
    return o.select("event_id", t.alias("ev"))


@query(
    "blackout_join",
    _T + _EV + " SELECT symbol, seq, event_id FROM ticks JOIN ee ON timestamp >= ev - INTERVAL 45 MINUTE AND timestamp < ev",
)
def blackout_join(spark, d):
    from ..operators.risk import blackout_windows

    # many events share a window: ticks meet the distinct windows, and only what they hit meets the events
    w, at = blackout_windows(_calendar(spark, d), "ev").drop("ev"), ["block_start", "block_end"]
    hit = interval_join(V.ticks(spark, d).select("symbol", "seq", "timestamp"), w.select(*at).distinct(), "timestamp", *at)
    return hit.join(w, at).select("symbol", "seq", "event_id")


@query(
    "exact_time_lookup",
    V.with_views("bars_1h") + _LONG + f" SELECT symbol, t0, t1, {r('ln(exit_price / entry_price)', name='log_return')} FROM lab",
)
def exact_time_lookup(spark, d):
    j = X.exact_lookup(_labels(spark, d).select("symbol", "t0", "t1"), V.bars(spark, d))
    return rounded(j.select("symbol", "t0", "t1", F.log(F.col("value_1") / F.col("value_0")).alias("log_return")))


@query(
    "orphan_events",
    V.with_views("bars_1h") + " SELECT t.symbol, t.timestamp AS t0, t.seq FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM bars_1h b WHERE b.symbol = t.symbol AND b.timestamp = t.timestamp)",
)
def orphan_events(spark, d):
    e = V.ticks(spark, d).select("symbol", F.col("timestamp").alias("t0"), "seq")
    return rounded(X.orphans(e, V.bars(spark, d), "t0"))


_CORR = """, hr AS (SELECT symbol, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp)) AS lr FROM bars_1h),
    ok AS (SELECT timestamp FROM hr WHERE lr IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM hr)), z AS (SELECT hr.* FROM hr JOIN ok USING (timestamp)),
    cm AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.lr, b.lr) AS c FROM z a JOIN z b USING (timestamp) WHERE a.symbol < b.symbol GROUP BY 1, 2)"""


@query(
    "pair_correlation_lookup",
    V.with_views("bars_1h") + _CORR + f""", p AS (SELECT DISTINCT t.symbol AS a, 'S1' AS b FROM ticks t),
    j AS (SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 1 ELSE c END AS rho FROM p LEFT JOIN cm ON cm.a = least(p.a, p.b) AND cm.b = greatest(p.a, p.b))
    SELECT a, b, {r('rho', name='correlation')}, coalesce(rho > 0.75, false) AS blocked FROM j""",
)
def pair_correlation_lookup(spark, d):
    from ..operators import volatility as vol

    b = V.bars(spark, d)
    m = vol.asset_correlations(vol.with_returns(b), [f"S{i}" for i in range(12)]).filter("a < b").select("a", "b", "correlation")
    p = b.select(F.col("symbol").alias("a"), F.lit("S1").alias("b")).distinct()
    return rounded(X.pair_lookup(p, m))


@query(
    "information_ratio",
    V.with_views("bars_1h") + f""", x AS (SELECT symbol, timestamp, close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS ret FROM bars_1h)
    SELECT a.symbol, count(*) AS n_obs, {r('avg(a.ret - b.ret) / stddev_samp(a.ret - b.ret) * sqrt(252)', name='information_ratio')} FROM x a JOIN x b ON a.timestamp = b.timestamp AND b.symbol = 'S0' WHERE a.symbol <> 'S0' AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1""",
)
def information_ratio(spark, d):
    from ..operators import volatility as vol

    x = vol.with_returns(V.bars(spark, d)).select("symbol", "timestamp", F.col("simple_return").alias("ret")).filter("ret IS NOT NULL")
    return rounded(X.information_ratio(x.filter("symbol <> 'S0'"), x.filter("symbol = 'S0'")))
