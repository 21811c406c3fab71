"""Order-flow queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bars as B
from ..operators import orderflow as O
from ..sources import views as V
from . import query, r, rounded, rs

_T = V.with_views("ticks")
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq)"


def _ofi_sql(flow: str) -> str:
    def mean(n):
        return (
            f"CASE WHEN i >= {n - 1} THEN avg(f) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING "
            f"AND CURRENT ROW) END AS ofi_{n}"
        )

    return f""", f AS (SELECT symbol, seq, timestamp, row_number() OVER w - 1 AS i, {flow} AS f FROM ticks {_W}),
    m AS (SELECT *, {mean(10)}, {mean(50)}, {mean(100)} FROM f),
    x AS (SELECT *, 0.5e0 * ofi_10 + 0.3e0 * ofi_50 + 0.2e0 * ofi_100 AS x FROM m),
    y AS (SELECT *, coalesce(stddev_samp(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0) * 3 AS sc FROM x),
    ofi AS (SELECT symbol, seq, timestamp, ofi_10, ofi_50, ofi_100,
      CASE WHEN x IS NULL THEN NULL WHEN sc < 1e-15 THEN 0.0e0 ELSE tanh(x / sc) END AS ofi_signal FROM y)"""


_BOOK = "coalesce((bid_size - ask_size) - lag(bid_size - ask_size) OVER w, 0)"
_TRADE = "CASE WHEN upper(side) IN ('SELL','S','ASK') THEN -quantity ELSE quantity END"
_OFI_OUT = f"SELECT symbol, seq, {rs('ofi_10', 'ofi_50', 'ofi_100', 'ofi_signal')} FROM ofi"


@query("order_flow_book", _T + _ofi_sql(_BOOK) + _OFI_OUT)
def order_flow_book(spark, d):
    t = O.order_flow(V.ticks(spark, d))
    return rounded(t.select("symbol", "seq", "ofi_10", "ofi_50", "ofi_100", "ofi_signal"))


@query("order_flow_trade", _T + _ofi_sql(_TRADE) + _OFI_OUT)
def order_flow_trade(spark, d):
    t = O.order_flow(V.ticks(spark, d).drop("bid_size", "ask_size"))
    return rounded(t.select("symbol", "seq", "ofi_10", "ofi_50", "ofi_100", "ofi_signal"))


@query(
    "hourly_flow_leaders",
    V.with_views("bars_1h") + _ofi_sql(_BOOK) + f""", v AS (SELECT symbol, timestamp, seq,
      sum(price * quantity) OVER d / sum(quantity) OVER d AS vwap FROM ticks
      WINDOW d AS (PARTITION BY symbol, date_trunc('day', timestamp) ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)),
    h AS (SELECT o.symbol, date_trunc('hour', o.timestamp) AS hour, last(ofi_signal ORDER BY o.timestamp, o.seq) AS ofi_signal,
      last(vwap ORDER BY o.timestamp, o.seq) AS vwap FROM ofi o JOIN v ON o.seq = v.seq GROUP BY 1, 2)
    SELECT b.symbol, b.timestamp, open, high, low, close, volume, {rs('ofi_signal', 'vwap')} FROM bars_1h b
    JOIN h ON b.symbol = h.symbol AND b.timestamp = h.hour WHERE ofi_signal IS NOT NULL
    ORDER BY abs(ofi_signal) DESC, b.symbol, b.timestamp LIMIT 10""",
)
def hourly_flow_leaders(spark, d):
    t = V.ticks(spark, d)
    flow = O.session_vwap(O.order_flow(t))
    hour = F.date_trunc("hour", "timestamp")
    key = B.order_key("timestamp", "seq")
    last = flow.groupBy("symbol", hour.alias("timestamp")).agg(
        F.max_by("ofi_signal", key).alias("ofi_signal"), F.max_by("vwap", key).alias("vwap")
    )
    top = (
        B.resample(t, 3600)
        .join(last, ["symbol", "timestamp"])
        .filter(F.col("ofi_signal").isNotNull())
        .orderBy(F.abs("ofi_signal").desc(), "symbol", "timestamp")
        .limit(10)
    )
    return rounded(top.drop("trade_count"))


def _guard(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


_KYLE = f""", a AS (SELECT symbol, seq, row_number() OVER w - 1 AS i, {_TRADE} AS q,
      coalesce(price - lag(price) OVER w, 0) AS dp FROM ticks {_W}),
    b AS (SELECT *, CASE WHEN i = 0 THEN 0.0e0 ELSE q END AS dc,
      sum(q) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS cvd FROM a),
    c AS (SELECT *, covar_pop(dp, dc) OVER n AS cov, stddev_pop(dp) OVER n AS sp, stddev_pop(dc) OVER n AS sc,
      regr_slope(dp, q) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS sl
      FROM b WINDOW n AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, CASE WHEN i < 19 THEN NULL WHEN sp < 1e-15 OR sc < 1e-15 THEN 0.0e0 ELSE tanh(-cov / (sp * sc) * 3) END AS cvd_divergence,
      CASE WHEN i >= 100 THEN greatest(coalesce({_guard('sl')}, 0), 0) END AS kyle_lambda FROM c),
    g AS (SELECT *, avg(kyle_lambda) OVER z AS m, stddev_samp(kyle_lambda) OVER z AS sd FROM e
      WINDOW z AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, CASE WHEN i < 101 THEN NULL WHEN sd < 1e-15 THEN 0.0e0 ELSE (kyle_lambda - m) / sd END AS kyle_lambda_zscore FROM g),
    kyle AS (SELECT symbol, seq, cvd, cvd_divergence, kyle_lambda, kyle_lambda_zscore, tanh(kyle_lambda_zscore / 3) AS liquidity_signal,
      tanh(0.5e0 * cvd_divergence + 0.5e0 * tanh(kyle_lambda_zscore / 3)) AS combined_signal FROM k)"""


@query(
    "cvd_kyle",
    _T + _KYLE + f"SELECT symbol, seq, cvd, {rs('cvd_divergence', 'kyle_lambda', 'kyle_lambda_zscore', 'liquidity_signal', 'combined_signal')} FROM kyle",
)
def cvd_kyle(spark, d):
    t = O.cvd_kyle(V.ticks(spark, d))
    return rounded(
        t.select("symbol", "seq", "cvd", "cvd_divergence", "kyle_lambda", "kyle_lambda_zscore", "liquidity_signal", "combined_signal")
    )


@query(
    "recent_microstructure",
    _T + f""", a AS (SELECT symbol, seq, price, quantity, row_number() OVER w - 1 AS i, bid, ask, epoch_ms(timestamp) AS ms,
      CASE WHEN side = 'BUY' THEN quantity ELSE 0 END AS buy, CASE WHEN side = 'SELL' THEN quantity ELSE 0 END AS sell FROM ticks {_W}),
    b AS (SELECT *, price - lag(price) OVER o AS dp, lag(buy - sell) OVER o AS prev, lag(price, 5) OVER o AS p5, least(i + 1, 100) AS n,
      CASE WHEN bid > 0 AND ask > bid THEN (ask - bid) / ((bid + ask) / 2) * 10000.0e0 END AS bps FROM a
      WINDOW o AS (PARTITION BY symbol ORDER BY i)),
    c AS (SELECT *, sum(quantity) OVER l AS vol, (bid - first(bid) OVER l) - (ask - first(ask) OVER l) AS imb,
      sum(buy - sell) OVER l AS delta, var_samp(prev) OVER p AS v, covar_samp(dp, prev) OVER p AS cv, avg(bps) OVER l AS ab,
      ms - first(ms) OVER l AS el, avg(sell) OVER l AS sm, stddev_samp(sell) OVER l AS ss, avg(abs(dp)) OVER p AS ad
      FROM b WINDOW l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
      p AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 98 PRECEDING AND CURRENT ROW))
    SELECT symbol, seq, {r('CASE WHEN n < 2 THEN 0 ELSE imb / vol END', name='ofi')},
      {r('CASE WHEN n < 2 THEN 0 ELSE delta / vol END', name='cvd')},
      {r('CASE WHEN n < 3 OR v IS NULL OR v = 0 THEN 0 ELSE cv / v END', name='kyle_lambda')},
      {r('CASE WHEN n < 2 THEN 0 ELSE coalesce(ab, 0) END', name='spread_bps')},
      {r('CASE WHEN el > 0 THEN n / (el / 1000.0e0) ELSE 0 END', name='trade_intensity')},
      coalesce(n >= 10 AND sell > sm + 2 * ss AND ad > 0 AND abs(price - p5) / ad < 1, false) AS absorption FROM c""",
)
def recent_microstructure(spark, d):
    t = O.recent_microstructure(V.ticks(spark, d))
    return rounded(t.select("symbol", "seq", "ofi", "cvd", "kyle_lambda", "spread_bps", "trade_intensity", "absorption"))


@query(
    "session_vwap",
    _T + f""" SELECT symbol, seq, {r('sum(price * quantity) OVER d / sum(quantity) OVER d', name='vwap')} FROM ticks
    WINDOW d AS (PARTITION BY symbol, date_trunc('day', timestamp) ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)""",
)
def session_vwap(spark, d):
    return rounded(O.session_vwap(V.ticks(spark, d)).select("symbol", "seq", "vwap"))


@query(
    "vpin_buckets",
    _T + f""", c AS (SELECT symbol, timestamp, quantity AS q, sum(quantity) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS hi,
      CASE WHEN side = 'BUY' THEN 1.0e0 ELSE 0.0e0 END AS buy FROM ticks),
    x AS (SELECT *, unnest(range(CAST(floor((hi - q) / 500) AS BIGINT), greatest(CAST(floor((hi - q) / 500) AS BIGINT), CAST(ceil(hi / 500) AS BIGINT) - 1) + 1)) AS bucket FROM c),
    b AS (SELECT symbol, bucket, sum((least(hi, (bucket + 1) * 500) - greatest(hi - q, bucket * 500)) * buy) AS bv,
      sum((least(hi, (bucket + 1) * 500) - greatest(hi - q, bucket * 500)) * (1 - buy)) AS sv FROM x GROUP BY ALL HAVING bv + sv >= 500 * (1 - 1e-9)),
    v AS (SELECT *, sum(abs(bv - sv)) OVER w / sum(bv + sv) OVER w AS vpin, sum(bv) OVER w / sum(bv + sv) OVER w AS bp, count(*) OVER w AS nb FROM b
      WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT symbol, bucket, {r('bv', name='buy_volume')}, {r('sv', name='sell_volume')}, {r('vpin')}, {r('bp', name='buy_volume_pct')}, nb AS n_buckets,
      CASE WHEN vpin >= 0.95 THEN 'extreme' WHEN vpin >= 0.85 THEN 'high' WHEN vpin >= 0.7 THEN 'elevated' WHEN vpin >= 0.5 THEN 'normal' ELSE 'low' END AS toxicity,
      CASE WHEN vpin >= 0.95 THEN 0.0e0 WHEN vpin >= 0.85 THEN 0.25e0 WHEN vpin >= 0.7 THEN 0.5e0 WHEN vpin >= 0.5 THEN 1.0e0 ELSE 1.1e0 END AS size_multiplier FROM v""",
)
def vpin_buckets(spark, d):
    b = O.volume_buckets(V.ticks(spark, d), 500.0)
    return rounded(O.vpin(b).drop("timestamp"))


@query(
    "adv_bucket_size",
    _T + f""", dv AS (SELECT symbol, date_trunc('day', timestamp) AS day, sum(quantity) AS v,
      row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', timestamp)) AS i FROM ticks GROUP BY 1, 2)
    SELECT a.symbol, a.day AS timestamp, {r('1000 * pow(0.9e0, a.i) + sum(0.1e0 * b.v / 50 * pow(0.9e0, a.i - b.i))', name='bucket_size')}
    FROM dv a JOIN dv b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY a.symbol, a.day, a.i""",
)
def adv_bucket_size(spark, d):
    t = V.ticks(spark, d).groupBy("symbol", F.date_trunc("day", "timestamp").alias("timestamp"))
    return rounded(O.adv_bucket_size(t.agg(F.sum("quantity").alias("volume"))).select("symbol", "timestamp", "bucket_size"))


@query(
    "hawkes_intensity",
    _T + f""" SELECT a.symbol, a.seq, {r('0.1e0 + coalesce(sum(0.5e0 * exp(-0.01e0 * (epoch_us(a.timestamp) - epoch_us(b.timestamp)) / 1e6)), 0)', name='intensity')}
    FROM ticks a LEFT JOIN ticks b ON a.symbol = b.symbol AND b.timestamp < a.timestamp GROUP BY ALL""",
)
def hawkes_intensity(spark, d):
    from ..plans.recursion import excitation

    t = excitation(V.ticks(spark, d), ("symbol",), "timestamp", 0.5, 0.01)
    return rounded(t.select("symbol", "seq", (F.lit(0.1) + F.col("excitation")).alias("intensity")))
