"""Bar building and histograms over bars."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import views as V
from . import query, r, rounded, rs

_T = V.with_views("ticks")
_TF = ", ".join(f"('{n}', {s})" for n, s in B.TIMEFRAMES.items())


@query(
    "bars_1h",
    V.with_views("bars_1h") + " SELECT * FROM bars_1h",
)
def bars_1h(spark, d):
    return rounded(V.bars(spark, d, 3600), None)


@query(
    "bars_multi_timeframe",
    _T + f""", tf(timeframe, s) AS (VALUES {_TF}),
    b AS (SELECT symbol, timeframe, to_timestamp((epoch_us(timestamp) // 1000000) // s * s)::TIMESTAMP AS timestamp,
      first(price ORDER BY timestamp, seq) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY timestamp, seq) AS close, sum(quantity) AS volume, count(*) AS trade_count
      FROM (SELECT t.symbol, t.timestamp, t.seq, t.price, t.quantity, tf.timeframe, tf.s FROM ticks t CROSS JOIN tf) x
      GROUP BY symbol, timeframe, 3)
    SELECT symbol, timeframe, timestamp, open, high, low, close, volume, CAST(trade_count AS BIGINT) AS trade_count FROM b""",
)
def bars_multi_timeframe(spark, d):
    return rounded(B.resample_many(V.ticks(spark, d)), None)


@query(
    "volume_profile",
    V.with_views("bars_1h") + f""", p AS (SELECT symbol, (high + low) / 2 AS p, volume AS v FROM bars_1h),
    g AS (SELECT *, min(p) OVER (PARTITION BY symbol) AS lo, max(p) OVER (PARTITION BY symbol) AS hi FROM p),
    h AS (SELECT symbol, lo, hi, greatest(0, least(49, CAST(ceil((p - lo) / ((hi - lo) / 50)) AS INTEGER) - 1)) AS bin, sum(v) AS v
      FROM g GROUP BY ALL),
    k AS (SELECT symbol, bin, v, lo + (bin + 0.5e0) * (hi - lo) / 50 AS center,
      coalesce(sum(v) OVER (PARTITION BY symbol ORDER BY v DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      sum(v) OVER (PARTITION BY symbol) AS total FROM h)
    SELECT symbol, {r('first(center ORDER BY v DESC, bin)', name='poc')},
      {r('max(CASE WHEN above < total * 0.7e0 THEN center END)', name='vah')},
      {r('min(CASE WHEN above < total * 0.7e0 THEN center END)', name='val')} FROM k GROUP BY symbol""",
)
def volume_profile(spark, d):
    return rounded(B.volume_profile(V.bars(spark, d, 3600)))


@query(
    "price_clusters",
    V.with_views("bars_1h") + f""", st AS (SELECT symbol, least(50, greatest(10, count(*) // 5)) AS bins, min(close) AS lo,
      max(close) - min(close) AS width FROM bars_1h GROUP BY symbol HAVING count(*) >= 10),
    c AS (SELECT symbol, least(CAST(floor((close - lo) / width * bins) AS INTEGER), bins - 1) AS bin, count(*) AS cnt
      FROM bars_1h JOIN st USING (symbol) GROUP BY ALL),
    g AS (SELECT symbol, lo, width, bins, unnest(range(bins)) AS bin FROM st),
    f AS (SELECT g.*, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN c ON g.symbol = c.symbol AND g.bin = c.bin),
    n AS (SELECT *, lag(cnt) OVER w AS l, lead(cnt) OVER w AS rr FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bin))
    SELECT symbol, CAST(bin AS INTEGER) AS bin, CAST(cnt AS BIGINT) AS cnt, {r('lo + (bin + 0.5e0) * width / bins', name='center')}
    FROM n WHERE cnt > l AND cnt > rr""",
)
def price_clusters(spark, d):
    return rounded(B.price_clusters(V.bars(spark, d, 3600)))


@query(
    "liquidation_ladder",
    _T + f""", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) AS rn FROM ticks),
    s AS (SELECT symbol, first(price ORDER BY rn) AS p, stddev_samp(price) AS sd FROM x WHERE rn <= 200 GROUP BY symbol HAVING count(*) >= 20),
    l AS (SELECT symbol, m AS multiple, side, CASE side WHEN 'longs' THEN p - m * sd ELSE p + m * sd END AS level
      FROM s, (VALUES (0.5e0), (1.0e0), (1.5e0), (2.0e0), (2.5e0)) a(m), (VALUES ('longs'), ('shorts')) b(side))
    SELECT symbol, multiple, side, {r('level')} FROM l WHERE side = 'shorts' OR level > 0""",
)
def liquidation_ladder(spark, d):
    return rounded(B.liquidation_ladder(V.ticks(spark, d)))
