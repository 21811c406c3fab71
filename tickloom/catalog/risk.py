"""Order screening and circuit-breaker queries."""

from pyspark.sql import functions as F

from ..operators import risk as K
from ..operators import volatility as X
from ..sources import views as V
from . import query, r, rounded, rs
from .joins import _CORR, _EV, _calendar

_O = V.with_views("ticks", "order_candidates", "bars_1h")
_CTX = """, oc AS (SELECT o.*, (order_id % 101) / 100.0e0 AS confidence, (order_id % 30) / 100.0e0 AS kelly FROM order_candidates o)"""


def _orders(spark, d):
    o = V.order_candidates(spark, d)
    return o.withColumn("confidence", (F.col("order_id") % 101) / 100.0).withColumn("kelly", (F.col("order_id") % 30) / 100.0)


def _positions(spark, d):
    """Open positions from the data itself: one unit at the first price of every symbol whose last tick was a sale of a small lot."""
    t = V.ticks(spark, d).groupBy("symbol").agg(F.min_by("price", "seq").alias("entry_price"), F.max_by(F.struct("side", "quantity"), "seq").alias("_last"))
    return t.filter("_last.side = 'SELL' AND _last.quantity <= 50").drop("_last").withColumn("size", F.lit(1.0)).withColumn("asset_class", F.lit("equity"))


_RULES = f"""{_EV}, ef AS (SELECT order_id, bool_or(timestamp >= ev - INTERVAL 45 MINUTE AND timestamp < ev) AS blk, bool_or(timestamp >= ev AND timestamp < ev + INTERVAL 15 MINUTE) AS red FROM oc JOIN ee ON timestamp >= ev - INTERVAL 45 MINUTE AND timestamp < ev + INTERVAL 15 MINUTE GROUP BY 1),
    ps AS (SELECT symbol, first(price ORDER BY seq) AS ep FROM ticks GROUP BY 1 HAVING last(side ORDER BY seq) = 'SELL' AND last(quantity ORDER BY seq) <= 50), px AS (SELECT coalesce(sum(ep), 0) AS n, count(*) AS held FROM ps),
    lk AS (SELECT symbol FROM ps UNION SELECT a FROM cm JOIN ps ON b = symbol WHERE c > 0.75 UNION SELECT b FROM cm JOIN ps ON a = symbol WHERE c > 0.75),
    x AS (SELECT oc.*, coalesce(blk, false) AS blk, coalesce(red, false) AS red, n AS opn, held, abs(entry - stop_loss) AS rk, greatest(0, (confidence - 0.5e0) / 0.5e0) * kelly AS kf,
      CASE WHEN abs(entry - stop_loss) > 0 THEN abs(target - entry) / abs(entry - stop_loss) ELSE 0 END AS rr FROM oc LEFT JOIN ef USING (order_id), px),
    y AS (SELECT *, CASE WHEN blk THEN 'event_block' WHEN confidence < 0.52 THEN 'confidence_too_low' WHEN kf < 0.01 THEN 'kelly_too_small'
      WHEN stop_loss <= 0 OR CASE direction WHEN 'long' THEN stop_loss >= entry ELSE stop_loss <= entry END THEN 'no_stop_loss' WHEN rr < 1.5 THEN 'min_reward_risk' WHEN rk * size / 50000 > 0.005 THEN 'max_risk_per_trade' WHEN size * entry / 50000 > 0.1 THEN 'max_size' WHEN held >= 6 THEN 'max_positions'
      WHEN (opn + size * entry) / 50000 > 0.2 THEN 'max_total_exposure' WHEN (opn + size * entry) / 50000 > 0.12 THEN 'max_class_exposure' WHEN symbol IN (SELECT symbol FROM lk) THEN 'high_correlation' END AS block_reason FROM x)"""


@query(
    "order_screening",
    _O + _CTX + _CORR + _RULES + f" SELECT order_id, block_reason, block_reason IS NULL AS approved, {r('CASE WHEN confidence >= 0.52 THEN kf ELSE 0 END', name='kelly_final')}, {r('CASE WHEN block_reason IS NULL THEN size * CASE WHEN red THEN 0.5e0 ELSE 1 END ELSE 0 END', name='final_size')} FROM y",
)
def order_screening(spark, d):
    pos = _positions(spark, d)
    rho = X.asset_correlations(X.with_returns(V.bars(spark, d)), [f"S{i}" for i in range(12)]).filter("a < b").select("a", "b", "correlation")
    s = K.screen_orders(_orders(spark, d), K.position_context(pos), 50_000.0, _calendar(spark, d).select(F.col("ev").alias("scheduled_time")), K.correlated_symbols(pos, rho))
    return rounded(s.select("order_id", "block_reason", "approved", "kelly_final", "final_size"))


@query("screening_summary", _O + _CTX + _CORR + _RULES + " SELECT coalesce(block_reason, 'approved') AS outcome, count(*) AS n FROM y GROUP BY 1")
def screening_summary(spark, d):
    s = order_screening(spark, d)
    return s.groupBy(F.coalesce("block_reason", F.lit("approved")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "position_context",
    V.with_views("trades") + f""", p AS (SELECT * FROM trades) SELECT count(*) AS open_count, {r('sum(size * entry_price) / 1e6', 4, 'open_notional_mn')} FROM p""",
)
def position_context(spark, d):
    p = V.trades(spark, d).select(F.col("symbol").cast("string").alias("symbol"), "size", "entry_price")
    c = K.position_context(p)
    return rounded(c.select("open_count", (F.col("open_notional") / 1e6).alias("open_notional_mn")), 4)


_LOSS = """, p AS (SELECT seq, symbol, timestamp, (seq % 41 - 21) * 10.0e0 AS pnl FROM ticks),
    l AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, date_trunc('day', timestamp) ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS dp, sum(pnl) OVER (PARTITION BY symbol ORDER BY timestamp RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS r30 FROM p)"""


def _loss(spark, d):
    p = V.ticks(spark, d).select("seq", "symbol", "timestamp", ((F.col("seq") % 41 - 21) * 10.0).alias("pnl"))
    return K.loss_windows(p, ("symbol",), "timestamp", "pnl")


@query("loss_windows", V.with_views("ticks") + _LOSS + f" SELECT seq, {r('dp', name='daily_pnl')}, {r('r30', name='pnl_30m')} FROM l")
def loss_windows(spark, d):
    return rounded(_loss(spark, d).select("seq", "daily_pnl", "pnl_30m"))


@query(
    "breaker_triggers",
    V.with_views("ticks") + _LOSS + """, t AS (SELECT *, seq % 40 + 10.0e0 AS v1, seq % 37 + 10.0e0 AS v0, seq % 70 AS sil FROM l)
    SELECT seq, CASE WHEN -dp / 10000 > 0.03 THEN 'daily_drawdown' WHEN -r30 / 10000 > 0.02 THEN 'intraday_loss' WHEN (v1 - v0) / v0 > 0.2 THEN 'vix_spike' WHEN sil > 60 THEN 'source_silent' END AS trigger FROM t""",
)
def breaker_triggers(spark, d):
    x = _loss(spark, d).withColumn("capital", F.lit(10_000.0)).withColumn("vix", F.col("seq") % 40 + 10.0).withColumn("vix_1h_ago", F.col("seq") % 37 + 10.0).withColumn("silence_seconds", F.col("seq") % 70)
    return x.select("seq", K.breaker_triggers(x).alias("trigger"))
