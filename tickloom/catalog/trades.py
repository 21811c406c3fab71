"""Trade and position queries."""

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import trades as T
from ..sources import views as V
from . import query, r, rounded, rs

_T = V.with_views("trades")
_STAT = f"count(*) AS trade_count, {r('avg((net_pnl > 0)::INT)', name='win_rate')}, {r('avg(net_pnl)', 4, 'avg_pnl')}, {r('sum(net_pnl)', 3, 'total_pnl')}"
_DIMS = ("signal_type", "regime", "session")


def _trades(spark, d):
    return V.trades(spark, d)


def _r(df):
    """Money to three digits, the rest to six."""
    out = rounded(df.withColumns({c: F.round(F.col(c) + 1.7e-8, 4) for c in ("avg_pnl",) if c in df.columns} | {c: F.round(F.col(c) + 1.7e-7, 3) for c in ("total_pnl", "realized_pnl") if c in df.columns}))
    return out


@query("trade_group_stats", _T + " " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS label, {_STAT} FROM trades GROUP BY {x}" for x in _DIMS))
def trade_group_stats(spark, d):
    return _r(T.group_stats(_trades(spark, d), _DIMS))


@query(
    "best_configurations",
    _T + f" SELECT signal_type, regime, session, {r('avg(net_pnl) / stddev_samp(net_pnl)', name='sharpe')} FROM trades GROUP BY ALL ORDER BY avg(net_pnl) / stddev_samp(net_pnl) DESC LIMIT 3",
)
def best_configurations(spark, d):
    return rounded(T.best_configurations(_trades(spark, d), _DIMS))


_PF = "sum(net_pnl) FILTER (net_pnl > 0) / -sum(net_pnl) FILTER (net_pnl < 0)"


@query(
    "win_loss_summary",
    _T + f""" SELECT strategy_id, count(*) AS trade_count, {r('avg((net_pnl > 0)::INT)', name='win_rate')}, {r('avg(net_pnl) FILTER (net_pnl > 0)', 4, 'avg_win')}, {r('-avg(net_pnl) FILTER (net_pnl < 0)', 4, 'avg_loss')}, {r(_PF, 4, 'profit_factor')} FROM trades GROUP BY 1""",
)
def win_loss_summary(spark, d):
    t = T.win_loss(_trades(spark, d), ("strategy_id",))
    return rounded(rounded(t.withColumns({c: F.round(F.col(c) + 1.7e-8, 4) for c in ("avg_win", "avg_loss", "profit_factor")})))


@query(
    "regime_concentration",
    _T + f""", g AS (SELECT strategy_id, regime, sum(net_pnl) AS p FROM trades GROUP BY 1, 2) SELECT strategy_id, {r('sum(p * p) / (sum(abs(p)) * sum(abs(p)))', name='hhi')} FROM g GROUP BY 1""",
)
def regime_concentration(spark, d):
    g = _trades(spark, d).groupBy("strategy_id", "regime").agg(F.sum("net_pnl").alias("total_pnl"))
    return rounded(T.concentration(g, ("strategy_id",)))


@query(
    "kelly_inputs",
    _T + f""", x AS (SELECT *, abs(exit_price / entry_price - 1) AS pct FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY exit_time DESC, trade_id DESC) <= 50),
    g AS (SELECT symbol, count(*) AS n, avg((net_pnl > 0)::INT) AS wr, coalesce(avg(pct) FILTER (net_pnl > 0), 0) AS w, coalesce(avg(pct) FILTER (net_pnl <= 0), 0) AS l FROM x GROUP BY 1)
    SELECT symbol, n AS n_trades, {r('wr', name='win_rate')}, {r('CASE WHEN l > 0 THEN w / l ELSE 1.5 END', name='avg_rr')} FROM g WHERE n >= 5""",
)
def kelly_inputs(spark, d):
    return rounded(T.kelly_inputs(_trades(spark, d)))


@query(
    "daily_realized_pnl",
    _T + f" SELECT strategy_id, {r('sum(net_pnl)', 3, 'realized_pnl')}, count(*) AS trade_count FROM trades WHERE exit_time >= TIMESTAMP '1998-05-05' AND exit_time < TIMESTAMP '1998-05-06' GROUP BY 1",
)
def daily_realized_pnl(spark, d):
    return _r(T.realized(_trades(spark, d), ("strategy_id",), F.lit("1998-05-05").cast("timestamp")))


_REC = """, rec AS (SELECT CASE WHEN seq % 3 = 0 THEN symbol || 'USDT' ELSE symbol END AS symbol, symbol AS base, seq, CASE WHEN seq % 11 = 0 THEN 'bad' WHEN seq % 2 = 0 THEN CAST(CAST(-quantity AS INTEGER) AS VARCHAR) ELSE CAST(CAST(quantity AS INTEGER) AS VARCHAR) END AS size,
      CASE WHEN seq % 5 <> 0 THEN CAST(CAST(floor(price) AS INTEGER) AS VARCHAR) END AS entry_price, CAST(seq % 300 AS VARCHAR) AS entry, CASE WHEN seq % 7 = 0 THEN 'forex' WHEN seq % 7 = 1 THEN '' END AS asset_class FROM ticks),
    pos AS (SELECT symbol, base, seq, abs(TRY_CAST(size AS DOUBLE)) AS size, TRY_CAST(coalesce(entry_price, entry) AS DOUBLE) AS entry_price,
      CASE WHEN asset_class <> '' THEN asset_class WHEN symbol LIKE '%USDT' THEN 'crypto' ELSE 'equity' END AS asset_class FROM rec),
    op AS (SELECT * FROM pos WHERE size > 0 AND entry_price > 0)"""


def _records(spark, d):
    t = V.ticks(spark, d)
    q = F.col("quantity").cast("int")
    return t.select(
        F.when(F.col("seq") % 3 == 0, F.concat("symbol", F.lit("USDT"))).otherwise(F.col("symbol")).alias("symbol"),
        F.when(F.col("seq") % 11 == 0, "bad").when(F.col("seq") % 2 == 0, (-q).cast("string")).otherwise(q.cast("string")).alias("size"),
        F.when(F.col("seq") % 5 != 0, F.floor("price").cast("string")).alias("entry_price"),
        (F.col("seq") % 300).cast("string").alias("entry"),
        F.when(F.col("seq") % 7 == 0, "forex").when(F.col("seq") % 7 == 1, "").alias("asset_class"),
    )


@query("open_positions", V.with_views("ticks") + _REC + " SELECT symbol, size, entry_price, asset_class FROM op")
def open_positions(spark, d):
    return T.open_positions(_records(spark, d))


@query(
    "exposure_by_class",
    V.with_views("ticks") + _REC + f" SELECT asset_class, {r('sum(size * entry_price)', 3, 'exposure')}, count(*) AS n_positions FROM op GROUP BY 1",
)
def exposure_by_class(spark, d):
    return rounded(T.exposure(T.open_positions(_records(spark, d)), ("asset_class",)), 3)


@query(
    "unrealized_pnl",
    _T + f""", lp AS (SELECT symbol, arg_max(exit_price, (exit_time, trade_id)) AS p FROM trades GROUP BY 1)
    SELECT strategy_id, {r("sum((p - entry_price) * size * CASE WHEN direction = 'short' THEN -1 ELSE 1 END)", 2, 'unrealized_pnl')} FROM trades JOIN lp USING (symbol) GROUP BY 1""",
)
def unrealized_pnl(spark, d):
    t = _trades(spark, d)
    last = t.groupBy("symbol").agg(F.max_by("exit_price", F.struct("exit_time", "trade_id")).alias("price"))
    return rounded(T.unrealized(t, last, ("strategy_id",)), 2)


@query(
    "rolling_win_rate",
    _T + f""", x AS (SELECT trade_id, strategy_id, row_number() OVER w AS n, avg((net_pnl > 0)::INT) OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS wr, avg((net_pnl > 0)::INT) OVER (PARTITION BY strategy_id) AS b
      FROM trades WINDOW w AS (PARTITION BY strategy_id ORDER BY exit_time, trade_id))
    SELECT trade_id, {r('wr', name='win_rate')}, {r('b', name='baseline')}, n >= 50 AND (b - wr) / b >= 0.1 AS relative_drift, b - wr > 0.1 AS absolute_drift FROM x""",
)
def rolling_win_rate(spark, d):
    t = T.rolling_win_rate(_trades(spark, d))
    return rounded(t.select("trade_id", "win_rate", "baseline", "relative_drift", "absolute_drift"))


@query(
    "outcome_correlation",
    _T + f""" SELECT strategy_id, count(*) AS n, {r('covar_pop(s, net_pnl) / (stddev_pop(s) * stddev_pop(net_pnl))', name='correlation')} FROM (SELECT *, (l_discount_proxy) AS s FROM (SELECT *, gross_pnl / (entry_price * size) AS l_discount_proxy FROM trades)) GROUP BY 1""",
)
def outcome_correlation(spark, d):
    t = _trades(spark, d)
    s = t.select("trade_id", (F.col("gross_pnl") / (F.col("entry_price") * F.col("size"))).alias("strength"))
    return rounded(T.outcome_correlation(s, t, keys=("strategy_id",)))


@query("duplicate_trades", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def duplicate_trades(spark, d):
    """Ids seen once after suppression, with how often each occurred."""
    li = V.table(spark, d, "lineitem").withColumn("trade_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    kept = T.unique_trades(li).select("l_orderkey", "l_linenumber", "trade_id")
    n = li.groupBy("trade_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, "trade_id").drop("trade_id")


@query(
    "r_multiples",
    _T + f" SELECT trade_id, {r('CASE WHEN abs(entry_price - exit_price) * size > 0 THEN net_pnl / (abs(entry_price - exit_price) * size) END', name='r_multiple')}, {r('net_pnl / CASE WHEN entry_price = exit_price THEN 1 ELSE abs(entry_price - exit_price) END', name='r_multiple_unit')} FROM trades",
)
def r_multiples(spark, d):
    return rounded(S.r_multiples(_trades(spark, d)).select("trade_id", "r_multiple", "r_multiple_unit"))


@query(
    "alpha_half_life",
    _T + f""", o AS (SELECT strategy_id, net_pnl / abs(entry_price * size) AS x, row_number() OVER w - 1 AS i, sum(net_pnl / abs(entry_price * size)) OVER (PARTITION BY strategy_id ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS c FROM trades WINDOW w AS (PARTITION BY strategy_id ORDER BY exit_time, trade_id)),
    st AS (SELECT strategy_id, count(*) AS n, greatest(3, count(*) // 10) AS win, epoch(max(exit_time) - min(exit_time)) / 86400.0e0 AS days FROM trades GROUP BY 1),
    e AS (SELECT o.strategy_id, n, days, o.i - win + 1 AS x, (o.c - coalesce(b.c, 0)) / win AS e FROM o JOIN st USING (strategy_id) LEFT JOIN o b ON b.strategy_id = o.strategy_id AND b.i = o.i - win WHERE o.i >= win - 1),
    g AS (SELECT strategy_id, n, days, regr_slope(ln(e), x) AS k, regr_r2(ln(e), x) AS r2, count(*) AS m FROM e WHERE e > 0 GROUP BY ALL)
    SELECT strategy_id, {r('CASE WHEN g.n >= 10 AND m >= 3 AND r2 >= 0.3 AND g.days > 0 AND k < 0 THEN 0.6931471805599453e0 / -k * g.days / greatest(g.n - 1, 1) END', name='half_life_days')} FROM st LEFT JOIN g USING (strategy_id)""",
)
def alpha_half_life(spark, d):
    return rounded(T.decay_half_life(_trades(spark, d)))
