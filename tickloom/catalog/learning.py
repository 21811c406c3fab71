"""Meta-labelling, model training and regime model queries."""

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import learning as M
from ..operators import orderflow as O
from ..operators import research as R
from ..operators import scoring as S
from ..operators import technical as X
from ..plans.ordered import Ordered
from ..session import cut_lineage
from ..sources import views as V
from . import query, r, rounded, rs
from .labels import _LONG, _labels


def _matrix(spark, d):
    # every input of the joins is computed once: a plan that repeats them outgrows the driver
    b = cut_lineage(V.bars(spark, d))
    t = O.order_flow(V.ticks(spark, d))
    sig = t.groupBy("symbol", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.max_by("ofi_signal", "seq").alias("ofi_signal"), F.max_by(F.col("bid_size") - F.col("ask_size"), "seq").alias("g"))
    sig = sig.join(b.select("symbol", "timestamp", "high", "low"), ["symbol", "timestamp"]).select("symbol", "timestamp", "ofi_signal", F.tanh(F.col("g") / 5).alias("gex_signal"), F.tanh((F.col("high") - F.col("low")) / 100).alias("har_rv_signal")).filter("ofi_signal IS NOT NULL")
    reg = X.trend_regime(b).select("symbol", "timestamp", S.volatility_regime(F.col("close") % 40).alias("vol_regime"), F.col("trend").alias("trend_regime"))
    lab = L.barrier_labels(b).select("symbol", "t0", "t1", "binary_target")
    return M.feature_matrix(cut_lineage(lab), cut_lineage(sig), cut_lineage(reg), b)


_VOL = """, lr AS (SELECT symbol, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY timestamp)) AS r FROM bars_1h),
    v AS (SELECT symbol, timestamp, CASE WHEN count(r) OVER n = 28 THEN stddev_pop(r) OVER n END AS vol FROM lr WINDOW n AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))"""


@query(
    "meta_feature_matrix",
    V.with_views("bars_1h") + _LONG + _VOL + f""" SELECT lab.symbol, t0, {r('v.vol', name='realized_vol_28')}, {r('sin(hour(t0) * 2 * pi() / 24)', name='hour_of_day_sin')}, {r('sin((isodow(t0) - 1) * 2 * pi() / 7)', name='day_of_week_sin')} FROM lab ASOF LEFT JOIN v ON lab.symbol = v.symbol AND lab.t0 > v.timestamp""",
)
def meta_feature_matrix(spark, d):
    return rounded(_matrix(spark, d).select("symbol", "t0", "realized_vol_28", "hour_of_day_sin", "day_of_week_sin"))


@query("meta_feature_gaps")
def meta_feature_gaps(spark, d):
    return M.incomplete(_matrix(spark, d))


def _labelled(spark, d):
    x = _matrix(spark, d).dropna(subset=list(M.FEATURES))
    return cut_lineage(x.withColumn("y", F.col("binary_target").cast("int")).drop("binary_target").withColumn("weight", F.lit(1.0)))


def _training(x, n_splits=6, n_test=2):
    s = R.combinatorial_splits(x.withColumn("book", F.lit("all")), Ordered(keys=("book",), order=("t0", "symbol"), time="t0"), n_splits, n_test, 0.02)
    return cut_lineage(s.drop("pos", "grp"))


@query("baseline_training")
def baseline_training(spark, d):
    p = M.train_baseline(_training(_labelled(spark, d)))
    return rounded(M.fold_scores(p), 6)


@query("feature_importance")
def feature_importance(spark, d):
    return rounded(M.importances(_labelled(spark, d)), 6)


@query("acceptance_gates")
def acceptance_gates(spark, d):
    x = _labelled(spark, d)
    p = M.train_baseline(_training(x))
    return rounded(M.gates(M.fold_scores(p), x, F.lit(0.5), F.lit(0.2)), 6)


@query("nested_tuning")
def nested_tuning(spark, d):
    t = _training(_labelled(spark, d), 2, 1)

    def inner(train):
        s = R.combinatorial_splits(train.drop("split_id"), Ordered(keys=("book",), order=("t0", "symbol"), time="t0"), 2, 1, 0.02)
        return s.withColumnRenamed("split_id", "inner_id").drop("pos", "grp")

    return rounded(M.nested_tuning(t, inner, M.grid((5,), (2, 4), (20,))), 6)


@query(
    "event_annualization",
    V.with_views("bars_1h") + _LONG + f""", g AS (SELECT symbol, epoch(t0) - lag(epoch(t0)) OVER (PARTITION BY symbol ORDER BY t0) AS d FROM lab) SELECT symbol, {r('sqrt(greatest(252 * 6.5e0 * 3600 / median(d), 1))', name='annual_factor')} FROM g GROUP BY 1""",
)
def event_annualization(spark, d):
    return rounded(M.annualization(_labels(spark, d)))
