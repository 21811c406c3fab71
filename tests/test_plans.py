"""Split evaluation equals unsplit evaluation; the future does not change the past."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import orderflow as O
from tickloom.operators import volatility as X
from tickloom.plans.asof import asof_join
from tickloom.plans.ordered import INDEX, Ordered, TICKS
from tickloom.plans.ranks import average_ranks, below, cells
from tickloom.plans.recursion import decay, excitation
from tickloom.plans.spans import interval_join
from tickloom.sources import views as V


@pytest.fixture(scope="module")
def ticks(spark):
    return V.ticks(spark, SF).cache()


@pytest.fixture(scope="module")
def one_symbol(ticks):
    """The whole table as a single busy series."""
    return ticks.withColumn("symbol", F.lit("HOT"))


def test_running_equals_window(one_symbol):
    small = TICKS.with_(bucket_seconds=7200)
    got = small.running(one_symbol, {"cum": F.col("quantity")}, {"top": F.col("price")})
    w = Window.partitionBy("symbol").orderBy("timestamp", "seq")
    want = one_symbol.select(
        "seq", (F.row_number().over(w) - 1).alias("i"), F.sum("quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.max("price").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m")
    )
    j = got.join(want, "seq")
    assert j.count() == one_symbol.count()
    assert j.filter((F.col(INDEX) != F.col("i")) | (F.abs(F.col("cum") - F.col("c")) > 1e-9) | (F.col("top") != F.col("m"))).count() == 0


@pytest.mark.parametrize("fn", [O.order_flow, O.cvd_kyle, O.recent_microstructure])
def test_small_chunks_change_nothing(one_symbol, fn):
    a = fn(one_symbol).toPandas().sort_values("seq").set_index("seq")
    b = fn(one_symbol, s=TICKS.with_(chunk_rows=400, bucket_seconds=7200)).toPandas().sort_values("seq").set_index("seq")
    assert len(a) == len(b) == one_symbol.count()
    num = [c for c in a.columns if a[c].dtype == float]
    np.testing.assert_allclose(a[num].to_numpy(), b[num].to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("fn", [O.order_flow, O.cvd_kyle, O.recent_microstructure])
def test_no_look_ahead(ticks, fn):
    cut = ticks.selectExpr("percentile(unix_micros(timestamp), 0.6)").first()[0]
    past = ticks.filter(F.unix_micros("timestamp") <= cut)
    full = fn(ticks).filter(F.unix_micros("timestamp") <= cut).toPandas().sort_values("seq").set_index("seq")
    part = fn(past).toPandas().sort_values("seq").set_index("seq")
    num = [c for c in full.columns if full[c].dtype == float]
    np.testing.assert_allclose(full[num].to_numpy(), part[num].to_numpy(), rtol=1e-12, atol=1e-12, equal_nan=True)


def test_signals_are_bounded(ticks):
    r = O.order_flow(ticks).agg(F.max(F.abs("ofi_signal"))).first()[0]
    assert r is None or r <= 1.0


def test_decay_equals_loop(one_symbol):
    a = 0.9
    s = TICKS.with_(bucket_seconds=7200)
    got = decay(s.running(one_symbol), s, a, {"y": F.col("quantity")}).toPandas().sort_values(["timestamp", "seq"])
    y, want = 0.0, []
    for q in got["quantity"]:
        y = a * y + q
        want.append(y)
    np.testing.assert_allclose(got["y"], want, rtol=1e-12)


def test_excitation_equals_sum(spark):
    t = [0.0, 0.5, 0.5, 3.0, 400.0, 401.0, 2000.0]
    df = spark.createDataFrame([("A", x) for x in t], "symbol string, s double").withColumn("timestamp", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = excitation(df, ("symbol",), "timestamp", 0.5, 1.0).toPandas().sort_values("s")
    want = [sum(0.5 * math.exp(-(x - u)) for u in t if u < x) for x in t]
    np.testing.assert_allclose(got["excitation"], want, atol=1e-15)


def test_excitation_of_a_busy_stretch(spark):
    """Ten thousand events in a few blocks, many at equal times, cut into small cells."""
    rng = np.random.default_rng(8)
    us = np.sort(np.r_[rng.integers(0, 90_000, 4000) * 10_000, rng.integers(0, 10**10, 200)])
    df = spark.createDataFrame([("A", i, int(u)) for i, u in enumerate(us)] + [("A", 9999, None)], "symbol string, i int, us long").withColumn("timestamp", F.timestamp_micros("us"))
    got = excitation(df, ("symbol",), "timestamp", 0.5, 1.0, rate=8, per_cell=4).toPandas().set_index("i").sort_index()
    y, last, want = 0.0, us[0], []
    for u, c in zip(*np.unique(us, return_counts=True)):
        y *= math.exp(-(u - last) / 1e6)
        want += [0.5 * y] * c
        y, last = y + c, u
    np.testing.assert_allclose(got.loc[: len(us) - 1, "excitation"], want, rtol=1e-9, atol=1e-12)
    assert np.isnan(got.loc[9999, "excitation"])


def test_asof(spark):
    ts = lambda d: d.withColumn("t", F.timestamp_seconds("t"))
    left = ts(spark.createDataFrame([("A", 5, 1), ("A", 10, 2), ("A", 200000, 3), ("B", 1, 4)], "k string, t long, id int"))
    right = ts(spark.createDataFrame([("A", 5, 50), ("A", 9, 90), ("B", 2, 20)], "k string, t long, v int"))
    strict = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"], True, 100).collect()}
    loose = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"], False, 100).collect()}
    assert strict == {1: None, 2: 90, 3: 90, 4: None}
    assert loose == {1: 50, 2: 90, 3: 90, 4: None}
    cut = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"], True, rate=1, per_cell=1).collect()}
    assert cut == strict


def test_asof_of_a_bursty_key(spark):
    """Nearly all times of one key lie in one second: cells follow the rows, not the clock."""
    rng = np.random.default_rng(5)
    us = np.unique(np.r_[rng.integers(0, 1_000_000, 6000), rng.integers(0, 10**12, 300)])
    side = rng.integers(0, 2, len(us))
    df = spark.createDataFrame([("A", int(u), int(z)) for u, z in zip(us, side)], "k string, us long, side int").withColumn("t", F.timestamp_micros("us"))
    left, right = df.filter("side = 0").select("k", "t", "us"), df.filter("side = 1").select("k", "t", F.col("us").alias("v"))
    opts = dict(rate=16, per_cell=8)
    got = {r.us: r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"], True, **opts).collect()}
    old = us[side == 1]
    want = {int(u): (int(old[i - 1]) if (i := np.searchsorted(old, u)) else None) for u in us[side == 0]}
    assert got == want
    most = cells(df, ["k"], "us", **opts).groupBy("_cell").count().agg({"count": "max"}).first()[0]
    assert most < 1000


def test_interval_join(spark):
    p = spark.createDataFrame([(i, i * 600) for i in range(20)], "id int, s long").select("id", F.timestamp_seconds("s").alias("t"))
    iv = spark.createDataFrame([(1, 1000, 5000), (2, 4800, 4801)], "ev int, a long, b long").select("ev", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    got = {(r.id, r.ev) for r in interval_join(p, iv, "t", "a", "b").collect()}
    assert got == {(i, 1) for i in range(20) if 1000 <= i * 600 < 5000} | {(8, 2)}


def test_interval_join_over_all_lengths(spark):
    """Intervals from nothing to months, nested and touching; null and reversed ones; both kinds of end; keys."""
    rng = np.random.default_rng(6)
    pts = [(i, "ab"[i % 2], int(x)) for i, x in enumerate(rng.integers(0, 10**7, 400))]
    iv = [(i, "ab"[i % 2], int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-(10**6), 10**7, 80), (2 ** rng.uniform(0, 23, 80)).astype(int)))]
    iv += [(80, "a", pts[0][2], pts[0][2]), (81, "a", 50, 40), (82, "a", None, 40), (83, "a", 40, None)]
    p = spark.createDataFrame(pts, "id int, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("t"))
    v = spark.createDataFrame(iv, "ev int, k string, a long, b long").select("ev", "k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    for closed in (False, True):
        got = sorted((r.id, r.ev) for r in interval_join(p, v, "t", "a", "b", ["k"], closed_end=closed).collect())
        inside = lambda s, a, b: None not in (a, b) and a <= s and (s <= b if closed else s < b)
        assert got == sorted((i, e) for i, k, s in pts for e, j, a, b in iv if j == k and inside(s, a, b))
    assert interval_join(p, v.filter("ev < 0").drop("k"), "t", "a", "b").count() == 0


def test_average_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, None, 7.5, 7.5, 7.5]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(v)], "k string, i int, v double")
    got = {r.i: r.r for r in average_ranks(df, ["k"], {"v": "r"}, rate=1, per_cell=1).collect()}
    assert got == {0: 3.5, 1: 1.0, 2: 3.5, 3: 2.0, 4: None, 5: 6.0, 6: 6.0, 7: 6.0}


def test_heavy_tail_and_constant_columns(spark):
    """Equal-width cells would put nearly all of a heavy tail in one: sampled splitters keep cells alike."""
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(size=8000) * 9)
    df = spark.createDataFrame([("A", i, float(v), 1.0) for i, v in enumerate(x)], "k string, i int, v double, c double").repartition(6)
    opts = dict(rate=8, per_cell=16, max_cells=64)
    got = average_ranks(df, ["k"], {"v": "r", "c": "s"}, **opts).toPandas().sort_values("i")
    np.testing.assert_array_equal(got["r"], pd.Series(x).rank())
    assert (got["s"] == 4000.5).all()
    sizes = [r["count"] for r in cells(df, ["k"], "v", **opts).groupBy("_cell").count().collect()]
    assert 50 <= len(sizes) <= 64
    assert max(sizes) < 8000 / 20
    assert cells(df, ["k"], "c", **opts).agg({"_cell": "max"}).first()[0] == 0
    low = below(df, [], "v", {"n": F.lit(1), "t": F.col("c")}, **opts).toPandas().sort_values("i")
    np.testing.assert_array_equal(low["n"], pd.Series(x).rank() - 1)
    np.testing.assert_allclose(low["t"], low["n"])
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), ("A", None), ("A", float("nan")), ("A", 3.0)], "k string, v double")
    got = {(r.k, str(r.v)): r.n for r in below(odd, ["k"], "v", {"n": F.lit(1)}, rate=1, per_cell=1).collect()}
    assert got == {(None, "1.0"): 0, (None, "2.0"): 1, ("A", "None"): 0, ("A", "3.0"): 1, ("A", "nan"): 2}
    assert below(odd.filter("false"), ["k"], "v", {"n": F.lit(1)}).count() == 0


def test_har_forecast_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    rv = np.exp(rng.normal(size=60)) * 1e-4
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(rv)], "symbol string, d int, rv double").withColumn("timestamp", F.timestamp_seconds(F.col("d") * 86400)).withColumn("log_return", F.lit(0.0))
    got = X.har_features(None, days=df.drop("d")).toPandas().sort_values("timestamp")["har_rv_forecast"].to_numpy()
    for t in (30, 45, 59):
        h = rv[:t]
        rows = [(1.0, h[j - 1], h[max(0, j - 6) : j - 1].mean(), h[max(0, j - 23) : j - 1].mean()) for j in range(22, t)]
        beta = np.linalg.lstsq(np.array(rows), h[22:], rcond=None)[0]
        want = max(0.0, beta @ np.array([1.0, h[-1], h[-5:].mean(), h[-22:].mean()]))
        assert got[t] == pytest.approx(want, rel=1e-8)
    assert np.isnan(got[:30]).all()


def test_fractional_difference_by_blocks(spark):
    """One key with all rows, more weights than a chunk would hold, nulls; orders of a grid against the plain sums."""
    import numpy as np

    from tickloom.operators import volatility as X

    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=45_000)) * 0.01 + 5
    holes = {20_000, 20_001, 44_000}
    rows = [("A", i, None if i in holes else float(v)) for i, v in enumerate(x)] + [("B", i, float(i % 3)) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, s long, p double").selectExpr("symbol", "timestamp_seconds(s) AS timestamp", "p", "s")
    out = {(r.symbol, r.s): r.frac_diff for r in X.frac_diff(df, 0.4, "p").collect()}
    w = np.array(X.frac_weights(0.4))
    n = len(w)
    assert n > 1000 and len(out) == len(x) - n + 1
    bad = {i for h in holes for i in range(h, h + n)}
    for i in range(n - 1, len(x), 97):
        if i in bad:
            assert out["A", i] is None
        else:
            assert abs(out["A", i] - float(w @ x[i - n + 1 : i + 1][::-1])) < 1e-9
    chunks = X._series(("symbol",), ("timestamp",), n).chunks(df, halo=n - 1).groupBy("symbol", "_c").count()
    assert chunks.agg({"count": "max"}).first()[0] <= 16_384 + n

    short = df.where("symbol = 'A' and s < 20000")
    got = X.minimum_d(short, "p", steps=6).collect()
    y = x[:20_000]
    for step in range(6):
        d = step / 5
        w = np.array(X.frac_weights(d))
        z = np.convolve(y, w)[len(w) - 1 : len(y)]
        level, change = z[:-1], np.diff(z)
        a, b = level - level.mean(), change - change.mean()
        slope = (a @ b) / (a @ a)
        t = slope / np.sqrt(max(1e-12, (b @ b - slope * (a @ b)) / (len(a) - 2) / (a @ a)))
        if t < -2.86 or step == 5:
            assert abs(got[0].d - d) < 1e-12 and got[0].n_lags == len(w) and abs(got[0].t_stat - t) < 1e-6 * abs(t)
            break
    assert abs(X.memory_retained(0.0, 1) - 1.0) < 1e-12 and 0 < X.memory_retained(0.4, 100) < 1


def test_frame_sums_keep_small_values_after_large_ones(spark):
    """1e9 long before a frame of values about 1e-8 leaves no trace in its sum, in every chunk."""
    x = [1e9 if i < 5 else (i * 31 % 17) * 1e-9 for i in range(95)]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "symbol string, seq long, v double").withColumn("timestamp", F.timestamp_seconds("seq"))
    s = Ordered(chunk_rows=30)
    got = s.windowed(d, 11, lambda t: s.frame_sums(t, {"f": F.col("v")}, 7)).orderBy("seq").collect()
    assert len(got) == 95
    for r in got:
        assert r.f == pytest.approx(sum(x[max(0, r.seq - 6) : r.seq + 1]), rel=1e-14, abs=1e-30)
