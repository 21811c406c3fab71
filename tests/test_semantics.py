"""Hand-computed cases for operators without a SQL twin, file readers, and streams."""

import json
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.functions.special import normal_cdf, t_two_sided
from tickloom.operators import performance as P
from tickloom.operators import quality as Q
from tickloom.operators import research as R
from tickloom.operators import risk as K
from tickloom.operators import scoring as S
from tickloom.operators import store as ST
from tickloom.sources import calendars as C
from tickloom.sources import ingest as I
from tickloom.sources import views as V


def test_distributions(spark):
    d = spark.createDataFrame([(0.0,), (1.959963985,)], "z double").select(normal_cdf("z").alias("p")).collect()
    assert [r.p for r in d] == pytest.approx([0.5, 0.975], abs=1e-9)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_window_ic():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 40).astype(float), rng.normal(size=40)
    got = R._window_ic(x, y, 20, np.array([19, 30, 39]))
    import pandas as pd

    for g, e in zip(got, (19, 30, 39)):
        a, b = pd.Series(x[e - 19 : e + 1]).rank(), pd.Series(y[e - 19 : e + 1]).rank()
        assert g == pytest.approx(a.corr(b), abs=1e-12)


def test_combination_of_collinear_columns(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    rows = [(float(u), float(2 * u + 0.01 * e), float(w)) for u, e, w in zip(a, rng.normal(size=300), rng.normal(size=300))]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    col = R.Collinearity(d, ["a", "b", "c"], {"a": 0.01, "b": 0.05})
    assert col.drops() == ["a"] and col.clusters["a"] == col.clusters["b"] != col.clusters["c"]
    assert col.vif()["a"] > 100 and col.vif()["c"] < 1.2
    x = np.array(rows)
    assert col.condition_number() == pytest.approx(np.linalg.cond(x), rel=1e-6)
    res = col.apply(d, "residualize").agg(F.corr("a", "b")).first()[0]
    assert abs(res) < 1e-6
    assert set(col.apply(d, "pca").columns) == {"c", f"pc_{col.clusters['a']}"}


def test_weekend_gap(spark):
    rows = [("2024-01-05", "2024-01-08"), ("2024-01-03", "2024-01-05"), ("2024-01-04", "2024-01-06")]
    d = spark.createDataFrame(rows, "a string, b string").select(Q.weekend_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("w"))
    assert [r.w for r in d.collect()] == [True, False, True]


def test_kelly_and_size_invariants(spark):
    d = spark.range(200).select((F.col("id") / 200.0).alias("p"), (F.col("id") % 40 / 10.0).alias("b"))
    k = d.select(S.kelly_fraction(F.col("p"), F.col("b")).alias("k"))
    assert k.filter("k < 0 or k > 0.25").count() == 0
    s = k.select(S.position_size(F.lit(1000.0), F.col("k"), F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(False)).alias("s"))
    assert s.filter("s > 100.0").count() == 0


def test_statement_surprise(spark):
    rows = [("Unexpected hike to tighten policy",), ("Emergency cut and stimulus support",), ("A routine hike",), ("surprise",)]
    d = spark.createDataFrame(rows, "t string").select(S.statement_surprise(F.col("t")).alias("k"))
    assert [r.k for r in d.collect()] == ["hawkish_surprise", "dovish_surprise", None, None]


def test_screening_order_of_rules(spark):
    o = spark.createDataFrame(
        [(1, "AAA", "long", 100.0, 98.0, 104.0, 1.0, 0.9, 0.2), (2, "BBB", "short", 100.0, 98.0, 104.0, 1.0, 0.9, 0.2), (3, "AAA", "long", 100.0, 98.0, 101.0, 1.0, 0.1, 0.2), (4, "CCC", "long", 100.0, 98.0, 104.0, 1.0, 0.9, 0.2)],
        "order_id int, symbol string, direction string, entry double, stop_loss double, target double, size double, confidence double, kelly double",
    ).withColumn("timestamp", F.lit("2024-01-02").cast("timestamp"))
    pos = spark.createDataFrame([("ZZZ", 1.0, 10.0, "equity")], "symbol string, size double, entry_price double, asset_class string")
    cor = spark.createDataFrame([("zzz", "CCC", 0.8)], "a string, b string, correlation double")
    r = K.screen_orders(o, K.position_context(pos), 10_000.0, correlated=K.correlated_symbols(pos, cor))
    assert {x.order_id: x.block_reason for x in r.collect()} == {1: None, 2: "no_stop_loss", 3: "confidence_too_low", 4: "high_correlation"}


def test_bootstrap_is_reproducible_and_centred(spark):
    rows = [("A", i, 0.01 * math.sin(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "strategy_id string, pos int, ret double")
    a = P.bootstrap_interval(d, statistic="mean", n_boot=60).first()
    b = P.bootstrap_interval(d.repartition(7), statistic="mean", n_boot=60).first()
    assert a == b and a.ci_low < np.mean([r[2] for r in rows]) < a.ci_high


def test_bootstrap_moments_equal_resampled_rows(spark):
    """The blocks of every draw, written out row by row, give the same mean and deviation."""
    rng = np.random.default_rng(9)
    x = {"A": rng.normal(1e3, 1, 137), "B": rng.normal(size=1), "C": np.full(40, 2.5)}
    rows = [(k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)] + [("A", 500, None)]
    d = spark.createDataFrame(rows, "strategy_id string, pos int, ret double").repartition(5)
    for length in (1.0, 6.0, 500.0):
        sizes = d.filter("ret IS NOT NULL").groupBy("strategy_id").agg(F.count("ret").alias("_n"))
        blocks = P.bootstrap_blocks(sizes, ["strategy_id"], F.lit(length), 50).toPandas()
        got = P.bootstrap_moments(d, ["strategy_id"], F.lit(length), 50, rate=2, per_cell=4).toPandas().set_index(["strategy_id", "boot"])
        assert len(got) == 150
        for (k, boot), g in blocks.groupby(["strategy_id", "boot"]):
            v, n = x[k], len(x[k])
            y = np.concatenate([v[(s + np.arange(m)) % n] for s, m in zip(g["start"], g["length"])])
            assert len(y) == n
            r = got.loc[(k, boot)]
            assert r.m == pytest.approx(y.mean(), rel=1e-12)
            assert (np.isnan(r.s) and n == 1) or r.s == pytest.approx(y.std(ddof=1), rel=1e-6, abs=1e-9)
        if length == 6.0:
            assert 3 < blocks[blocks.strategy_id == "A"]["length"].mean() < 8


def test_cost_and_drawdown(spark):
    e = spark.createDataFrame([("A", i, v) for i, v in enumerate([100.0, 120.0, 90.0, 110.0, 130.0, 65.0])], "strategy_id string, pos int, equity double")
    r = P.drawdown(e).first()
    assert r.max_drawdown == pytest.approx(0.5) and r.max_drawdown_duration == 1 and r.max_drawdown_absolute == 65.0
    assert P.expected_max(1) == 0.0


def test_tick_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("btc", 1704067200000, 10.0, 2.0), ("eth", 1704153600000, -1.0, 1.0)], "symbol string, timestamp_ms long, price double, volume double")
    t = I.normalize_ticks(raw)
    assert t.count() == 1
    I.write_ticks(t, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).first()
    assert back.symbol == "BTC" and back.side == "unknown" and back.bid == 10.0 and str(back.date) == "2024-01-01"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("日付,値\n2024/01,\"1,234.5\"\n2024/2/3,-,n.a.,7\n2024-05-06,...\n2023,9\n".encode("shift_jis"))
    rows = I.delimited_macro(I.read_lines(spark, str(tmp_path / "m.csv"))).orderBy("timestamp").collect()
    assert [(str(r.timestamp)[:10], r.value) for r in rows] == [("2023-01-01", 9.0), ("2024-01-01", 1234.5), ("2024-02-03", 7.0)]
    (tmp_path / "k.csv").write_text("1704067200000,1,2,0.5,1.5,10,1704067259999,15,3,0,0,0\n1704067260000,1,2,0.5,1.5,0,1704067319999,0,0,0,0,0\n")
    k = I.normalize_klines(I.read_delimited(spark, str(tmp_path / "k.csv"), I.KLINE).withColumn("symbol", F.lit("X")), "1m").orderBy("timestamp").collect()
    assert float(k[0].vwap) == 1.5 and k[1].vwap is None


def test_meeting_formats(spark):
    html = '<div class="panel panel-default"><div class="panel-heading"><h4>2024</h4></div><div class="fomc-meeting">April 30 - May 1 (Released May 22, 2024)</div><div class="fomc-meeting">June 11-12*</div><div class="fomc-meeting">July 4 (notation vote)</div></div>'
    got = {(r.event_type, str(r.scheduled_time)) for r in C.panel_meetings(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()}
    assert got == {
        ("fomc_statement", "2024-05-01 18:00:00"), ("fomc_minutes", "2024-05-22 18:00:00"), ("fomc_statement", "2024-06-12 18:00:00"), ("fomc_press_conference", "2024-06-12 18:30:00"),
    }


def test_company_facts_first_wins(spark):
    e = lambda v, f="10-K": {"val": v, "form": f, "filed": "2024-02-01"}
    facts = {"facts": {"us-gaap": {"RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [e(2.0)]}}, "Revenues": {"units": {"USD": [e(1.0), e(9.0)]}}, "CommonStockSharesOutstanding": {"units": {"shares": [e(5.0, "10-Q")]}}}}}
    d = spark.createDataFrame([("a", json.dumps(facts))], "asset_id string, payload string")
    got = {(r.metric_name, r.period_type): (r.value, r.currency) for r in I.company_facts(d, ["10-k", "10-Q"], "2024-01-01", "2025-01-01").collect()}
    assert got == {("revenue", "annual"): (1.0, "USD"), ("shares_outstanding", "quarterly"): (5.0, None)}


def test_store_refuses_existing_version(spark, tmp_path):
    f = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "symbol string, x double").withColumn("timestamp", F.timestamp_seconds((F.col("x") * 86400).cast("long")))
    v = ST.tall(f, ["x"], "v1", "2024-01-01")
    ST.save(v, str(tmp_path / "fs"))
    vers = spark.read.parquet(str(tmp_path / "fs/versions"))
    with pytest.raises(ValueError):
        ST.save(v, str(tmp_path / "fs"), vers)
    stored = spark.read.parquet(str(tmp_path / "fs/values"))
    assert ST.load(stored, vers, ["x"], "1970-01-01", "1970-01-03", "2024-06-01").count() == 2
    assert ST.load(stored, vers, ["x"], "1970-01-01", "1970-01-03", "2023-06-01").count() == 0
    assert ST.version_name("a", {"b": 1}, "t") == ST.version_name("a", {"b": 1}, "t") != ST.version_name("a", {"b": 2}, "t")


def test_stream_equals_batch(spark):
    from tickloom.catalog import streams
    from tickloom.operators import orderflow as O
    from tickloom.streaming import jobs as J

    play = J.Replay(spark)
    s = play.drain(J.microstructure_stream(streams._stream(spark, SF, play))).toPandas().sort_values("seq").set_index("seq")
    b = O.recent_microstructure(V.ticks(spark, SF)).toPandas().sort_values("seq").set_index("seq")
    cols = ["ofi", "cvd", "kyle_lambda", "spread_bps", "trade_intensity"]
    assert s["absorption"].astype(bool).equals(b["absorption"])
    np.testing.assert_allclose(s[cols].to_numpy(), b[cols].to_numpy(), rtol=1e-7, atol=1e-9)


def test_breaker_state_machine():
    import pandas as pd

    from tickloom.streaming import jobs as J

    minute = 60_000_000
    rows = pd.DataFrame({"us": [m * minute for m in (0, 1, 5, 31, 32, 65)], "seq": range(6), "trigger": [None, "vix_spike", None, None, None, None], "pnl": [np.nan, np.nan, np.nan, -1.0, np.nan, 2.0]})
    for cut in range(7):  # in one go or in two
        state, parts = None, []
        for part in (rows[:cut], rows[cut:]):
            if len(part):
                state, out = J._breaker(30 * minute)(state, part.reset_index(drop=True))
                parts.append(out)
        out = pd.concat(parts)
        assert out["status"].tolist() == ["CLOSED", "OPEN", "OPEN", "OPEN", "OPEN", "CLOSED"]
        assert out["allowed"].tolist() == [True, False, False, True, False, True]


def test_buckets_close_where_a_loop_over_ticks_closes_them():
    import pandas as pd

    from tickloom.streaming import jobs as J

    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"us": np.arange(400), "seq": np.arange(400), "quantity": rng.integers(1, 60, 400).astype(float), "share": rng.choice([0.0, 0.4, 0.6, 1.0], 400)})
    rows.loc[50, "quantity"] = 900.0  # several buckets at once: one closes with each tick
    buy = sell = 0.0
    want = []
    for us, q, share in zip(rows["us"], rows["quantity"], rows["share"]):
        buy, sell = buy + q * share, sell + q * (1 - share)
        if buy + sell >= 200:
            rest = (buy + sell - 200) / (buy + sell)
            want.append((us, buy * (1 - rest), sell * (1 - rest)))
            buy, sell = buy * rest, sell * rest
    state, parts = None, []
    for part in (rows[:33], rows[33:210], rows[210:]):
        state, out = J._buckets(200.0, 5)(state, part.reset_index(drop=True))
        parts.append(out)
    out = pd.concat(parts)
    assert out["us"].tolist() == [w[0] for w in want] and out["bucket"].tolist() == list(range(len(want)))
    np.testing.assert_allclose(out[["buy_volume", "sell_volume"]].to_numpy(float), np.array([w[1:] for w in want]), rtol=1e-9)


def _trades(spark, results):
    """Trades of strategies {name: [net_pnl, ...]}, one a day."""
    rows = [(k, f"{k}{i}", i, float(p), "ab"[i % 2], "xyz"[i % 3], None if i % 5 == 0 else "s") for k, ps in results.items() for i, p in enumerate(ps)]
    d = spark.createDataFrame(rows, "strategy_id string, trade_id string, i int, net_pnl double, session string, regime string, signal_type string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 86_400)
    return d.select("*", (at - F.expr("INTERVAL 1 HOUR")).alias("entry_time"), at.alias("exit_time"), F.lit(100.0).alias("entry_price"), F.lit(2.0).alias("size")).drop("i")


def test_full_report_is_consistent(spark):
    rnd = np.random.default_rng(3)
    t = _trades(spark, {"up": rnd.normal(120, 300, 200), "flat": [0.0] * 20, "one": [50.0]})
    out = {r.strategy_id: r for r in P.full_report(t, n_trials=5, oos_fraction=0.3, n_boot=300).collect()}
    assert out.keys() == {"up", "flat", "one"}
    up = out["up"]
    for p, z in ((up.psr, up.psr_z), (up.dsr, up.dsr_z)):
        assert abs(p - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6
    assert up.dsr < up.psr and up.sharpe_ci_95_low < up.sharpe < up.sharpe_ci_95_high
    assert [x.label for x in up.by_session] == ["a", "b"] and [x.label for x in up.by_signal] == ["s", "unknown"]
    assert sum(x.trade_count for x in up.by_regime) == up.trade_count == 200
    totals = [x.total_pnl for x in up.by_regime]
    assert abs(up.regime_concentration - sum(v * v for v in totals) / sum(map(abs, totals)) ** 2) < 1e-9
    # 60 trades after the split, those of the last five days before it are left out
    assert (up.is_report.trade_count, up.oos_report.trade_count) == (135, 60)
    assert abs(up.oos_sharpe_degradation - (up.is_report.sharpe - up.oos_report.sharpe) / abs(up.is_report.sharpe) * 100) < 1e-9
    assert out["flat"].total_pnl == 0 and out["flat"].max_drawdown == 0
    assert out["one"].is_report is None and out["one"].oos_report.trade_count == 1 and out["one"].oos_sharpe_degradation == 0


def test_full_report_of_nothing(spark):
    t = _trades(spark, {"a": [1.0]}).filter("net_pnl < 0")
    assert P.full_report(t, oos_fraction=0.3, n_boot=10).count() == 0
    with pytest.raises(ValueError):
        P.full_report(t, oos_fraction=1.0)
