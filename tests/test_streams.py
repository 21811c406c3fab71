"""Streams give the same rows whatever a trigger holds, and nothing is left out unseen."""

import random
import time
import tracemalloc
from types import SimpleNamespace

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.sources import views as V
from tickloom.streaming import jobs as J



def _raw(t):
    t = t.withColumn("account", F.col("symbol"))
    three = t.where("seq % 3 = 0").withColumn("pnl", F.col("seq") % 41 - 21), t.where("seq % 3 = 1").withColumn("vix", F.col("seq") % 17 + 30.0)
    return (*three, t.where("seq % 3 = 2 or seq is null").withColumn("source", F.lit("feed")))


JOBS = {
    "bars": lambda t, d: J.tumbling_bars(t, (3600,), d),
    "microstructure": J.microstructure_stream,
    "order_flow": J.feature_stream,
    "vpin": lambda t, d: J.vpin_stream(t, 500.0, delay=d),
    "breaker": lambda t, d: J.breaker_stream(t.select(F.col("symbol").alias("account"), "seq", "timestamp", F.when(F.col("seq") % 7 == 0, "drawdown").alias("trigger"), F.when(F.col("seq") % 3 == 0, F.col("seq") % 41 - 20).alias("pnl")), delay=d),
    "raw_breaker": lambda t, d: J.triggered_breaker_stream(*_raw(t), 10_000.0, limits={"silence_seconds": 36_000}, delay=d),
    "silence": lambda t, d: J.silence_stream(t.select(F.col("symbol").alias("source"), "timestamp"), 7200, d),
    "regimes": lambda t, d: J.regime_stream(t.select(F.col("symbol").alias("market"), "seq", "timestamp", F.when(F.col("seq") % 2 == 0, "vix").otherwise("dollar_change").alias("kind"), (F.col("seq") % 40 * F.when(F.col("seq") % 2 == 0, 1.0).otherwise(0.02)).alias("value")), d),
    "trades": lambda t, d: J.unique_trade_stream(t.select(F.concat("symbol", (F.col("seq") % 50).cast("string")).alias("trade_id"), F.col("timestamp").alias("exit_time")), "60 days").select("trade_id"),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ticks of a month in six files: a file holds about five days, with rows up to a day out of place."""
    J.use_rocksdb(spark)
    top = tmp_path_factory.mktemp("ticks")
    t = V.ticks(spark, SF).withColumn("bid", F.col("bid").cast("double")).withColumn("ask", F.col("ask").cast("double"))
    rows = t.toPandas()
    order = (rows["timestamp"].astype("int64") // 10**9 + rows["seq"] * 7919 % 86_400).rank(method="first")
    rows["f"] = ((order - 1) * 6 // len(rows)).astype(int)
    for f, part in rows.groupby("f"):
        part.drop(columns="f").to_parquet(top / f"ticks{f:02d}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(0.02)  # sources take files by age
    return top


def run(spark, folder, job, files, delay, late=False):
    play = J.Replay(spark)
    raw = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", files).parquet(str(folder))
    raw = play.open(raw, "timestamp").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    # running sums of floats depend in their last digits on where they began
    out = sorted(str([f"{x:.6g}" if isinstance(x, float) and abs(x) > 1e-9 else x if not isinstance(x, float) else 0 for x in r]) for r in play.drain(job(raw, delay), late).collect())
    return out, play.late


@pytest.mark.parametrize("name", JOBS)
def test_trigger_size_does_not_show(spark, folder, name):
    one, _ = run(spark, folder, JOBS[name], 1, "2 days")
    all_, _ = run(spark, folder, JOBS[name], 1000, "2 days")
    assert one == all_ and one


def test_late_rows_are_counted_and_refused(spark, folder):
    with pytest.raises(ValueError, match="later than the watermark"):
        run(spark, folder, JOBS["microstructure"], 1, "1 minute")
    some, late = run(spark, folder, JOBS["microstructure"], 1, "1 minute", late=True)
    assert late > 0 and len(some) + late == spark.read.parquet(str(folder)).count()


class _Store:
    """State of one key in memory; counts the rows that are read."""

    def __init__(self):
        self.states, self.timers, self.rows_read = {}, set(), 0

    def getValueState(self, name, schema):
        box, me = {}, SimpleNamespace()
        me.exists, me.get, me.update, me.clear = (lambda: "x" in box), (lambda: box["x"]), (lambda v: box.update(x=v)), box.clear
        return me

    def getMapState(self, name, key, value):
        box, me = {}, SimpleNamespace()

        def read(k):
            self.rows_read += len(box[k][0])
            return box[k]

        me.exists, me.keys, me.getValue = (lambda: bool(box)), (lambda: iter(list(box))), read
        me.updateValue, me.removeKey = (lambda k, v: box.update({k: v})), (lambda k: box.pop(k))
        return me

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def _play(minutes, arrivals, size):
    """A key whose rows arrive in batches of ``size`` while the watermark follows two hours behind."""
    seen = []
    job = J.InOrder("us long, seq long", "n long", lambda st, new: ((len(new),), seen.extend(new["us"].tolist()) or new[["us", "seq"]]), ["k", "seq", "timestamp", "late"], "k")
    store, mark = _Store(), 0
    job.init(store)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for i in range(0, len(arrivals), size):
        part = arrivals[i : i + size]
        list(job.handleInputRows(("a",), iter([pd.DataFrame({"us": part, "seq": range(i, i + len(part))})]), clock))
        mark = max(mark, max(part) // 1000 - 7_200_000)
        while any(t <= mark for t in store.timers):
            at = min(store.timers)
            store.timers.remove(at)
            list(job.handleExpiredTimer(("a",), clock, at))
    return seen, store.rows_read


def test_a_timer_reads_only_what_is_due():
    """All rows on one key, up to an hour out of place, thousands waiting at any time: every row is read once."""
    rnd = random.Random(5)
    at = [m * 1_000_000 for m in range(40_000)]
    arrivals = sorted(at, key=lambda x: x + rnd.randrange(3_600_000_000))
    for size in (50, 1000, 40_000):
        seen, read = _play(600, arrivals, size)
        assert seen == sorted(seen) and len(set(seen)) == len(seen) and read == len(seen) > 0.5 * len(at) if size < 40_000 else read == len(seen)


def test_buckets_close_at_the_same_tick_however_they_are_cut():
    rnd = random.Random(3)
    rows = pd.DataFrame({"us": range(6000), "quantity": [rnd.choice([0.1, 0.3, 1.7, 25.5, 120.0]) for _ in range(6000)], "share": [rnd.choice([0.0, 0.4, 0.5, 0.6, 1.0]) for _ in range(6000)]})
    step = J._buckets(50.0, 50)
    _, whole = step(None, rows)
    for size in (1, 7, 150):
        state, parts = None, []
        for i in range(0, len(rows), size):
            state, out = step(state, rows.iloc[i : i + size].reset_index(drop=True))
            parts.append(out)
        cut = pd.concat([p for p in parts if len(p)], ignore_index=True)
        assert cut["us"].tolist() == whole["us"].tolist() and (cut["vpin"] - whole["vpin"]).abs().max() < 1e-9
    total, want = 0, []
    for us, q in zip(rows["us"], rows["quantity"]):
        total += round(q * 10**8)
        if total >= 50 * 10**8:
            total -= 50 * 10**8
            want.append(us)
    assert whole["us"].tolist() == want


def _peak(n):
    """Most rows that a step meets, and the most memory of a timer that finds ``n`` rows of a key due at once, a few a minute."""
    met = []
    job = J.InOrder("us long, seq long, price double", "n long", lambda st, new: (met.append(len(new)) or (len(new),), new[["us", "seq"]]), ["k", "seq", "timestamp", "late"], "k")
    store, mark, out = _Store(), 0, []
    job.init(store)
    job.waiting.clear = lambda: None
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    at = [i * 10_000_000 for i in range(n)]
    list(job.handleInputRows(("a",), (pd.DataFrame({"us": at[i::4], "seq": range(i, n, 4), "price": 1.0}) for i in range(4)), clock))
    mark = at[-1] // 1000 + 600_000
    tracemalloc.start()
    for told in job.handleExpiredTimer(("a",), clock, 0):
        out.extend(told["seq"].tolist()[::997])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(met) == n and out == sorted(out)
    return max(met), peak


def test_memory_of_a_timer_does_not_grow_with_the_rows_due():
    (few, one), (many, four) = _peak(60_000), _peak(240_000)
    assert max(few, many) <= J.PORTION + 6 and four < 1.5 * one
