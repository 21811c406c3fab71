"""Streams: every function takes and returns a streaming DataFrame.

Neither arrival order nor the size of a trigger shows in a result. Every stateful job has a watermark (ten minutes by
default): rows wait in state until it has passed them and are then worked on in event-time order, by a timer if no other row
comes. Rows behind the watermark are late: jobs of this module let them out with ``late`` set and nothing else; those that Spark
itself leaves out are counted, and :func:`shut_out` tells how many. State of a key that has been silent for ``expiry_days`` (90 by
default) is given up."""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources import ingest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
#: Event time of the row that closes a bounded replay.
END = "9000-01-01"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def normalized_ticks(raw: DataFrame, market: str, payload: str = "payload") -> DataFrame:
    """JSON trades to normalised ticks; rows with an error stay marked for a reject sink."""
    fn = ingest.normalize_crypto_trades if market == "crypto" else ingest.normalize_equity_trades
    return fn(raw, payload)


def tumbling_bars(ticks: DataFrame, seconds: Sequence[int] = (60, 300, 900, 3600), delay: str = DELAY) -> DataFrame:
    """Bars of several sizes; a bar is emitted once the watermark passes its end."""
    key = F.struct("timestamp", "seq")
    aggs = [
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("volume"),
        (F.sum(F.col("price") * F.col("quantity")) / F.sum("quantity")).alias("vwap"),
        F.count(F.lit(1)).alias("trade_count"),
    ]
    t = ticks.withWatermark("timestamp", delay).where(F.col("timestamp") < F.lit(END).cast("timestamp"))
    out = None
    for s in seconds:
        one = t.groupBy("symbol", F.window("timestamp", f"{s} seconds")).agg(*aggs).withColumn("bar_seconds", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("symbol", "bar_seconds", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume", "vwap", "trade_count")


# -- rows of a key in event-time order -------------------------------------------------------------------
EXPIRY_DAYS = 90
_DAY_MS = 86_400_000
#: Rows wait in buckets of so many milliseconds of event time.
BUCKET_MS = 60_000
#: Rows of a key that are worked on at once, up to the end of their bucket.
PORTION = 1 << 15


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then gives them to ``step`` ordered by time and ``seq``.

    Rows wait in time buckets, each arrival an entry of its own in a map by (bucket, arrival). A timer at the end of the first
    bucket reads the entries of the buckets that the watermark has passed and no others, so every row is written once and
    read once, however many wait. They are read in portions of whole buckets, so memory does not grow with the rows that come
    due together. ``step(state, rows)`` takes a tuple (None at first) and a frame, and returns the new tuple
    and a frame of results. ``idle(state, until)``, where given, is asked after that: the time until which everything is
    known has come, what does it mean that no row did? It returns the state, results and when to be asked again. Every
    column of ``schema`` is kept while a row waits; ``us`` is its event time in microseconds."""

    def __init__(self, schema: str, state: str, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]], names: Sequence[str], key_name: str,
                 idle: Callable[[tuple, int], tuple[tuple, pd.DataFrame, int | None]] | None = None, bucket_ms: int = BUCKET_MS, expiry_days: int = EXPIRY_DAYS):
        self.columns = [c.strip().split() for c in schema.split(",")]
        self.kept, self.step, self.names, self.key_name = state, step, list(names), key_name
        self.idle, self.bucket_ms, self.expiry_ms = idle, bucket_ms, expiry_days * _DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, arrival long", ", ".join(f"{c} array<{t}>" for c, t in self.columns))
        self.state = handle.getValueState("state", self.kept)
        self.timer = handle.getValueState("timer", "at long")
        self.clock = handle.getValueState("clock", "arrivals long, last_ms long")

    def _wake(self, at: int) -> None:
        """One timer, at the earliest time that matters."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _put(self, part: pd.DataFrame, arrivals: int) -> int:
        """Writes the rows, one entry for each of their buckets; the number of the next arrival."""
        part = part.assign(_b=part["us"] // 1000 // self.bucket_ms).sort_values("_b", kind="stable")
        buckets = part["_b"].to_numpy()
        first = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1)).tolist()
        lists = [part[c].astype(object).where(part[c].notna(), None).tolist() for c, _ in self.columns]
        for i, j in zip(first, [*first[1:], len(part)]):
            self.waiting.updateValue((int(buckets[i]), arrivals), tuple(x[i:j] for x in lists))
            arrivals += 1
        return arrivals

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, mark = [c for c, _ in self.columns], timerValues.getCurrentWatermarkInMs()
        arrivals, last = self.clock.get() if self.clock.exists() else (0, 0)
        held, n, first = [], 0, None
        for pdf in rows:
            late = pdf["us"] // 1000 < mark  # what they belong to has been told
            if late.any():
                yield self._told(key, pdf.loc[late, ["us", "seq"]].assign(late=True))
            part = pdf.loc[~late, names]
            if not len(part):
                continue
            held, n = [*held, part], n + len(part)
            last, least = max(last, int(part["us"].max()) // 1000), int(part["us"].min()) // 1000
            first = least if first is None else min(first, least)
            if n >= PORTION:
                arrivals = self._put(pd.concat(held, ignore_index=True), arrivals)
                held, n = [], 0
        if held:
            arrivals = self._put(pd.concat(held, ignore_index=True), arrivals)
        if first is not None:
            self._wake((first // self.bucket_ms + 1) * self.bucket_ms)
        self.clock.update((arrivals, last))

    def _told(self, key, out: pd.DataFrame) -> pd.DataFrame:
        out = out.assign(**{self.key_name: key[0]}, timestamp=pd.to_datetime(out["us"], unit="us"))
        return out.reindex(columns=self.names).astype(object).where(lambda x: x.notna(), None)

    def _due(self, passed: int) -> tuple[np.ndarray, np.ndarray, int | None]:
        """Buckets and arrivals of the entries before bucket ``passed`` in order, 16 bytes each, and the first bucket behind."""
        buckets, arrivals, rest = array("q"), array("q"), None
        for bucket, arrival in self.waiting.keys() if self.waiting.exists() else ():
            if bucket < passed:
                buckets.append(bucket)
                arrivals.append(arrival)
            elif rest is None or bucket < rest:
                rest = bucket
        b, a = np.array(buckets, np.int64), np.array(arrivals, np.int64)
        order = np.lexsort((a, b))
        return b[order], a[order], rest

    def _portions(self, buckets: np.ndarray, arrivals: np.ndarray, all_: bool) -> Iterator[pd.DataFrame]:
        """Rows of the entries by time and ``seq``, whole buckets of about ``PORTION`` rows at once. Entries go as they are read;
        if they are ``all_`` that wait, they go together at the end."""
        held, last = [[] for _ in self.columns], len(buckets) - 1
        for i in range(len(buckets)):
            k = (int(buckets[i]), int(arrivals[i]))
            for own, x in zip(held, self.waiting.getValue(k)):
                own.extend(x)
            if not all_:
                self.waiting.removeKey(k)
            if i == last or (len(held[0]) >= PORTION and buckets[i + 1] != buckets[i]):
                ready = pd.DataFrame({c: x for (c, _), x in zip(self.columns, held)})
                held = [[] for _ in self.columns]
                yield ready.sort_values(["us", "seq"], kind="stable", ignore_index=True)
        if all_ and len(buckets):
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        buckets, arrivals, rest = self._due(passed)
        state, told = (self.state.get() if self.state.exists() else None), False
        for ready in self._portions(buckets, arrivals, rest is None):
            state, out = self.step(state, ready)
            if len(out):
                told = True
                yield self._told(key, out.assign(late=False))
        again = None
        if self.idle is not None and state is not None:
            state, out, again = self.idle(state, passed * self.bucket_ms * 1000)
            if len(out):
                told = True
                yield self._told(key, out.assign(late=False))
        last = self.clock.get()[1] if self.clock.exists() else 0
        if not len(buckets) and rest is None and again is None and not told and last + self.expiry_ms <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()  # silent for too long: nothing to go on from
            self.clock.clear()
            return
        if state is not None:
            self.state.update(state)
        if rest is not None:
            self._wake((rest + 1) * self.bucket_ms)
        if again is not None:
            self._wake((again // 1000 // self.bucket_ms + 1) * self.bucket_ms)
        if rest is None and again is None:
            self._wake(last + self.expiry_ms)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, schema: str, state: str, step: Callable, out: str, delay: str, idle: Callable | None = None, expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """``rows`` has the key, ``timestamp`` and the columns of ``schema`` but ``us``. Late rows come out with ``late`` set and no
    results, for a table of their own."""
    out += ", late boolean"
    names = [x.strip().split()[0] for x in out.split(",")]
    job = InOrder(f"us long, {schema}", state, step, names, key, idle, expiry_days=expiry_days)
    marked = rows.withWatermark("timestamp", delay).where(F.col("timestamp") < F.lit(END).cast("timestamp"))
    return marked.withColumn("us", F.unix_micros("timestamp")).groupBy(key).transformWithStateInPandas(job, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _tail(size: int, columns: Sequence[str], fn: Callable[[pd.DataFrame, int], pd.DataFrame]) -> Callable:
    """Step that calls ``fn(rows, first_new)`` on the last ``size`` rows of a key and the new ones behind them."""

    def step(state, new):
        hist = pd.DataFrame({c: np.asarray(v, float) for c, v in zip(columns, state)}) if state else pd.DataFrame({c: np.zeros(0) for c in columns})
        both = pd.concat([hist, new[list(columns)].astype(float)], ignore_index=True)
        out = fn(both, len(hist)).reset_index(drop=True)
        return tuple(both[c].tail(size).tolist() for c in columns), pd.concat([new[["us", "seq"]], out], axis=1)

    return step


def _arrays(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} array<double>" for c in columns)


def _recent(b: pd.DataFrame, first: int) -> pd.DataFrame:
    """Microstructure values over the last 100 rows, for the rows from ``first`` on."""
    w = 100
    n = np.minimum(np.arange(len(b)) + 1, w)
    roll = lambda s, k=w: s.rolling(k, min_periods=1)
    vol = roll(b["quantity"]).sum()
    start = np.maximum(np.arange(len(b)) - (w - 1), 0)
    net = b["quantity"].where(b["sign"] > 0, -b["quantity"].where(b["sign"] < 0, 0.0))
    bid, ask = b["bid"].to_numpy(), b["ask"].to_numpy()
    imb = (bid - bid[start]) - (ask - ask[start])
    ok = (bid > 0) & (ask > bid)
    bps = pd.Series(np.where(ok, (ask - bid) / np.where(ok, (ask + bid) / 2, 1) * 1e4, np.nan))
    dp, prev = b["price"].diff(), net.shift()
    var, cov = roll(prev, w - 1).var(), dp.rolling(w - 1, min_periods=2).cov(prev)
    ms = np.floor(b["clock"].to_numpy() / 1000.0)
    gap = ms - ms[start]
    few = n < 2
    v = vol.to_numpy()
    sell = b["quantity"].where(b["sign"] < 0, 0.0)
    step, move = roll(dp.abs(), w - 1).mean(), b["price"].diff(5).abs()
    absorbed = (n >= 10) & (sell > roll(sell).mean() + 2 * roll(sell).std()) & (step > 0) & (move < step)
    res = pd.DataFrame(
        {
            "ofi": np.where(few | (v == 0), 0.0, imb / np.where(v == 0, 1, v)),
            "cvd": np.where(few | (v == 0), 0.0, roll(net).sum() / np.where(v == 0, 1, v)),
            "kyle_lambda": np.where((n < 3) | ~(var > 0), 0.0, cov / var.where(var > 0, 1.0)),
            "spread_bps": np.where(few, 0.0, bps.rolling(w, min_periods=1).mean().fillna(0.0)),
            "trade_intensity": np.where(gap > 0, n / (np.where(gap > 0, gap, 1) / 1000.0), 0.0),
            "absorption": absorbed.to_numpy(bool),
        }
    )
    return res.iloc[first:]


def _ofi_signal(b: pd.DataFrame, first: int) -> pd.DataFrame:
    """Book order-flow signal recomputed on the retained history, rows from ``first`` on."""
    depth = b["bid_size"] - b["ask_size"]
    f = depth.diff().fillna(0.0)
    mix = 0.5 * f.rolling(10).mean() + 0.3 * f.rolling(50).mean() + 0.2 * f.rolling(100).mean()
    scale = 3.0 * mix.rolling(60, min_periods=2).std().fillna(0.0)
    sig = np.where(mix.isna(), np.nan, np.where(scale < 1e-15, 0.0, np.tanh(mix / scale.where(scale >= 1e-15, 1.0))))
    return pd.DataFrame({"ofi_signal": sig}).iloc[first:]


_TICK = ("symbol string", "seq long", "timestamp timestamp")


def _state_columns(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("sign", F.when(F.col("side") == "BUY", 1.0).when(F.col("side") == "SELL", -1.0).otherwise(0.0)).withColumn("clock", F.unix_micros("timestamp").cast("double"))


def microstructure_stream(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Values over the last 100 ticks after every tick."""
    cols = ["price", "quantity", "bid", "ask", "sign", "clock"]
    t = _state_columns(ticks).select("symbol", "seq", "timestamp", *cols)
    out = ", ".join([*_TICK, *[f"{c} double" for c in ("ofi", "cvd", "kyle_lambda", "spread_bps", "trade_intensity")], "absorption boolean"])
    return _in_order(t, "symbol", "seq long, " + ", ".join(f"{c} double" for c in cols), _arrays(cols), _tail(100, cols, _recent), out, delay)


def feature_stream(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Order-flow signal recomputed per observation from a ring buffer of 160 rows."""
    cols = ["bid_size", "ask_size"]
    t = ticks.select("symbol", "seq", "timestamp", *[F.col(c).cast("double").alias(c) for c in cols])
    return _in_order(t, "symbol", "seq long, bid_size double, ask_size double", _arrays(cols), _tail(160, cols, _ofi_signal), ", ".join([*_TICK, "ofi_signal double"]), delay)


# -- volume buckets with exact carry ------------------------------------------------------------------------
#: Volumes are whole multiples of this part of one: whether a bucket is full is decided on whole numbers alone.
VOLUME_UNITS = 10**8


def _buckets(size: float, window: int) -> Callable:
    """Buckets of fixed volume: what exceeds a bucket is carried in the bucket's own buy/sell mix, and at most one bucket closes
    per tick. The volume of a bucket is a whole number of units and decides when it closes; its mix is kept apart, so where
    running sums of it began does not show. One round of the loop for each bucket."""
    full = round(size * VOLUME_UNITS)

    def step(state, new):
        fill, mix, bs, ss, n = state or (0, 0.0, [], [], 0)  # units in the open bucket, bought share of them
        bs, ss, out = list(bs), list(ss), []
        units = np.rint(new["quantity"].to_numpy(float) * VOLUME_UNITS).astype(np.int64)
        all_ = np.concatenate([[0], np.cumsum(units)])
        bought = np.concatenate([[0.0], np.cumsum(units * new["share"].to_numpy(float))])
        at = 0
        while at < len(units):
            end = max(int(np.searchsorted(all_, all_[at] + full - fill, side="left")), at + 1)  # rows up to the one that fills it
            if end > len(units):
                break
            total = fill + int(all_[end] - all_[at])
            mix = (mix * fill + bought[end] - bought[at]) / total
            bs, ss = (bs + [mix * min(full, total) / VOLUME_UNITS])[-window:], (ss + [(1 - mix) * min(full, total) / VOLUME_UNITS])[-window:]
            fill = max(total - full, 0)
            vol = sum(bs) + sum(ss)
            out.append((new["us"].iat[end - 1], n, bs[-1], ss[-1], sum(abs(x - y) for x, y in zip(bs, ss)) / vol, sum(bs) / vol))
            n, at = n + 1, end
        more = int(all_[-1] - all_[at])
        if more:
            mix = (mix * fill + bought[-1] - bought[at]) / (fill + more)
            fill += more
        return (fill, float(mix), bs, ss, n), pd.DataFrame(out, columns=["us", "bucket", "buy_volume", "sell_volume", "vpin", "buy_volume_pct"])

    return step


def vpin_stream(ticks: DataFrame, bucket_size: float, window: int = 50, delay: str = DELAY) -> DataFrame:
    share = (
        F.when(F.col("side") == "BUY", 1.0)
        .when(F.col("side") == "SELL", 0.0)
        .when(F.col("bid").isNull() | F.col("ask").isNull(), 0.5)
        .when(F.col("price") >= (F.col("bid") + F.col("ask")) / 2, 0.6)
        .otherwise(0.4)
    )
    t = ticks.select("symbol", "seq", "timestamp", F.col("quantity").cast("double").alias("quantity"), share.alias("share"))
    schema = "symbol string, bucket long, timestamp timestamp, buy_volume double, sell_volume double, vpin double, buy_volume_pct double"
    state = "fill long, mix double, b array<double>, s array<double>, n long"
    return _in_order(t, "symbol", "seq long, quantity double, share double", state, _buckets(float(bucket_size), window), schema, delay)


# -- circuit breaker -------------------------------------------------------------------------------------------
def _breaker(cooldown_us: int) -> Callable:
    """CLOSED -> OPEN on a trigger; OPEN -> HALF_OPEN after the cooldown; there a profit closes the breaker and a loss opens it
    again. The loop goes from one change of the state to the next; the rows between are filled in at once."""

    def step(state, new):
        status, tripped, reason, losses = state or ("CLOSED", 0, None, 0)
        us, pnl = new["us"].to_numpy(np.int64), pd.to_numeric(new["pnl"]).to_numpy(float)
        triggers, results = np.flatnonzero(new["trigger"].notna()), np.flatnonzero(~np.isnan(pnl))
        n, at, marks = len(us), 0, []  # marks: (first row, status, reason, allowed, losses) until the next mark

        def after(rows: np.ndarray, i: int) -> int:
            k = int(np.searchsorted(rows, i))
            return int(rows[k]) if k < len(rows) else n

        while at < n:
            if status == "CLOSED":
                i = after(triggers, at)
                marks.append((at, status, reason, True, losses))
                if i < n:
                    status, tripped, reason, losses = "OPEN", int(us[i]), new["trigger"].iat[i], losses + 1
                    marks.append((i, status, reason, False, losses))
                at = i + 1
            elif status == "OPEN":
                i = max(at, int(np.searchsorted(us, tripped + cooldown_us)))
                marks.append((at, status, reason, False, losses))
                at = i
                if i < n:
                    status = "HALF_OPEN"
            else:
                i = after(results, at)
                marks.append((at, status, reason, True, losses))
                if i < n:
                    status, tripped, losses = ("CLOSED", 0, 0) if pnl[i] >= 0 else ("OPEN", int(us[i]), losses + 1)
                    reason = None if status == "CLOSED" else reason
                    marks.append((i, status, reason, True, losses))
                at = i + 1
        first = np.array([m[0] for m in marks], np.int64)
        mark = pd.DataFrame(marks, columns=["at", "status", "reason", "allowed", "losses"]).iloc[np.searchsorted(first, np.arange(n), side="right") - 1]
        return (status, tripped, reason, losses), pd.concat([new[["us", "seq"]], mark.drop(columns="at").reset_index(drop=True)], axis=1)

    return step


def breaker_stream(events: DataFrame, recovery_minutes: int = 30, delay: str = DELAY) -> DataFrame:
    """``events``: account, seq, timestamp, trigger (null if none), pnl (result of a closed trade or null). The state after every
    event, and whether trading was allowed at it."""
    out = "account string, seq long, timestamp timestamp, status string, reason string, allowed boolean, losses long"
    rows = events.select("account", "seq", "timestamp", "trigger", F.col("pnl").cast("double").alias("pnl"))
    return _in_order(rows, "account", "seq long, trigger string, pnl double", "status string, tripped_us long, reason string, losses long", _breaker(recovery_minutes * 60_000_000), out, delay)


# -- circuit breaker from raw streams -----------------------------------------------------------------------------
_HALF_HOUR_US, _HOUR_US, _DAY_US = 1_800_000_000, 3_600_000_000, 86_400_000_000


def _after(us: np.ndarray, value: np.ndarray, old: tuple[list, list] | None) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a series, the remembered ones first."""
    then, was = old or ([], [])
    return np.concatenate([np.array(then, np.int64), us]), np.concatenate([np.array(was, float), value])


def _triggers(capital: float, limits: Mapping[str, float]) -> Callable:
    """First trigger that fires at each row of an account: loss of the UTC day, loss of the last half hour, rise of the volatility
    index within the hour, silence of a source that has been heard before. What is remembered: the day's total, results of half
    an hour, readings of an hour and the one before them, the last beat of each source."""

    def step(state, new):
        day, total, then, was, vix_then, vix_was, sources, seen = state or (0, 0.0, [], [], [], [], [], [])
        us, kind = new["us"].to_numpy(np.int64), new["kind"].to_numpy(object)
        value = pd.to_numeric(new["value"]).to_numpy(float)
        n, rows = len(us), np.arange(len(us))
        paid = np.where(kind == "pnl", np.nan_to_num(value), 0.0)
        days = us // _DAY_US
        run = np.concatenate([[0.0], np.cumsum(paid)])
        first = np.searchsorted(days, days, side="left")
        daily = run[1:] - run[first] + np.where(days == day, total, 0.0)
        t, v = _after(us, paid, (then, was))
        sums, old = np.concatenate([[0.0], np.cumsum(v)]), len(then)
        recent = sums[old + rows + 1] - sums[np.searchsorted(t, us - _HALF_HOUR_US, side="left")]
        is_vix = kind == "vix"
        vt, vv = _after(us[is_vix], value[is_vix], (vix_then, vix_was))
        now = len(vix_then) + np.cumsum(is_vix) - 1
        ago = np.searchsorted(vt, us - _HOUR_US, side="right") - 1
        both = (now >= 0) & (ago >= 0)
        padded = np.append(vv, np.nan)
        level, before = np.where(both, padded[now], np.nan), np.where(both, padded[ago], np.nan)
        last = dict(zip(sources, seen))
        longest = np.zeros(n)
        beat = kind == "beat"
        names = new["source"].to_numpy(object)
        for name in sorted({*last, *names[beat]}):
            own = np.where(beat & (names == name), us, last.get(name, -1))
            heard = np.maximum.accumulate(own)
            longest = np.maximum(longest, np.where(heard >= 0, us - heard, 0))
            last[name] = int(heard[-1])
        funded = capital > 0
        spike = np.zeros(n, bool)
        ok = both & (before > 0)
        spike[ok] = (level[ok] - before[ok]) / before[ok] > limits["vix_spike"]
        fired = [funded & (-daily / (capital or 1.0) > limits["daily_loss"]), funded & (-recent / (capital or 1.0) > limits["intraday_loss_30m"]), spike, longest > limits["silence_seconds"] * 1e6]
        reason = np.full(n, None, object)
        for rule, name in reversed(list(zip(fired, ("daily_drawdown", "intraday_loss", "vix_spike", "source_silent")))):
            reason[rule] = name
        keep = t >= us[-1] - _HALF_HOUR_US
        from_ = max(int(np.searchsorted(vt, us[-1] - _HOUR_US, side="right")) - 1, 0)
        kept = (int(days[-1]), float(daily[-1]), t[keep].tolist(), v[keep].tolist(), vt[from_:].tolist(), vv[from_:].tolist(), list(last), list(last.values()))
        return kept, pd.DataFrame({"us": us, "seq": new["seq"], "trigger": reason, "pnl": np.where(kind == "pnl", value, np.nan)})

    return step


def triggered_breaker_stream(pnl: DataFrame, vix: DataFrame, beats: DataFrame, capital: float, recovery_minutes: int = 30, limits: Mapping[str, float] | None = None, delay: str = DELAY) -> DataFrame:
    """The breaker from raw streams: ``pnl`` (account, seq, timestamp, pnl of a closed trade), ``vix`` (account, seq, timestamp, vix) and
    ``beats`` (account, seq, timestamp, source). Readings that concern several accounts come once for each.

    The three are one stream in event-time order; at each of its rows the triggers are evaluated and drive the breaker, whose
    state after the row comes out with the ``trigger``. ``limits`` replaces entries of ``operators.risk.LIMITS``. Rows of equal
    time are taken by ``seq``."""
    from ..operators.risk import LIMITS

    base = ["account", "seq", "timestamp"]
    none = F.lit(None).cast("string")
    rows = (
        pnl.select(*base, F.lit("pnl").alias("kind"), F.col("pnl").cast("double").alias("value"), none.alias("source"))
        .unionByName(vix.select(*base, F.lit("vix").alias("kind"), F.col("vix").cast("double").alias("value"), none.alias("source")))
        .unionByName(beats.select(*base, F.lit("beat").alias("kind"), F.lit(None).cast("double").alias("value"), F.col("source")))
    )
    judge, switch = _triggers(float(capital), {**LIMITS, **(limits or {})}), _breaker(recovery_minutes * 60_000_000)

    def step(state, new):
        seen, judged = judge(state[:8] if state else None, new)
        turned, out = switch(state[8:] if state else None, judged)
        return (*seen, *turned), out.assign(trigger=judged["trigger"])

    held = "day long, total double, then array<long>, was array<double>, vix_then array<long>, vix_was array<double>, sources array<string>, seen array<long>"
    out = "account string, seq long, timestamp timestamp, trigger string, status string, reason string, allowed boolean, losses long"
    return _in_order(rows, "account", "seq long, kind string, value double, source string", f"{held}, status string, tripped_us long, reason string, losses long", step, out, delay)


# -- heartbeats -------------------------------------------------------------------------------------------------
_SILENCE = ["us", "seq", "event", "silent_since", "gap_seconds"]


def _silence(limit_us: int) -> tuple[Callable, Callable]:
    """Step and idle call that tell of gaps between beats longer than the limit: once it is sure that no beat came in time, and
    again at the next beat."""

    def alert(since: int) -> tuple:
        return (since + limit_us, 0, "silent", pd.Timestamp(since, unit="us"), None)

    def step(state, new):
        us = new["us"].to_numpy(np.int64)
        last, told = state or (int(us[0]), False)
        all_ = np.concatenate([[last], us])
        out = []
        for i in np.flatnonzero(np.diff(all_) > limit_us).tolist():
            since, back = int(all_[i]), int(all_[i + 1])
            if i or not told:
                out.append(alert(since))
            out.append((back, int(new["seq"].iat[i]), "back", pd.Timestamp(since, unit="us"), (back - since) / 1e6))
        return (int(us[-1]), False), pd.DataFrame(out, columns=_SILENCE)

    def idle(state, until):
        last, told = state
        if told or last + limit_us >= until:
            return state, pd.DataFrame(columns=_SILENCE), None if told else last + limit_us
        return (last, True), pd.DataFrame([alert(last)], columns=_SILENCE), None

    return step, idle


def silence_stream(beats: DataFrame, seconds: float = 60, delay: str = DELAY, expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """``beats``: source, timestamp. Two rows for each gap longer than ``seconds``: ``silent`` at the moment when the limit ran out, sent
    as soon as the watermark is past it, and ``back`` at the beat that ends it, with ``gap_seconds``. Gaps are those of event
    time: beats that arrive in another order, or together, give the same rows."""
    step, idle = _silence(round(seconds * 1e6))
    out = "source string, timestamp timestamp, event string, silent_since timestamp, gap_seconds double"
    rows = beats.select("source", "timestamp", F.lit(0).cast("long").alias("seq"))
    return _in_order(rows, "source", "seq long", "last long, told boolean", step, out, delay, idle, expiry_days)


def silent_sources(beats: DataFrame, as_of, seconds: int = 60) -> DataFrame:
    """Batch form: sources whose last beat is older than the limit."""
    last = beats.groupBy("source").agg(F.max("timestamp").alias("last_seen"))
    age = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 1e6
    return last.select("source", "last_seen", age.alias("age_seconds"), (age > seconds).alias("is_silent"))


# -- trades and regimes -------------------------------------------------------------------------------------------
def unique_trade_stream(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival per trade id within the watermark, so the memory of seen ids is bounded."""
    return trades.withWatermark("exit_time", delay).dropDuplicatesWithinWatermark(["trade_id"])


def append_history(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for per-strategy trade history; the batch id makes a replay overwrite itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("month", F.date_format("exit_time", "yyyy-MM")).write.mode("overwrite").partitionBy("strategy_id", "month").parquet(f"{path}/batch={batch_id}")

    return write


def regime_snapshot(macro: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """One row with the regime from the latest value of each series; ``roles`` maps series to input name."""
    from ..operators.scoring import macro_state

    last = macro.filter(F.col("series_id").isin(*roles)).groupBy("series_id").agg(F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("t"))
    name = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    names = ["vix", "dollar_change", "yield_10y", "yield_2y", "funding_rate"]
    wide = last.agg(F.max("t").alias("as_of"), *[F.max(F.when(name[F.col("series_id")] == n, F.col("value"))).alias(n) for n in names])
    return macro_state(wide.fillna(0.0, ["dollar_change", "funding_rate"]))


# Levels of the volatility regimes and their size factors, as in operators.scoring.macro_state.
_REGIMES = ((35.0, "crisis", 0.0), (25.0, "high", 0.3), (15.0, "normal", 1.0))
_CALM = ("low", 1.2)
_READINGS = ("vix", "dollar_change", "yield_10y", "yield_2y", "funding_rate")
_MACRO = ["us", "seq", "vix", "vol_regime", "yield_curve_inverted", "risk_mode", "macro_mult"]


def _regimes(state, new):
    """Latest reading of each kind at every row, the regime that follows, and the rows at which it changes."""
    old = state or (*[None] * len(_READINGS), None)
    value, kind = pd.to_numeric(new["value"]).to_numpy(float), new["kind"].to_numpy(object)
    now = {}
    for name, was in zip(_READINGS, old):
        x = pd.Series(np.where(kind == name, value, np.nan))
        now[name] = x.ffill().fillna(np.nan if was is None else was).to_numpy(float)
    vix, dollar, funding = now["vix"], np.nan_to_num(now["dollar_change"]), np.nan_to_num(now["funding_rate"])
    known = ~(np.isnan(now["yield_10y"]) | np.isnan(now["yield_2y"]))
    inverted = known & (now["yield_2y"] > now["yield_10y"])
    regime, base = np.full(len(new), _CALM[0], object), np.full(len(new), _CALM[1])
    for level, name, factor in reversed(_REGIMES):
        regime[vix >= level], base[vix >= level] = name, factor
    regime[np.isnan(vix)], base[np.isnan(vix)] = "normal", 1.0
    mult = base * np.where(dollar > 0.5, 0.7, 1.0) * np.where(inverted, 0.8, 1.0) * np.where(np.abs(funding) > 0.03, 0.9, 1.0)
    mult = np.floor(mult * 1000 + 0.5 + 1e-9) / 1000
    mode = np.where((dollar > 0.3) | inverted | np.isin(regime, ("crisis", "high")), "reduced", "normal")
    sign = np.array([f"{a}|{b}|{c}|{d:.3f}" for a, b, c, d in zip(regime, inverted, mode, mult)], object)
    turns = sign != np.concatenate([[old[-1]], sign[:-1]])
    out = pd.DataFrame({"us": new["us"], "seq": new["seq"], "vix": vix, "vol_regime": regime, "yield_curve_inverted": inverted, "risk_mode": mode, "macro_mult": mult})[turns]
    kept = tuple(None if np.isnan(now[name][-1]) else float(now[name][-1]) for name in _READINGS)
    return (*kept, sign[-1]), out.reset_index(drop=True)


def regime_stream(readings: DataFrame, delay: str = DELAY, expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """``readings``: market, seq, timestamp, kind (vix, dollar_change, yield_10y, yield_2y, funding_rate), value. The regime of a market
    after every reading that changes it, and after its first; a kind not read yet has the meaning that a missing one has in
    the batch form. Other kinds change nothing."""
    out = "market string, seq long, timestamp timestamp, vix double, vol_regime string, yield_curve_inverted boolean, risk_mode string, macro_mult double"
    rows = readings.select("market", "seq", "timestamp", "kind", F.col("value").cast("double").alias("value"))
    state = ", ".join(f"{x} double" for x in _READINGS) + ", sign string"
    return _in_order(rows, "market", "seq long, kind string, value double", state, _regimes, out, delay, expiry_days=expiry_days)


# -- running a bounded stream -----------------------------------------------------------------------------------------
def _shared(spark: SparkSession, shared: str | None) -> str:
    top = shared or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top}/stream-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


class Replay:
    """A bounded replay of a stream: :meth:`open` adds a source for one last row that :meth:`drain` writes when all others are
    in. Its event time, far ahead, moves the watermark past every row, so nothing is left waiting in state."""

    def __init__(self, spark: SparkSession, shared: str | None = None):
        self.spark, self.root = spark, _shared(spark, shared)

    def open(self, stream: DataFrame, time: str) -> DataFrame:
        last = [T.StructField(f.name, f.dataType) for f in stream.schema.fields]
        ahead = F.lit("9998-12-31").cast(stream.schema[time].dataType)
        self.last = self.spark.range(1).select(*[(ahead if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in last])
        self.last.where("false").write.parquet(f"{self.root}/end")
        return stream.unionByName(self.spark.readStream.schema(T.StructType(last)).parquet(f"{self.root}/end"))

    def _run(self, stream: DataFrame) -> int:
        q = stream.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return shut_out(q)

    def drain(self, stream: DataFrame, late: bool = False) -> DataFrame:
        """Everything that came in time as a table. Late rows are an error unless ``late`` is set; ``late_rows`` has them then, as
        far as the job lets them out, and ``late`` their number."""
        self.late = self._run(stream)
        if hasattr(self, "last"):
            self.last.write.mode("append").parquet(f"{self.root}/end")
            self.late += self._run(stream)
        out = self.spark.read.schema(stream.schema).parquet(f"{self.root}/out")
        if "late" in out.columns:
            self.late_rows, out = out.where("late"), out.where("not late").drop("late")
            self.late += self.late_rows.count()
        if self.late and not late:
            raise ValueError(f"{self.late} rows came later than the watermark allows")
        return out


def shut_out(q: StreamingQuery) -> int:
    """Rows that the watermark of a query has made Spark leave out so far."""
    return sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)


def drain(stream: DataFrame, shared: str | None = None) -> DataFrame:
    """Process everything available once into Parquet and return it as a table, for streams that hold nothing back."""
    return Replay(stream.sparkSession, shared).drain(stream)
