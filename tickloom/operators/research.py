"""Feature research: information coefficients, collinearity, splits, hypothesis tests, selection.

Tables are tall: (symbol, timestamp, feature, value, horizon, fwd). Only K x K summaries of K features
and report rows are small enough for the driver."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import add, finite, log_ratio, ratio
from ..functions.special import t_p_value
from ..plans.ordered import CHUNK, HALO, INDEX, Ordered
from ..plans.ranks import average_ranks, below, ranks_in
from .performance import ANNUAL, bootstrap_moments, sharpe_column


def forward_returns(prices: DataFrame, horizons: Sequence[int], s: Ordered, price: str = "price") -> DataFrame:
    """Log return to the price h rows later, one column per horizon; the tail has nulls, a price of 0 gives
    an infinite return (NaN between two)."""

    def fn(t: DataFrame) -> DataFrame:
        w = s.window()
        for h in horizons:
            t = t.withColumn(f"fwd_{h}", log_ratio(F.lead(price, h).over(w), F.col(price)))
        return t

    return s.windowed(prices, 0, fn, ahead=max(horizons))


def tall_panel(wide: DataFrame, features: Sequence[str], horizons: Sequence[int], keep: Sequence[str], only_finite: bool = True) -> DataFrame:
    """One row per (row, feature, horizon) with both values finite, or (without ``only_finite``) not null."""
    f = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in features]))
    h = F.explode(F.array(*[F.struct(F.lit(x).alias("horizon"), F.col(f"fwd_{x}").alias("fwd")) for x in horizons]))
    t = wide.select(*keep, f.alias("_f"), *[f"fwd_{x}" for x in horizons]).select(*keep, "_f", h.alias("_h"))
    t = t.select(*keep, "_f.feature", "_f.value", "_h.horizon", "_h.fwd")
    ok = finite if only_finite else Column.isNotNull
    return t.filter(ok(F.col("value")) & ok(F.col("fwd")))


PANEL_KEYS = ("symbol", "feature", "horizon")


def spearman(panel: DataFrame, keys: Sequence[str] = PANEL_KEYS, minimum: int = 10) -> DataFrame:
    """Rank correlation over whole groups of any size, with its t-based p-value; (0, 1) if undefined."""
    keys = list(keys)
    r = average_ranks(panel, keys, {"value": "_rx", "fwd": "_ry"})
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy")
    )
    ok = (F.col("n") >= minimum) & (F.col("sx") > 0) & (F.col("sy") > 0)
    ic = F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("c"), F.col("sx") * F.col("sy"))))).otherwise(0.0)
    g = g.select(*keys, "n", ic.alias("ic"), ok.alias("_ok"))
    df = (F.col("n") - 2).cast("double")
    rest = 1 - F.col("ic") * F.col("ic")
    t = F.col("ic") * F.sqrt(df / F.when(rest > 0, rest))
    p = F.when(~F.col("_ok"), 1.0).when(rest <= 0, 0.0).otherwise(t_p_value(t, df))
    return g.withColumn("p_value", p).drop("_ok")


def _window_ic(x: np.ndarray, y: np.ndarray, window: int, ends: np.ndarray, flat: float = 0.0) -> np.ndarray:
    """Rank correlations of the windows ending at ``ends`` (``flat`` where a window is constant)."""

    def ranks(v):
        w = np.lib.stride_tricks.sliding_window_view(v, window)[ends - window + 1]
        order = np.argsort(w, axis=1, kind="stable")
        s = np.take_along_axis(w, order, axis=1)
        idx = np.broadcast_to(np.arange(window), s.shape)
        new = np.ones(s.shape, bool)
        new[:, 1:] = (s[:, 1:] != s[:, :-1]) & ~(np.isnan(s[:, 1:]) & np.isnan(s[:, :-1]))  # NaN ties, above all numbers
        first = np.maximum.accumulate(np.where(new, idx, 0), axis=1)
        last = np.ones(s.shape, bool)
        last[:, :-1] = new[:, 1:]
        end = np.minimum.accumulate(np.where(last, idx, window)[:, ::-1], axis=1)[:, ::-1]
        out = np.empty(s.shape)
        np.put_along_axis(out, order, (first + end) / 2.0 + 1.0, axis=1)
        return out - out.mean(axis=1, keepdims=True)

    a, b = ranks(x), ranks(y)
    den = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(den > 0, (a * b).sum(1) / np.where(den > 0, den, 1.0), flat)


def _chunk_ic(keys: list[str], w: int, st: int, flat: float = 0.0):
    """Function for one row chunk: correlations of the windows that end in it, every ``st`` rows."""

    def calc(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(INDEX)
        idx = pdf[INDEX].to_numpy()
        pos = np.flatnonzero(~pdf[HALO].to_numpy(bool) & (idx >= w - 1) & ((idx - w + 1) % st == 0))
        out = {k: pdf[k].to_numpy()[pos] for k in keys}  # of the key's type even without a window
        out["period"] = idx[pos]
        x, y = pdf["value"].to_numpy(), pdf["fwd"].to_numpy()
        vals = [_window_ic(x, y, w, c, flat) for c in np.array_split(pos, max(1, len(pos) // 512)) if len(c)]
        out["ic"] = np.concatenate(vals) if vals else np.empty(0)
        return pd.DataFrame(out)

    return calc


def ic_series(panel: DataFrame, s: Ordered, window: int = 252, keys: Sequence[str] = PANEL_KEYS, every: int | None = None, flat: float = 0.0) -> DataFrame:
    """Rank correlation per rolling window of max(window, 10h) rows, stepped by the horizon h or by ``every`` rows; ``flat`` for a
    window (or block) in which one side is constant.

    ``s`` orders the panel rows per ``keys``. Windows are ranked with NumPy on row chunks that carry the
    rows before them, so a long series is many independent tasks. Series with fewer than three windows
    are cut into equal blocks instead (such series are short by definition)."""
    keys = list(keys)
    s = s.with_(keys=tuple(keys))
    rows = s.running(panel)
    n = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(window), F.col("horizon") * 10)
    step = F.lit(every) if every else F.greatest(F.col("horizon"), F.lit(1))
    rows = rows.join(n, keys).withColumn("_w", size).withColumn("_st", step)
    many = F.col("_n") >= F.col("_w") + 2 * F.col("_st")

    types = dict(panel.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["period long", "ic double"])
    parts = None
    horizons = [r[0] for r in panel.select("horizon").distinct().collect()]  # a handful of parameters
    for h in sorted(horizons):
        w, st = max(window, 10 * h), every or max(h, 1)
        chunk = s.with_(chunk_rows=max(8192, w))
        one = rows.filter(many & (F.col("horizon") == h)).select(*keys, INDEX, "value", "fwd")

        part = chunk.chunks(one, w - 1).groupBy(*keys, CHUNK).applyInPandas(_chunk_ic(keys, w, st, flat), schema)
        parts = part if parts is None else parts.unionByName(part)
    # few windows: at least three contiguous blocks of at least five rows
    few = rows.filter(~many)
    nb = F.greatest(F.lit(3), F.floor(F.col("_n") / (F.col("_st") * 10)))
    few = few.withColumn("_nb", nb).withColumn("_len", F.floor(F.col("_n") / F.col("_nb"))).filter(F.col("_len") > 0)
    few = few.withColumn("_blk", F.least(F.floor(F.col(INDEX) / F.col("_len")), F.col("_nb") - 1))
    bk = [*keys, "_blk"]
    few = few.withColumn("_rx", ranks_in(bk, "value")).withColumn("_ry", ranks_in(bk, "fwd"))
    g = few.groupBy(*bk).agg(
        F.count(F.lit(1)).alias("m"), F.max(INDEX).alias("period"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("a"), F.stddev_pop("_ry").alias("b")
    )
    ic = F.when(F.col("m") >= 10, ratio(F.col("c"), F.col("a") * F.col("b"), flat)).otherwise(0.0)
    blocks = g.filter(F.col("m") >= 5).select(*keys, "period", ic.alias("ic"))
    parts = blocks if parts is None else parts.unionByName(blocks)
    return parts.withColumn("ic", F.coalesce("ic", F.lit(flat)))  # NaN of a Pandas frame arrives as null


def newey_west(series: DataFrame, keys: Sequence[str], value: str = "ic", max_lag: int | None = None) -> DataFrame:
    """Autocorrelation-robust standard error of the mean with horizon-1 Bartlett lags, per key.

    ``series``: keys (including horizon), period, value. ``max_lag`` bounds the horizons present."""
    keys = list(keys)
    s = Ordered(keys=tuple(keys), order=("period",))
    lag = max_lag if max_lag is not None else max((r[0] for r in series.select("horizon").distinct().collect()), default=1) - 1
    stat = series.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    x = series.join(stat, keys).withColumn("_x", F.col(value) - F.col("_m"))
    # periods advance by the horizon, which makes the dense position direct
    first = series.groupBy(*keys).agg(F.min("period").alias("_p0"))
    x = x.join(first, keys).withColumn(INDEX, F.floor((F.col("period") - F.col("_p0")) / F.greatest(F.col("horizon"), F.lit(1))))

    def fn(t: DataFrame) -> DataFrame:
        w = s.window()
        for j in range(1, lag + 1):
            t = t.withColumn(f"_g{j}", F.when(F.col("horizon") > j, F.col("_x") * F.lag("_x", j).over(w)))
        return t

    x = s.windowed(x, lag, fn) if lag > 0 else x
    wt = lambda j: 1 - F.lit(float(j)) / F.col("horizon")
    auto = [F.coalesce(F.sum(wt(j) * F.col(f"_g{j}")), F.lit(0.0)) for j in range(1, lag + 1)]
    total = F.sum(F.col("_x") * F.col("_x")) + (2 * add(auto) if auto else F.lit(0.0))
    g = x.groupBy(*keys, "_n").agg(total.alias("_v"))
    var = F.greatest(F.lit(0.0), F.col("_v") / F.col("_n"))
    return g.select(*keys, F.when(F.col("_n") < 2, 0.0).otherwise(F.sqrt(var / F.col("_n"))).alias("nw_se"))


def ic_summary(panel: DataFrame, s: Ordered, window: int = 252, n_boot: int = 0, keys: Sequence[str] = PANEL_KEYS, cost_bps: float = 10.0, seed: int = 42, min_samples: int = 10) -> DataFrame:
    """Mean, deviation, information ratio, robust t and p, hit rate, turnover adjustment, decay and
    (with ``n_boot``) a bootstrap interval per key."""
    keys = list(keys)
    from ..session import cut_lineage

    # Panel and series feed several aggregations each: compute them once.
    panel = cut_lineage(panel)
    series = cut_lineage(ic_series(panel, s, window, keys))
    g = series.groupBy(*keys).agg(
        F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_samples"),
        F.count_if(F.col("ic") > 0).alias("_pos"), F.count_if(F.col("ic") < 0).alias("_neg"),
    ).filter(F.col("n_samples") >= 2)
    g = g.join(newey_west(series, keys), keys, "left")
    flat = F.col("ic_std") < 1e-15
    zero = F.abs("ic") <= 1e-15
    huge = F.signum("ic") * 1e6
    g = g.withColumn("ic_ir", F.when(flat & ~zero, huge).when(flat, 0.0).otherwise(ratio(F.col("ic"), F.col("ic_std"))))
    good = F.col("nw_se") >= 1e-15
    t = F.when(flat & ~zero, huge).when(flat | ~good, 0.0).otherwise(F.col("ic") / F.when(good, F.col("nw_se")))
    g = g.withColumn("ic_t_stat", t)
    p = F.when(flat & ~zero, 0.0).when(flat | ~good, 1.0).otherwise(t_p_value(F.abs("ic_t_stat"), F.greatest(F.col("n_samples") - 1, F.lit(1)).cast("double")))
    g = g.withColumn("p_value", p)
    hits = F.when(F.col("ic") > 0, F.col("_pos")).otherwise(F.col("_neg"))
    g = g.withColumn("ic_hit_rate", F.when(zero, 0.5).otherwise(hits / F.col("n_samples")))
    g = g.join(turnover(panel, s, keys), keys, "left")
    cost = F.col("turnover") * cost_bps / 10_000.0
    g = g.withColumn("turnover_adj_ic", F.when(F.col("ic") >= 0, F.col("ic") - cost).otherwise(F.col("ic") + cost))
    g = g.withColumn("is_significant", F.abs("ic_t_stat") > 1.96)
    base = [k for k in keys if k != "horizon"]
    # one place for each horizon of the panel, 0 where a feature has no value for it
    horizons = sorted(r[0] for r in panel.select("horizon").distinct().collect())
    dec = spearman(panel, keys, min_samples).groupBy(*base).agg(F.map_from_entries(F.collect_list(F.struct("horizon", "ic"))).alias("_d"))
    decay = F.array(*[F.coalesce(F.try_element_at("_d", F.lit(h)), F.lit(0.0)) for h in horizons])
    g = g.join(dec.select(*base, decay.alias("ic_decay")), base, "left")
    if n_boot:
        pos = series.withColumn("pos", F.col("period"))
        g = g.join(block_interval(pos, keys, n_boot, seed), keys, "left")
    return g.drop("_pos", "_neg", "nw_se", "turnover")


def turnover(panel: DataFrame, s: Ordered, keys: Sequence[str] = PANEL_KEYS) -> DataFrame:
    """Mean absolute change of the feature's rank between consecutive rows, over the row count."""
    keys = list(keys)
    s = s.with_(keys=tuple(keys))
    r = average_ranks(panel, keys, {"value": "_rk"})
    t = s.windowed(r, 1, lambda d: d.withColumn("_d", F.abs(F.col("_rk") - F.lag("_rk").over(s.window()))))
    return t.groupBy(*keys).agg((F.coalesce(F.avg("_d"), F.lit(0.0)) / F.count(F.lit(1))).alias("turnover"))


def block_interval(series: DataFrame, keys: Sequence[str], n_boot: int, seed: int = 42, value: str = "ic", confidence: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean with circular blocks whose mean length is the horizon (one of ``keys``)."""
    keys = list(keys)
    m = bootstrap_moments(series, keys, F.col("horizon").cast("double"), n_boot, seed, value)
    a = (1 - confidence) / 2
    return m.groupBy(*keys).agg(F.expr(f"percentile(m, {a})").alias("ci_low"), F.expr(f"percentile(m, {1 - a})").alias("ci_high"))


def ic_decision(ic: Column, ir: Column) -> Column:
    """KEEP needs both limits, WEAK one; the ratio is not taken absolutely."""
    a, b = F.abs(ic) >= 0.02, ir >= 0.50
    return F.when(a & b, "KEEP").when(a | b, "WEAK").otherwise("REJECT")


# -- collinearity --------------------------------------------------------------------------------
class Collinearity:
    """Correlation, variance inflation, clusters and recommended drops of K columns.

    One distributed pass collects the K x K second moments; the rest works on that matrix."""

    def __init__(self, wide: DataFrame, columns: Sequence[str], ic: dict[str, float] | None = None, max_correlation: float = 0.70, max_vif: float = 5.0):
        self.columns = list(columns)
        self.ic = {k: abs(v) for k, v in (ic or {}).items()}
        self.max_correlation, self.max_vif = max_correlation, max_vif
        self.spark = wide.sparkSession
        ok = None
        for x in self.columns:
            fin = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
            ok = fin if ok is None else ok & fin
        d = wide.filter(ok)
        k = self.columns
        up = [(i, j) for i in range(len(k)) for j in range(i, len(k))]
        row = d.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(k)],
            *[F.covar_pop(k[i], k[j]).alias(f"c{i}_{j}") for i, j in up],
        ).first()
        self.n = row["n"]
        if self.n < 100:
            raise ValueError(f"only {self.n} complete rows, at least 100 needed")
        self.mean = np.array([row[f"m{i}"] for i in range(len(k))])
        c = np.zeros((len(k), len(k)))
        for i, j in up:
            c[i, j] = c[j, i] = row[f"c{i}_{j}"]
        self.cov = c
        sd = np.sqrt(np.diag(c))
        with np.errstate(divide="ignore", invalid="ignore"):
            rho = c / np.outer(sd, sd)
        rho[~np.isfinite(rho)] = 0.0
        np.fill_diagonal(rho, 1.0)
        self.rho = rho
        self.clusters = self._cluster()

    def vif(self) -> dict[str, float]:
        """1/(1-R^2) of each column on the others: the diagonal of the inverse correlation matrix."""
        out = {}
        for i, x in enumerate(self.columns):
            if self.cov[i, i] == 0:
                out[x] = math.inf
                continue
            o = [j for j in range(len(self.columns)) if j != i and self.cov[j, j] > 0]
            r2 = float(self.rho[i, o] @ np.linalg.pinv(self.rho[np.ix_(o, o)]) @ self.rho[o, i]) if o else 0.0
            out[x] = math.inf if r2 >= 1 else 1 / (1 - r2)
        return out

    def condition_number(self) -> float:
        """Of the raw data matrix: root of the eigenvalue ratio of its second moments."""
        ev = np.linalg.eigvalsh(self.cov + np.outer(self.mean, self.mean))
        return math.inf if ev[0] <= 0 else float(np.sqrt(ev[-1] / ev[0]))

    def _cluster(self) -> dict[str, int]:
        """Complete linkage on 1-|rho|, merged while the farthest pair stays within the cut-off."""
        groups = [[i] for i in range(len(self.columns))]
        dist = 1 - np.abs(self.rho)
        far = lambda a, b: max(dist[i, j] for i in a for j in b)
        while len(groups) > 1:
            d, a, b = min((far(groups[a], groups[b]), a, b) for a, b in itertools.combinations(range(len(groups)), 2))
            if d > 1 - self.max_correlation:
                break
            groups[a] += groups.pop(b)
        return {self.columns[i]: g + 1 for g, members in enumerate(sorted(groups, key=min)) for i in members}

    def keepers(self) -> dict[int, str]:
        best: dict[int, str] = {}
        for x in self.columns:
            g = self.clusters[x]
            if g not in best or self.ic.get(x, 0.0) > self.ic.get(best[g], 0.0):
                best[g] = x
        return best

    def drops(self) -> list[str]:
        keep = set(self.keepers().values())
        return sorted(x for x in self.columns if x not in keep)

    def matrix(self) -> DataFrame:
        rows = [(a, b, float(self.rho[i, j])) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns)]
        return self.spark.createDataFrame(rows, "a string, b string, correlation double")

    def pairs(self) -> DataFrame:
        return self.matrix().filter((F.col("a") < F.col("b")) & (F.abs("correlation") >= self.max_correlation))

    def table(self) -> DataFrame:
        v, drop = self.vif(), set(self.drops())
        rows = [(x, float(v[x]), self.clusters[x], x not in drop, v[x] >= self.max_vif, self.n) for x in self.columns]
        return self.spark.createDataFrame(rows, "feature string, vif double, cluster int, keeper boolean, high_vif boolean, n_rows long")

    def apply(self, wide: DataFrame, method: str = "drop") -> DataFrame:
        """Resolve clusters: ``drop`` the others, ``residualize`` them on the keeper, or replace a cluster by its first ``pca`` component."""
        keep = self.keepers()
        if method == "drop":
            return wide.drop(*self.drops())
        at = {x: i for i, x in enumerate(self.columns)}
        members: dict[int, list[str]] = {}
        for x, g in self.clusters.items():
            members.setdefault(g, []).append(x)
        if method == "residualize":
            todo = [(keep[g], x) for g, m in members.items() for x in m if x != keep[g]]
            if not todo:
                return wide
            fits = []
            for k, (a, x) in enumerate(todo):
                good = F.col(a).isNotNull() & F.col(x).isNotNull() & ~F.isnan(a) & ~F.isnan(x)
                ya, xa = F.when(good, F.col(x)), F.when(good, F.col(a))
                fits += [F.regr_slope(ya, xa).alias(f"s{k}"), F.regr_intercept(ya, xa).alias(f"i{k}")]
            f = wide.agg(*fits).first()
            cols = {}
            for k, (a, x) in enumerate(todo):
                s = f[f"s{k}"]
                i = f[f"i{k}"]
                cols[x] = F.col(x) - (F.lit(i) + F.lit(s) * F.col(a)) if s is not None else F.col(x)
            return wide.withColumns(cols)
        if method == "pca":
            for g, m in members.items():
                if len(m) < 2:
                    continue
                ix = [at[x] for x in m]
                vec = np.linalg.eigh(self.cov[np.ix_(ix, ix)])[1][:, -1]
                vec = vec * (1 if vec[np.argmax(np.abs(vec))] > 0 else -1)
                score = add([F.lit(float(c)) * (F.col(x) - float(self.mean[at[x]])) for c, x in zip(vec, m)])
                wide = wide.withColumn(f"pc_{g}", score).drop(*m)
            return wide
        raise ValueError(f"unknown method {method}")


# -- splits ---------------------------------------------------------------------------------------
def _combos(n: int, k: int) -> Column:
    rows = [F.struct(F.lit(i).alias("split_id"), F.array(*[F.lit(g) for g in c]).alias("test")) for i, c in enumerate(itertools.combinations(range(n), k))]
    return F.array(*rows)


def combinatorial_splits(labels: DataFrame, s: Ordered, n_splits: int = 6, n_test: int = 2, embargo_pct: float = 0.01) -> DataFrame:
    """Role ('train' or 'test') of every row in each of the C(n, k) splits; purged and embargoed rows are absent.

    Rows (t0, t1 and the columns of ``s``) are numbered per key and cut into contiguous groups, the first
    ones taking the remainder. Group limits travel as one small array per key."""
    keys = list(s.keys)
    r = s.running(labels)
    n = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, keys)
    base, rem = F.floor(F.col("_n") / n_splits), F.col("_n") % n_splits
    big = rem * (base + 1)
    i = F.col(INDEX)
    grp = F.when(i < big, F.floor(i / (base + 1))).otherwise(rem + F.floor((i - big) / F.greatest(base, F.lit(1))))
    r = r.withColumn("grp", grp.cast("int"))
    lim = r.groupBy(*keys, "grp").agg(F.min_by("t0", INDEX).alias("a"), F.max_by("t1", INDEX).alias("b"), F.max(INDEX).alias("e"))
    lim = lim.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("grp", "a", "b", "e"))).alias("_g"))  # n_splits entries
    r = r.join(lim, keys).withColumn("_s", F.explode(_combos(n_splits, n_test)))
    emb = F.floor(F.col("_n") * embargo_pct)
    test = F.array_contains("_s.test", F.col("grp"))
    near = F.exists(
        "_s.test",
        lambda g: (
            ((F.col("t1") >= F.element_at("_g", g + 1).a) & (F.col("t1") <= F.element_at("_g", g + 1).b))
            | ((F.col(INDEX) > F.element_at("_g", g + 1).e) & (F.col(INDEX) <= F.element_at("_g", g + 1).e + emb))
        ),
    )
    r = r.withColumn("role", F.when(test, "test").when(~near, "train")).filter("role IS NOT NULL")
    return r.select(*labels.columns, F.col(INDEX).alias("pos"), "grp", F.col("_s.split_id").alias("split_id"), "role")


def _group_sums(returns: DataFrame, keys: Sequence[str], n_splits: int, embargo_pct: float, value: str) -> DataFrame:
    """Sums per contiguous group, in full and without the first rows that an embargo would take."""
    keys = list(keys)
    n = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = returns.join(n, keys)
    size = F.floor(F.col("_n") / n_splits)
    g = F.least(F.floor(F.col("pos") / F.greatest(size, F.lit(1))), F.lit(n_splits - 1)).cast("int")
    r = r.withColumn("grp", g)
    late = (F.col("pos") - F.col("grp") * size) >= F.floor(F.col("_n") * embargo_pct)
    x = F.col(value)
    return r.groupBy(*keys, "grp").agg(
        *[F.sum(F.when(c, v).otherwise(0.0)).alias(nm) for nm, c, v in (
            ("n0", F.lit(True), F.lit(1.0)), ("s0", F.lit(True), x), ("q0", F.lit(True), x * x),
            ("n1", late, F.lit(1.0)), ("s1", late, x), ("q1", late, x * x),
        )]
    )


def split_sharpes(returns: DataFrame, keys: Sequence[str], n_splits: int = 6, n_test: int = 2, embargo_pct: float = 0.01, risk_free: float = 0.0, value: str = "ret") -> DataFrame:
    """In- and out-of-sample Sharpe per key and combination, from per-group sums only.

    ``pos`` numbers the rows of a key from 0. The last group takes the remainder; rows right after a test
    group are embargoed. No row is repeated per combination. The embargo must be shorter than a group."""
    if embargo_pct * n_splits >= 1:
        raise ValueError("the embargo reaches over a whole group")
    keys = list(keys)
    v = returns.withColumn("_x", F.col(value) - risk_free / ANNUAL**2)
    g = _group_sums(v, keys, n_splits, embargo_pct, "_x")
    g = g.withColumn("_s", F.explode(_combos(n_splits, n_test)))
    test = F.array_contains("_s.test", F.col("grp"))
    after = F.array_contains("_s.test", F.col("grp") - 1)
    role = F.when(test, "oos").otherwise("is")
    pickv = lambda a: F.when(test | ~after, F.col(f"{a}0")).otherwise(F.col(f"{a}1"))
    t = g.groupBy(*keys, F.col("_s.split_id").alias("split_id"), role.alias("role")).agg(
        F.sum(pickv("n")).alias("n"), F.sum(pickv("s")).alias("s"), F.sum(pickv("q")).alias("q")
    )
    m = F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    var = (F.col("q") - F.col("s") * m) / F.when(F.col("n") > 1, F.col("n") - 1)
    t = t.withColumn("sharpe", sharpe_column(m, F.sqrt(F.greatest(F.lit(0.0), var)), F.col("n")))
    return t.groupBy(*keys, "split_id").pivot("role", ["is", "oos"]).agg(F.first("sharpe")).withColumnsRenamed({"is": "is_sharpe", "oos": "oos_sharpe"})


def combinatorial_verdict(sharpes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of splits whose out-of-sample Sharpe lies below the in-sample median, and the verdict."""
    keys = list(keys)
    med = sharpes.groupBy(*keys).agg(F.median("is_sharpe").alias("is_median"))
    g = sharpes.join(med, keys).groupBy(*keys, "is_median").agg(
        F.avg((F.col("oos_sharpe") < F.col("is_median")).cast("double")).alias("pbo"),
        F.avg("oos_sharpe").alias("oos_mean"), F.stddev_pop("oos_sharpe").alias("oos_std"), F.median("oos_sharpe").alias("oos_median"),
        F.count(F.lit(1)).alias("n_combinations"),
    )
    rec = F.when((F.col("pbo") < 0.25) & (F.col("oos_median") > 0.5), "DEPLOY").when(F.col("pbo") < 0.50, "INVESTIGATE").otherwise("DISCARD")
    return g.withColumn("recommendation", rec)


def rank_overfitting(scores: DataFrame, split: str = "split_id", name: str = "strategy_id", is_: str = "is_sharpe", oos: str = "oos_sharpe", keys: Sequence[str] = ()) -> DataFrame:
    """Per split the out-of-sample rank position of the in-sample best (first by name on ties), as logit."""
    part = [*keys, split]
    s = scores.withColumn("_r", ranks_in(part, oos)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    order = Window.partitionBy(*part).orderBy(F.desc(is_), name)
    best = s.withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    omega = (F.col("_r") + 0.5) / (F.col("_n") + 1)
    return best.select(*part, F.col(name).alias("best"), omega.alias("omega"), F.log(omega / (1 - omega)).alias("logit"))


def overfitting_probability(logits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = logits.groupBy(*keys).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))
    return g.withColumn("is_overfit", F.col("pbo") > 0.5).withColumn("passes_strict", F.col("pbo") < 0.10)


def walk_forward_windows(bounds: DataFrame, n_windows: int = 6, train_months: int = 3, test_months: int = 1, embargo_minutes: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """Expanding train and following test windows in 30-day months, from rows (keys, data_start, data_end)."""
    day = 86_400_000_000
    us = lambda c: F.unix_micros(F.col(c))
    t = bounds.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    a = us("data_start") + train_months * 30 * day + F.col("window_id") * (test_months * 30 * day)
    b = a + test_months * 30 * day
    e = embargo_minutes * 60_000_000
    ts = F.timestamp_micros
    return t.filter(b <= us("data_end")).select(
        *keys, "window_id", F.col("data_start").alias("train_start"), ts(a - e).alias("train_end"), ts(a).alias("test_start"), ts(b).alias("test_end"), ts(b + e).alias("embargo_end")
    )


def assign_windows(rows: DataFrame, windows: DataFrame, time: str, keys: Sequence[str] = (), minimum: int = 100) -> DataFrame:
    """Rows with their window and role; a window counts only with enough test rows.

    The few windows of a key travel with each row as an array, which is filtered to the ones that apply."""
    keys = list(keys)
    w = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("window_id", "train_start", "train_end", "test_start", "test_end"))).alias("_w"))
    j = rows.join(w, keys) if keys else rows.crossJoin(F.broadcast(w))  # one row of windows
    t = F.col(time)
    hit = F.transform(
        "_w",
        lambda x: F.struct(
            x.window_id.alias("window_id"),
            F.when((t >= x.test_start) & (t < x.test_end), "test").when((t >= x.train_start) & (t < x.train_end), "train").alias("role"),
        ),
    )
    j = j.withColumn("_h", F.explode(F.filter(hit, lambda x: x.role.isNotNull()))).select(*rows.columns, "_h.window_id", "_h.role")
    big = j.filter("role = 'test'").groupBy(*keys, "window_id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= minimum).drop("_k")
    return j.join(big, [*keys, "window_id"])


def walk_forward_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, minimum and spread of per-window results (sharpe, max_drawdown, win_rate, n_trades)."""
    g = results.groupBy(*keys).agg(
        F.avg("sharpe").alias("oos_sharpe_mean"), F.min("sharpe").alias("oos_sharpe_min"), F.stddev_pop("sharpe").alias("oos_sharpe_std"),
        F.avg("max_drawdown").alias("oos_max_dd_mean"), F.avg("win_rate").alias("oos_win_rate_mean"), F.count(F.lit(1)).alias("n_windows"), F.sum("n_trades").alias("n_total_trades"),
    )
    return g.withColumn("is_consistent", F.col("oos_sharpe_std") < 0.5)


def tick_walk_forward(rows: DataFrame, s: Ordered, n_splits: int = 5, embargo: int = 50) -> DataFrame:
    """Row-count walk-forward: each row with its role per split, by arithmetic on the dense index.

    A quarter window before a test block and ``embargo`` rows after it belong to neither side."""
    keys = list(s.keys)
    r = s.running(rows)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, keys).withColumn("_w", F.floor(F.col("_n") / n_splits)).withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    a = F.col("split_id") * F.col("_w")
    b = F.when(F.col("split_id") < n_splits - 1, a + F.col("_w")).otherwise(F.col("_n"))
    i = F.col(INDEX)
    purge = F.greatest(F.lit(0), a - F.floor(F.col("_w") / 4))
    role = F.when((i >= a) & (i < b), "test").when((i < purge) | (i >= F.least(b + embargo, F.col("_n"))), "train")
    return r.withColumn("role", role).filter("role IS NOT NULL").select(*rows.columns, "split_id", "role")


# -- hypothesis tests -------------------------------------------------------------------------------
def adjust_p_values(df: DataFrame, p: str = "p_value", keys: Sequence[str] = (), alpha: float = 0.05, name: str = "feature") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values over a family of hypotheses (report-sized)."""
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    up = part.orderBy(p, name)
    d = df.withColumn("_m", F.count(F.lit(1)).over(part)).withColumn("_i", F.row_number().over(up))
    d = d.withColumn("_h", F.col(p) * (F.col("_m") - F.col("_i") + 1)).withColumn("_b", F.col(p) * F.col("_m") / F.col("_i"))
    holm = F.least(F.lit(1.0), F.max("_h").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min("_b").over(up.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("p_holm", holm).withColumn("p_bh", bh)
    return d.withColumn("reject_holm", F.col("p_holm") <= alpha).withColumn("reject_bh", F.col("p_bh") <= alpha).drop("_m", "_i", "_h", "_b")


def hypothesis_decisions(stats: DataFrame, pbo: Column | None = None, correction: str = "holm", alpha: float = 0.05) -> DataFrame:
    """pass/fail per feature with reasons, from columns dsr, p_holm, p_bh."""
    reasons = [F.when(F.col("dsr") < 0.95, "dsr")]
    if pbo is not None:
        reasons.append(F.when(pbo >= 0.10, "pbo"))
    if correction in ("holm", "bh"):
        reasons.append(F.when(F.col(f"p_{correction}") > alpha, f"p_{correction}"))
    d = stats.withColumn("fail_reasons", F.array_compact(F.array(*reasons)))
    return d.withColumn("decision", F.when(F.size("fail_reasons") == 0, "pass").otherwise("fail"))


def select_features(
    ic: DataFrame, collinearity: DataFrame | None = None, hypothesis: DataFrame | None = None, pbo: float | None = None,
    ic_min: float = 0.02, ir_min: float = 0.50, p_max: float = 0.05, vif_max: float = 5.0, dsr_min: float = 0.95, psr_min: float = 0.90, alpha: float = 0.05, pbo_max: float = 0.10, mht_required: bool = True,
) -> DataFrame:
    """keep/reject per feature with every failed gate; missing evidence is itself a reason."""
    d = ic
    d = d.join(collinearity.select("feature", "vif", "cluster", "keeper"), "feature", "left") if collinearity is not None else d.withColumns(
        {"vif": F.lit(None).cast("double"), "cluster": F.lit(None).cast("int"), "keeper": F.lit(None).cast("boolean")}
    )
    d = d.join(hypothesis.select("feature", "psr", "dsr", "p_holm"), "feature", "left") if hypothesis is not None else d.withColumns(
        {x: F.lit(None).cast("double") for x in ("psr", "dsr", "p_holm")}
    )
    c = F.col
    untested = c("dsr").isNull()
    rules = [
        (F.abs("ic") < ic_min, "ic_mean"),
        (c("ic_ir") < ir_min, "ic_ir"),
        (c("p_value") > p_max, "ic_p_value"),
        (c("vif").isNull(), "vif_not_computed"),
        (c("vif") > vif_max, "vif"),
        (~c("keeper"), "cluster_dropped_by_ic_ranking"),
        (untested, "dsr_not_computed"),
        (c("dsr") < dsr_min, "dsr"),
        (c("psr") < psr_min, "psr"),
        (~untested & c("p_holm").isNull() & F.lit(mht_required), "p_value_holm_missing"),
        (c("p_holm") > alpha, "p_value_holm"),
        (F.lit(pbo is not None and pbo > pbo_max), "pbo"),
    ]
    d = d.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(cond, F.lit(n)) for cond, n in rules])))
    d = d.withColumn("decision", F.when(F.size("reject_reasons") == 0, "keep").otherwise("reject"))
    return d.orderBy(F.col("decision"), F.desc_nulls_last("dsr"))


def active_features(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of features marked keep."""
    return values.join(decisions.filter("decision = 'keep'").select("feature").distinct(), "feature", "left_semi")


def warm(df: DataFrame, n: int, s: Ordered) -> DataFrame:
    """Rows after the first ``n`` of each series."""
    r = s.running(df)
    return r.filter(F.col(INDEX) >= n).drop(INDEX)


# -- classifier scores ------------------------------------------------------------------------------
def weighted_auc(scores: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "y", w: str = "w", **split: int) -> DataFrame:
    """Weighted area under the ROC curve from class weights per distinct score (any range, no group is sorted whole)."""
    keys = list(keys)
    d = scores.groupBy(*keys, F.col(p).alias("_p")).agg(
        F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0.0)).alias("_a"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0.0)).alias("_b")
    )
    d = below(d, keys, "_p", {"_low": F.col("_b")}, **split)
    g = d.groupBy(*keys).agg(F.sum(F.col("_a") * (F.col("_low") + F.col("_b") / 2)).alias("u"), F.sum("_a").alias("pos"), F.sum("_b").alias("neg"))
    return g.select(*keys, ratio(F.col("u"), F.col("pos") * F.col("neg")).alias("auc"))


def weighted_brier(scores: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    e = F.col(w) * F.pow(F.col(p) - F.col(y), 2)
    return scores.groupBy(*keys).agg((F.sum(e) / F.sum(w)).alias("brier"))


def calibration(scores: DataFrame, keys: Sequence[str] = (), bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(*keys, b.alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate"), F.count(F.lit(1)).alias("n"))
