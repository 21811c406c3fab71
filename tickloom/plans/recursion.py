"""First-order linear recursions y[i] = a*y[i-1] + b[i] with 0 < a < 1, without a sequential scan.

Inside a block of limited length the recursion has the closed form
``y[i] = a^i * sum(a^-j * b[j], j <= i)``: a running window sum. Blocks overlap by as many rows as the
decay needs to fall below 1e-20, so what lies before a block cannot change a double precision result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import CHUNK, INDEX, Ordered
from .ranks import below

_MAX_EXPONENT = 600.0  # exp(600) is representable as a double
_MEMORY = 46.1  # exp(-46.1) < 1e-20


def decay(df: DataFrame, series: Ordered, a: float, terms: Mapping[str, Column]) -> DataFrame:
    """Add one column per entry of ``terms``: y[i] = a*y[i-1] + term[i], y[-1] = 0.

    Null terms count as 0. ``df`` may already carry the dense index ``_i`` (kept if it does).
    """
    if not 0.0 < a < 1.0:
        raise ValueError("a must lie in (0, 1)")
    rate = -math.log(a)
    halo = math.ceil(_MEMORY / rate)
    block = max(halo, math.floor(_MAX_EXPONENT / rate) - halo)
    s = series.with_(chunk_rows=block)
    had_index = INDEX in df.columns
    for n, e in terms.items():
        df = df.withColumn(f"_t_{n}", F.coalesce(e, F.lit(0.0)))
    pos = F.col(INDEX) - (F.col(CHUNK) * block - halo)

    def add(t: DataFrame) -> DataFrame:
        up = s.window().rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumn("_e", pos * F.lit(rate))
        for n in terms:
            t = t.withColumn(n, F.exp(-F.col("_e")) * F.sum(F.col(f"_t_{n}") * F.exp(F.col("_e"))).over(up))
        return t

    out = s.windowed(df, halo, add, keep_index=had_index)
    return out.drop("_e", *[f"_t_{n}" for n in terms])


def excitation(
    df: DataFrame, keys: tuple[str, ...], time: str, alpha: float, beta: float, out: str = "excitation", **split: int
) -> DataFrame:
    """Sum over strictly earlier events of alpha*exp(-beta*(t - t_i)), seconds since the event.

    Events of one time are counted first. A block spans 300/beta seconds: inside it the sum is a running sum
    of exp(beta*t_i), evaluated in cells of bounded size (:func:`~.ranks.below`), so a busy stretch is many
    tasks; from block to block the state is the affine map exp(-300)*state + total, and what lies two blocks
    back is below any double. Rows without a time or with a null key get null."""
    keys = list(keys)
    span = F.lit(300.0 / beta)
    t = F.col("_us") / F.lit(1e6)
    pts = df.groupBy(*keys, F.unix_micros(F.col(time)).alias("_us")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_us").isNotNull())
    pts = pts.withColumn("_blk", F.floor(t / span)).withColumn("_x", F.lit(beta) * (t - F.col("_blk") * span))
    pts = pts.withColumn("_w", F.col("_n") * F.exp("_x"))
    prev = pts.groupBy(*keys, (F.col("_blk") + 1).alias("_blk")).agg(F.sum("_w").alias("_prev"))
    acc = below(pts, [*keys, "_blk"], "_us", {"_acc": F.col("_w")}, **split).join(prev, [*keys, "_blk"], "left")
    state = F.exp(-F.col("_x")) * (F.col("_acc") + F.exp(F.lit(-300.0)) * F.coalesce("_prev", F.lit(0.0)))
    acc = acc.select(*keys, "_us", (F.lit(alpha) * state).alias(out))
    return df.withColumn("_us", F.unix_micros(F.col(time))).join(acc, [*keys, "_us"], "left").select(*df.columns, out)
