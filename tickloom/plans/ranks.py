"""Order statistics over large groups without sorting a whole group in one task.

A large group is cut at sampled splitters, so its cells hold about as many distinct values each, whatever
the distribution; what lies below a cell comes from a small table of cell totals. The sample is taken by a
hash of the value: a recomputed task draws the same splitters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = "_cell"
_SALTS = 16


def splitters(df: DataFrame, keys: Sequence[str], value: str, rate: int = 1024, per_cell: int = 16, max_cells: int = 4096) -> DataFrame:
    """One row for each group of ``keys`` that is worth cutting, with its ascending splitters ``_cuts``.

    One distinct value in ``rate`` is sampled, and ``per_cell`` samples make a cell: about
    ``rate * per_cell`` distinct values. The sample of a huge group is thinned, so that it has at most
    ``max_cells`` cells. Groups that would have one cell have no row."""
    keys = list(keys)
    v = F.col("_v")
    s = df.filter(F.pmod(F.xxhash64(value), F.lit(rate)) == 0).select(*keys, F.col(value).alias("_v")).filter(v.isNotNull()).distinct()
    n = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * per_cell)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / (per_cell * max_cells)))
    kept = s.join(n, keys).filter(F.pmod(F.xxhash64(v, F.lit(1)), every) == 0)
    g = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    m = F.size("_s")
    g = g.withColumn("_m", m).withColumn("_k", F.least(F.lit(max_cells), F.floor(m / per_cell)).cast("int")).filter(F.col("_k") >= 2)
    cuts = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_s", F.floor(i * F.col("_m") / F.col("_k")).cast("int")))
    return g.select(*keys, cuts.alias("_cuts"))


def cells(df: DataFrame, keys: Sequence[str], value: str, rate: int = 1024, per_cell: int = 16, max_cells: int = 4096) -> DataFrame:
    """Add ``_cell``, the number of splitters at or below ``value`` (equal values share a cell; null is in cell 0).

    The splitters of a group are repeated for a few salts, so a hot group meets them in many tasks."""
    keys = list(keys)
    cut = splitters(df, keys, value, rate, per_cell, max_cells).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    d = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(_SALTS)).cast("int")).join(cut, [*keys, "_salt"], "left")
    # binary search by powers of two; an index behind the last splitter gives null
    steps = F.array(*[F.lit(1 << b) for b in range((max_cells - 1).bit_length(), -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.get("_cuts", a + step - 1) <= F.col(value), a + step).otherwise(a))
    d = d.withColumn(CELL, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(at))
    return d.select(*df.columns, CELL)


def below(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], tie: Sequence[str] = (), **split: int) -> DataFrame:
    """Add the sum of each column over the rows of the group that come before, in the order of ``value`` and ``tie``.

    Rows that agree in ``value`` and ``tie`` come one after another in no defined order. Nulls count as 0.
    ``split`` goes to :func:`splitters`. ``df`` is read several times: pass a materialised table if it is expensive."""
    if not keys:
        return below(df.withColumn("_all", F.lit(0)), ["_all"], value, sums, tie, **split).drop("_all")
    keys = list(keys)
    d = df.withColumns({f"_s_{n}": e for n, e in sums.items()})
    d = cells(d, keys, value, **split)
    at = [*keys, CELL]
    total = d.groupBy(*at).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)  # at most ``max_cells`` rows
    carry = total.select(*at, *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums])
    w = Window.partitionBy(*at).orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_i_{n}": F.sum(f"_s_{n}").over(w) for n in sums}).join(carry, at, "left")
    zero = F.lit(0)
    return d.select(*df.columns, *[(F.coalesce(F.col(f"_o_{n}"), zero) + F.coalesce(F.col(f"_i_{n}"), zero)).alias(n) for n in sums])


def average_ranks(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], **split: int) -> DataFrame:
    """Add the average rank of each column within ``keys`` (``values``: column -> output name; ties share
    their mean rank, nulls get null). The columns must have the same type.

    Values of all columns are first counted per distinct value, so a constant column is one row; then
    :func:`below` counts what lies under each. ``df`` is read several times: pass a materialised table if
    it is expensive."""
    keys = list(keys)
    k = [*keys, "_col"]
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in values]))
    tall = df.select(*keys, cols.alias("_x")).select(*keys, F.col("_x.c").alias("_col"), F.col("_x.v").alias("_v"))
    cnt = tall.filter(F.col("_v").isNotNull()).groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    r = below(cnt.withColumnRenamed("_v", "_x"), k, "_x", {"_u": F.col("_c")}, **split)
    ranks = r.select(*k, "_x", (F.col("_u") + (F.col("_c") + 1) / 2.0).alias("_r"))
    for c, out in values.items():
        one = ranks.filter(F.col("_col") == c).select(*keys, F.col("_x").alias(c), F.col("_r").alias(out))
        df = df.join(one, [*keys, c], "left")
    return df


def ranks_in(keys: Sequence[str], value: str):
    """Average rank as a window expression, for groups known to be small."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0
