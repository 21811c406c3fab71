"""Ordered computations over very long, possibly skewed, series.

A window partitioned by the series key alone puts a whole series into one task. That is fine for
series whose length is bounded by the calendar (daily or hourly bars) but not for ticks or trades,
where one key may hold a large share of all rows. This module splits a series instead:

* rows are grouped by (key, time bucket); a small per-bucket summary carries counts and sums from
  earlier buckets, which gives a dense row index and running totals with one shuffle of the rows;
* trailing frames of at most ``halo`` earlier rows are evaluated on row chunks of fixed size; each
  chunk also receives the last ``halo`` rows of the chunk before it, so results equal those of an
  unsplit window.

Everything is derived from column values, so a recomputed task sees the same split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

INDEX, BUCKET, CHUNK, HALO = "_i", "_b", "_c", "_h"


@dataclass(frozen=True)
class Ordered:
    """How a table splits into ordered series.

    ``bucket_seconds`` is the width of a time bucket: choose it so that the busiest key has a few
    million rows per bucket at most. ``chunk_rows`` is the number of rows a window task sees.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("timestamp", "seq")
    time: str = "timestamp"
    bucket_seconds: int = 86_400
    chunk_rows: int = 16_384

    def with_(self, **kw) -> "Ordered":
        return replace(self, **kw)

    # -- pieces -----------------------------------------------------------------------------
    def bucket(self) -> Column:
        return F.floor(F.unix_micros(F.col(self.time)) / F.lit(self.bucket_seconds * 1_000_000.0))

    def _order(self) -> list[Column]:
        return [F.col(c) for c in self.order]

    # -- running totals and dense index -----------------------------------------------------
    def running(
        self,
        df: DataFrame,
        sums: Mapping[str, Column] | None = None,
        maxes: Mapping[str, Column] | None = None,
        reset: Sequence[str] = (),
        index: str | None = INDEX,
    ) -> DataFrame:
        """Add a 0-based dense index and running (inclusive) sums and maxima per key.

        ``reset`` names further columns (for instance the day) at which totals start again. The rows
        are shuffled once by (key, reset, bucket); only the bucket summary is ordered by key.
        """
        sums, maxes = dict(sums or {}), dict(maxes or {})
        group = [*self.keys, *reset]
        src = df.withColumn(BUCKET, self.bucket())
        for n, e in {**sums, **maxes}.items():
            src = src.withColumn(f"_v_{n}", e)
        cells = [*group, BUCKET]
        totals = src.groupBy(*cells).agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
            *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
        )
        before = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *cells,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_p_{n}") for n in sums],
            *[F.max(f"_t_{n}").over(before).alias(f"_p_{n}") for n in maxes],
        )
        local = Window.partitionBy(*cells).orderBy(*self._order())
        cum = local.rowsBetween(Window.unboundedPreceding, 0)
        rows = src.withColumn("_rn", F.row_number().over(local))
        for n in sums:
            rows = rows.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(cum))
        for n in maxes:
            rows = rows.withColumn(f"_l_{n}", F.max(f"_v_{n}").over(cum))
        out = rows.join(carry, cells)
        cols = [F.col(c) for c in df.columns]
        if index:
            cols.append((F.col("_n0") + F.col("_rn") - 1).alias(index))
        cols += [(F.coalesce(F.col(f"_l_{n}"), F.lit(0.0)) + F.col(f"_p_{n}")).alias(n) for n in sums]
        cols += [F.greatest(F.col(f"_l_{n}"), F.col(f"_p_{n}")).alias(n) for n in maxes]
        return out.select(*cols)

    # -- chunks with halo ---------------------------------------------------------------------
    def chunks(self, df: DataFrame, halo: int, ahead: int = 0) -> DataFrame:
        """Assign rows to chunks of ``chunk_rows`` and repeat the last ``halo`` rows of each chunk
        at the start of the next (and the first ``ahead`` rows at the end of the previous one). Adds
        ``_i`` (if absent), ``_c`` and the halo flag ``_h``."""
        if max(halo, ahead) > self.chunk_rows:
            raise ValueError("halo must not exceed chunk_rows")
        if INDEX not in df.columns:
            df = self.running(df)
        size = F.lit(self.chunk_rows)
        c = F.floor(F.col(INDEX) / size)
        own = F.struct(c.alias("c"), F.lit(False).alias("h"))
        nxt = F.struct((c + 1).alias("c"), F.lit(True).alias("h"))
        at = F.col(INDEX) % size
        copies = [own]
        if halo:
            copies.append(F.when(at >= F.lit(self.chunk_rows - halo), nxt))
        if ahead:
            prv = F.struct((c - 1).alias("c"), F.lit(True).alias("h"))
            copies.append(F.when((at < F.lit(ahead)) & (c > 0), prv))
        return (
            df.withColumn("_to", F.explode(F.array_compact(F.array(*copies))))
            .withColumn(CHUNK, F.col("_to.c"))
            .withColumn(HALO, F.col("_to.h"))
            .drop("_to")
        )

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(INDEX)

    def trailing(self, k: int) -> WindowSpec:
        """The last ``k`` rows including the current one."""
        return self.window().rowsBetween(-(k - 1), 0)

    def past(self, k: int) -> WindowSpec:
        """The ``k`` rows strictly before the current one."""
        return self.window().rowsBetween(-k, -1)

    def sums_over(self, df: DataFrame, sums: Mapping[str, tuple], extra: Mapping[str, Column] | None = None) -> DataFrame:
        """Sums over trailing rows inside chunks: name -> (column, k) for the last k rows, or
        (column, k, True) for the k rows before the current one.

        Differences of a running sum: the cost does not depend on k, unlike a sliding frame, which
        re-adds its k rows for every row. Nulls count as 0. All running sums, and the window columns in
        ``extra``, share one pass over the sorted rows; a second pass looks them up k rows back."""
        w = self.window()
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        cums = {f"_cs_{n}": F.sum(F.coalesce(v[0].cast("double"), F.lit(0.0))).over(run) for n, v in sums.items()}
        df = df.withColumns({**cums, **(extra or {})})

        def diff(n: str, k: int, strict: bool = False) -> Column:
            c = F.col(f"_cs_{n}")
            back = lambda j: F.coalesce(F.lag(c, j).over(w), F.lit(0.0)) if j else c
            return back(int(strict)) - back(k + int(strict))

        return df.withColumns({n: diff(n, *v[1:]) for n, v in sums.items()}).drop(*cums)

    def frame_sums(self, df: DataFrame, sums: Mapping[str, Column], k: int) -> DataFrame:
        """Sums over the last ``k`` rows inside chunks that add rows of the frame only, so values much larger before it
        cost no digits, unlike :meth:`sums_over`; the cost does not depend on k either. Nulls count as 0.

        A frame is the end of one block of k rows and the start of the next: two running sums within blocks, one backwards."""
        w = self.window()
        df = df.withColumn("_blk", F.floor(F.col(INDEX) / F.lit(k)))
        block = Window.partitionBy(*self.keys, CHUNK, "_blk")
        whole = lambda o: block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
        v = {n: F.coalesce(x.cast("double"), F.lit(0.0)) for n, x in sums.items()}
        df = df.withColumns({f"_to_{n}": F.sum(x).over(whole(F.desc(INDEX))) for n, x in v.items()})
        df = df.withColumns({f"_of_{n}": F.sum(x).over(whole(F.asc(INDEX))) for n, x in v.items()})
        # a frame that is a whole block has no rows of the block before
        rest = lambda n: F.when(F.col(INDEX) % k != k - 1, F.lag(f"_to_{n}", k - 1).over(w))
        df = df.withColumns({n: F.col(f"_of_{n}") + F.coalesce(rest(n), F.lit(0.0)) for n in sums})
        return df.drop("_blk", *[f"{x}{n}" for n in sums for x in ("_to_", "_of_")])

    def strip(self, df: DataFrame, keep_index: bool = False) -> DataFrame:
        """Drop halo copies and helper columns."""
        helpers = [c for c in (CHUNK, HALO) if c in df.columns] + ([] if keep_index else [INDEX])
        return df.filter(~F.col(HALO)).drop(*helpers)

    def windowed(self, df: DataFrame, halo: int, fn, keep_index: bool = False, ahead: int = 0) -> DataFrame:
        """``fn`` adds columns using :meth:`trailing`/:meth:`past`/:meth:`window` frames that reach
        back at most ``halo`` rows in total (and forward at most ``ahead``)."""
        return self.strip(fn(self.chunks(df, halo, ahead)), keep_index)


TICKS = Ordered(bucket_seconds=3_600)
