"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROUNDS = 6


class Permutation:
    """A bijection of 0 to n - 1 that any process can compute, forwards and backwards, from n and the seed."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = common.mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15))

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        return common.mix(x ^ key) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for key in keys[::-1] if back else keys:
            left, right = (right ^ self._round(left, key), left) if back else (right, left ^ self._round(right, key))
        return (left << h) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64).astype(np.uint64)
        if self.n <= 1:
            return x.astype(np.int64)
        out = self._pass(x, self.keys, back)
        while (far := out >= np.uint64(self.n)).any():  # the domain has under 8 n values, so few walk far
            out[far] = self._pass(out[far], self.keys, back)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


def shard_rows(df: DataFrame, id_col: str, tie: list[str | Column], shards: int = 24, seed: int = 0) -> DataFrame:
    """Adds ``row_number`` (rank by id, null first, then by ``tie``), ``place`` (its shuffled number), ``shard`` and ``slot``.

    Shard and slot are ``place % shards`` and ``place // shards``: shard sizes differ by one row at most, slots have no
    gaps, and ``Permutation`` tells where any row number went without reading anything. Equal rows get neighbouring row
    numbers in any order; which of them is which can't be told. Rows are numbered by ranges of the id, and one count for
    each range goes through the driver. An empty table gives no rows. The columns ``row_number``, ``place``, ``shard``,
    ``slot`` and ``part`` must be free."""
    spark = df.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    cuts = common.cut_points(df, key, common.n_parts(spark))
    sizes = df.select(common.part_of(key, cuts).alias("part")).groupBy("part").count()
    first = common.before_part(sizes)
    n = df.count()
    perm = Permutation(n, seed)
    ordered = common.in_ranges(df, key, cuts, [F.col(id_col).asc_nulls_first(), *tie])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            rows = np.empty(len(parts), np.int64)
            for p in np.unique(parts).tolist():
                at = np.flatnonzero(parts == p)
                rows[at] = first[p] + seen.get(p, 0) + np.arange(len(at))
                seen[p] = seen.get(p, 0) + len(at)
            place = perm.place(rows)
            own = batch.select([c for c in batch.schema.names if c != "part"])
            more = [rows, place, (place % shards).astype(np.int32), place // shards]
            yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, more)], [*own.schema.names, "row_number", "place", "shard", "slot"])

    added = [T.StructField("row_number", T.LongType()), T.StructField("place", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return ordered.mapInArrow(number, T.StructType([*df.schema.fields, *added]))
