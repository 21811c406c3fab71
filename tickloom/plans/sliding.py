"""Means and deviations over a sliding frame of rows, by array operations on the batches of sorted series.

Spark adds up a sliding frame anew for every row, at a cost of its length in aggregate calls. Here a batch of rows, with the
rows before it that its frames reach back to, is one array. A task holds one batch, however long a series is."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Frame:
    """``value`` in the rows from ``back`` to ``near`` places before each row; ``ddof`` is what a deviation takes off the count."""

    value: str
    back: int
    near: int = 0
    ddof: int = 0


#: Rows whose frames are spread out at once: a few arrays of this many frames fit a core's cache.
ROWS = 256


def moments(x: np.ndarray, known: np.ndarray, place: np.ndarray, f: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and deviation of the known values in the frame of each row; ``x`` and ``known`` begin ``f.back`` rows before
    the rows, ``place`` is the number of each row in its series, from 1. Equal values have a deviation of exactly 0."""
    width = f.back - f.near + 1
    values, there = (np.lib.stride_tricks.sliding_window_view(a, width) for a in (x, known))
    n, mean, sd = np.zeros(len(place), np.int64), np.zeros(len(place)), np.zeros(len(place))
    whole = known.all()
    with np.errstate(all="ignore"):
        for i in range(0, len(place), ROWS):
            o = slice(i, min(i + ROWS, len(place)))
            v, at = values[o], place[o, None]
            used = None if whole and at.min() > f.back else there[o] & (np.arange(f.back, f.near - 1, -1) < at)
            n[o] = width if used is None else used.sum(1)
            top = (v if used is None else np.where(used, v, -np.inf)).max(1)
            away = v - top[:, None] if used is None else np.where(used, v - top[:, None], 0.0)
            shift = away.sum(1) / n[o]
            away -= shift[:, None]
            if used is not None:
                away *= used
            mean[o], sd[o] = top + shift, np.sqrt(np.einsum("ij,ij->i", away, away) / np.maximum(n[o] - f.ddof, 0))
    return n, mean, sd


def sliding(df: DataFrame, place: str, frames: Mapping[str, Frame]) -> DataFrame:
    """Adds ``<name>_n`` (known values), ``<name>_m`` (mean) and ``<name>_sd`` (deviation) of each frame; nulls are not known, and
    what too few values don't give is null. ``place`` is the number of a row in its series from 1 (an integer), made by a window
    right before: rows must come series by series in that order."""
    reach = max(f.back for f in frames.values())
    values = sorted({f.value for f in frames.values()})
    new = [(f"{n}_{k}", t) for n in frames for k, t in (("n", T.LongType()), ("m", T.DoubleType()), ("sd", T.DoubleType()))]
    schema = T.StructType([*df.schema.fields, *[T.StructField(*c) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {v: (np.zeros(reach), np.zeros(reach, bool)) for v in values}
        last = 0
        for batch in batches:
            at = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(at):
                continue
            follows = np.diff(at, prepend=last) == 1
            if not (follows | (at == 1)).all():
                raise ValueError("rows of a series are not in order")
            last = int(at[-1])
            for v in values:
                c = batch.column(v).cast(pa.float64())
                x, known = c.fill_null(0.0).to_numpy(zero_copy_only=False), ~c.is_null().to_numpy(zero_copy_only=False)
                held[v] = tuple(np.concatenate(p) for p in zip(held[v], (x, known)))
            cells = []
            for f in frames.values():
                n, mean, sd = moments(*(a[reach - f.back :] for a in held[f.value]), at, f)
                cells += [pa.array(n), pa.array(mean, mask=n == 0), pa.array(sd, mask=n <= f.ddof)]
            held = {v: (x[-reach:], known[-reach:]) for v, (x, known) in held.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, *[n for n, _ in new]])

    return df.mapInArrow(run, schema)
