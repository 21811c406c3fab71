"""Packing along a space-filling curve: documents that are alike become neighbours, then share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

DIMS, DEPTH, BUCKETS, FINE = 3, 15, 1024, 16


def hilbert_key(points: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``depth`` bits in each dimension (J. Skilling, 2004), for all rows at once."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for b in range(depth - 1, 0, -1):
        q = 1 << b
        for i in range(d):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= np.where(high, 0, swap)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(depth - 1, 0, -1):
        t ^= np.where((x[d - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(depth - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projector:
    """Hashed count vectors of token ids, damped and of unit length, on a few fixed random directions.

    A coordinate of a random direction is about normal with deviation 1; it is cut to plus or minus 3 and stored in
    ``DEPTH`` bits, so no statistic of the corpus is needed."""

    def __init__(self, seed: int = 0) -> None:
        self.axes = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
        self.bucket = (common.mix(np.arange(1 << 17, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Points of all documents of a batch: ``ids`` one after another, ``ends`` of each document there."""
        n = len(ends)
        owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(ends, prepend=0))
        many = np.bincount(owner + self.bucket[ids.astype(np.int32) & 0x1FFFF], minlength=n * BUCKETS)
        cell = np.flatnonzero(many)
        value = np.log1p(many[cell])
        rows = np.searchsorted(cell, np.arange(n + 1, dtype=np.int64) * BUCKETS)
        parts = np.zeros((len(cell) + 1, DIMS + 1))
        parts[1:, :DIMS] = self.axes[cell % BUCKETS] * value[:, None]
        parts[1:, DIMS] = value * value
        run = np.cumsum(parts, axis=0)
        total = run[rows[1:]] - run[rows[:-1]]
        out = total[:, :DIMS] / np.sqrt(np.maximum(total[:, DIMS:], 1e-12))
        return np.clip((out + 3) / 6 * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id``, ``place`` on the curve, ``n_tokens`` and ``ids``, written once in the shared folder.

    The place has 45 bits of the curve and 18 of a hash of doc_id, so that equal documents spread over ranges too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, project = encoder(tokenizer), Projector()
        end = np.array([end_id], enc.kind).tobytes()
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                plain = enc.encode(batch.column("text").to_pylist())
                n = np.array([len(x) // enc.kind.itemsize for x in plain], np.int64)
                key = hilbert_key(project(np.frombuffer(b"".join(plain), enc.kind), np.cumsum(n)), DEPTH)
                place = (key << 18) | (batch.column("h").to_numpy() & ((1 << 18) - 1))
                raw = [x + end for x in plain]
                n += 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(place), pa.array(n), pa.array(raw, pa.binary())], ["doc_id", "place", "n_tokens", "ids"])

    return common.written(rows.mapInArrow(encode, "doc_id long, place long, n_tokens long, ids binary"))


def token_ranges(table: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Cuts of the curve into ranges of like token totals, and these totals. Finer ranges of like row counts are joined until each
    has its share of tokens; their totals, FINE numbers for each range, pass the driver."""
    fine = common.cut_points(table, F.col("place"), parts * FINE)
    totals = table.select(common.part_of(F.col("place"), fine).alias("part"), "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sizes = np.zeros(len(fine) + 1, np.int64)
    for part, n in totals.collect():
        sizes[part] = n
    middle = np.cumsum(sizes) - sizes // 2
    owner = np.minimum(middle * parts // max(int(sizes.sum()), 1), parts - 1)
    turns = np.flatnonzero(owner[1:] != owner[:-1])
    cuts = fine[turns]
    return cuts, {p: int(x.sum()) for p, x in enumerate(np.split(sizes, turns + 1))}


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, one row for each piece:
    ``doc_id``, ``start`` and ``doc_tokens`` in its document, ``sequence_id``, ``offset`` and ``length`` in its sequence, ``ids``
    (little-endian unsigned 32-bit).

    Documents (null text: empty; each ends with ``end_id``) lie one after another along the curve, and that line of
    tokens is cut at every multiple of ``length``; only the last sequence can be shorter, and its rest is cut into
    powers of two, which need no padding. Equal places are ordered by doc_id (null first), then by content; repeated
    rows are packed each. Ranges of the curve are packed by themselves once the token totals of all ranges, a number
    each, have gone through the driver. An empty table gives no rows."""
    spark = docs.sparkSession
    table = token_table(docs, tokenizer, end_id)
    key = F.col("place")
    cuts, rows = token_ranges(table, common.n_parts(spark))
    first, total = {}, 0
    for p in sorted(rows):
        first[p], total = total, total + rows[p]
    tail = total // length * length
    sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1) if (total - tail) >> b & 1]
    ends = np.array([0, *np.cumsum(sizes)]) + tail  # borders of the sequences of the rest
    ordered = common.in_ranges(table, key, cuts, ["place", F.col("doc_id").asc_nulls_first(), "ids"])
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        at: dict[int, int] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                out: list[list] = [[] for _ in names]
                for part, doc, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                    ids = np.frombuffer(raw, kind).astype("<u4")
                    pos = at.get(part, first[part])
                    at[part] = pos + len(ids)
                    start = 0
                    while start < len(ids):
                        here = pos + start
                        if here < tail:
                            seq, low, high = here // length, here // length * length, here // length * length + length
                        else:
                            k = int(np.searchsorted(ends, here, side="right")) - 1
                            seq, low, high = tail // length + k, int(ends[k]), int(ends[k + 1])
                        n = min(len(ids) - start, high - here)
                        for column, v in zip(out, (doc, start, n, len(ids), seq, here - low, ids[start : start + n].tobytes())):
                            column.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names, out)], names)

    return ordered.select("part", "doc_id", "ids").mapInArrow(cut, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names))
