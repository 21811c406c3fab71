"""Periodic runs of words, found by catchers over power-of-two blocks while the text grows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that one set of catchers sees at most, unless a single document has more.
TOGETHER = 1 << 18
#: Comparisons made at once.
CELLS = 1 << 22


class Catchers:
    """Squares of a sequence of words that grows by ``append``.

    A square of period q, 2 B - 1 <= q <= 4 B - 2 with B a power of two, holds in its first half a whole block of B words that
    begins at a multiple of B. So each such block, once complete, is a catcher for these periods: every appended word
    completes a suffix of B words, which is compared with the blocks whose distance to it is a period of theirs (four to five
    of them for each B). Suffixes are compared by 64-bit names, made by doubling. Catches of one period that follow each other
    merge to one stretch of equal words; ``runs`` extends the stretches to both sides by names of halves, quarters and so on,
    and then compares the words themselves. ``append`` takes any number of words, and its pieces do not show in the result.

    ``longest`` bounds the length of a square from above (by default the sequence itself); a caller that lays several
    documents side by side, parted by words that occur once, gives the length of the longest."""

    def __init__(self, longest: int | None = None, seed: int = 0) -> None:
        self.longest, self.seed = longest, seed
        self.words = np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def append(self, words: np.ndarray) -> int:
        """Takes the next words; returns the number of catches."""
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n, level, found = len(self.words), 0, 0
        reach = n if self.longest is None else min(n, self.longest)
        while 2 * (2 * (size := 1 << level) - 1) <= reach:
            if level == len(self.names):
                self.names.append(np.zeros(0, np.uint64))
                self.caught.append([])
            known = len(self.names[level])
            self._grow(level, size)
            found += self._compare(level, size, known)
            level += 1
        return found

    def _grow(self, level: int, size: int) -> None:
        known, end = len(self.names[level]), len(self.words) - size + 1
        if level == 0:
            new = self.words[known:].astype(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        else:
            below, half = self.names[level - 1], size // 2
            new = below[known:end] * np.uint64(0xBF58476D1CE4E5B9) + below[known + half : end + half]
        self.names[level] = np.concatenate([self.names[level], common.mix(new)])

    def _compare(self, level: int, size: int, known: int) -> int:
        """Blocks of one size against the suffixes that were named last."""
        h, found = self.names[level], 0
        nearest, wide = 2 * size - 1, 2 * size
        first = max(0, -((4 * size - 2 - known) // size))
        last = (len(h) - 1 - nearest) // size
        if last < first:
            return 0
        padded = np.concatenate([h, np.zeros(wide, np.uint64)])
        step = max(1, CELLS // wide)
        for j in range(first, last + 1, step):
            rows = min(step, last + 1 - j)
            suffixes = as_strided(padded[j * size + nearest :], (rows, wide), (size * 8, 8))
            row, column = np.nonzero(suffixes == h[j * size : (j + rows - 1) * size + 1 : size, None])
            block, period = (row + j) * size, column + nearest
            at = block + period
            new = (at >= known) & (at < len(h))
            self.caught[level].append((period[new], block[new]))
            found += int(new.sum())
        return found

    def runs(self, least: int = 12) -> np.ndarray:
        """Rows (start, stop, smallest period) of all maximal runs of ``least`` words and two periods or more, by start and
        period."""
        n, out = len(self.words), [np.zeros((0, 3), np.int64)]
        for level, pairs in enumerate(self.caught):
            size = 1 << level
            period, block = (np.concatenate([x[c] for x in pairs] or [np.zeros(0, np.int64)]) for c in (0, 1))
            if not len(period):
                continue
            order = np.lexsort((block, period))
            period, block = period[order], block[order]
            joined = (period[1:] == period[:-1]) & (block[1:] == block[:-1] + size)
            begins, ends = np.flatnonzero(np.r_[True, ~joined]), np.flatnonzero(np.r_[~joined, True])
            q, lo, hi = period[begins], block[begins], block[ends] + size
            needed = np.maximum(q, least - q)
            may = hi - lo + 2 * (size - 1) >= needed
            q, lo, hi, needed = q[may], lo[may], hi[may], needed[may]
            for part in range(level - 1, -1, -1):
                h, w = self.names[part], 1 << part
                back = np.maximum(lo - w, 0)
                lo = np.where((lo >= w) & (h[back] == h[back + q]), back, lo)
                ahead = np.minimum(hi, len(h) - 1 - q)
                hi = np.where((hi + q + w <= n) & (h[ahead] == h[ahead + q]), hi + w, hi)
            good = hi - lo >= needed
            out.append(np.stack([lo, hi + q, q], 1)[good])
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        if len(found):  # the same stretch under a multiple of its smallest period
            found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)]]
        w = self.words
        for lo, stop, q in found.tolist():
            hi = stop - q
            if not (w[lo:hi] == w[lo + q : stop]).all() or (lo and w[lo - 1] == w[lo + q - 1]) or (stop < n and w[hi] == w[stop]):
                again = Catchers(self.longest, self.seed + 1)  # two names were equal by chance
                again.append(w)
                return again.runs(least)
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document (by a checksum of its id) loops from some word on; null ids have no checksum and stay as they are."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Documents of like length together, so that short ones meet few block sizes."""
    group, size = [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if group and size + lengths[i] > TOGETHER:
            yield group
            group, size = [], 0
        group.append(i)
        size += lengths[i] + 1
    if group:
        yield group


def runs_of(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """Runs (start, stop, period) of each list of words."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    for group in _groups([len(w) for w in texts]):
        longest = len(texts[group[-1]])
        if longest < 2:
            continue
        pieces, begins, at = [], [], 0
        for k, i in enumerate(group):
            begins.append(at)
            pieces += [numbered(texts[i]), np.array([-1 - k])]  # a word of its own parts two documents
            at += len(texts[i]) + 1
        c = Catchers(longest)
        c.append(np.concatenate(pieces))
        found = c.runs(least)
        owner = np.searchsorted(begins, found[:, 0], side="right") - 1
        edge = np.searchsorted(owner, np.arange(len(group) + 1))
        for k in np.unique(owner).tolist():
            out[group[k]] = found[edge[k] : edge[k + 1]] - [begins[k], begins[k], 0]
    return out


def collapse(docs: DataFrame, least: int = 12, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``, the words that stay,
    joined by one space. A run keeps its first period; words are parted by ASCII white space.

    A run is a maximal stretch of words of smallest period q that is ``least`` words and two periods long or more. ``edit`` may
    change the words of a document first. Every row is judged by itself, with its whole text and nothing shuffled; repeated
    rows and ids come out as often as they go in. Null and empty texts have no runs and an empty ``collapsed``; null ids stay
    null. Other columns are left out, so their names cannot clash. A task holds the names of one group of documents: eight
    bytes for each word and block size, at most 2^18 words or one longer document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                ids = batch.column("doc_id").to_pylist()
                words = [(t or b"").split() for t in batch.column("text").to_pylist()]
                if edit is not None:
                    words = [edit(d, w) for d, w in zip(ids, words)]
                found = runs_of(words, least)
                kept = []
                for w, r in zip(words, found):
                    if len(r):
                        turns = np.zeros(len(w) + 1, np.int64)
                        np.add.at(turns, r[:, 0] + r[:, 2], 1)
                        np.add.at(turns, r[:, 1], -1)
                        w = [w[x] for x in np.flatnonzero(np.cumsum(turns)[:-1] == 0).tolist()]
                    kept.append(b" ".join(w).decode())
                offsets = np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)
                start, stop, period = np.concatenate([*found, np.zeros((0, 3), np.int64)]).T
                cells = pa.StructArray.from_arrays([pa.array(start), pa.array(stop - start), pa.array(period)], fields=list(kind.value_type))
                listed = pa.ListArray.from_arrays(pa.array(offsets), cells)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
