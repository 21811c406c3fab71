"""Scores by a bigram model whose counts lie in a log-frequency Bloom filter (Talbot and Osborne, 2007).

A count c becomes the level 1 + floor(log_base c), and the filter gets the pairs (n-gram, 1) to (n-gram, level). A count is
read back by probing level 1, 2, 3 and so on until one is missing, so it can only be too high, and by d levels with
probability 0.0022^d. Words and pairs of words have a filter each, cut into segments by hash; a segment is
filled in one task. At most ``MAX_MB`` of a filter are broadcast at a time: more counts mean more passes over the texts, not
more memory and not more errors. Words that need several passes have their levels written, one byte a token, before pairs are
looked up.

p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); a text begins after a mark and
closes with an end token. Words are named by 64-bit hashes, pairs by 40 bits and their segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE, MU, HASHES, MAX_MB = 1.5, 8.0, 5, 64
#: Bits of a segment for each entry: 29 % of the bits are set, and a missing level is read as present once in 460 probes.
ENTRY_BITS = 2 * HASHES / np.log(2)
#: Text bytes worked on at once, token rows held by a task before they are thinned out and sent, text bytes of a part at
#: most, and the share of all tokens from which a word is frequent: at most about 1 / SHARE words can be, so their exact
#: counts may be broadcast.
CHUNK, HELD, PART, SHARE = 1 << 20, 1 << 22, 1 << 26, 1e-5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_names(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of all texts in order, an end token after each text, and how many tokens each text has."""
    n_docs = len(at) - 1
    space = _SPACE[data]
    first = np.zeros(len(data), bool)
    first[1:] = space[:-1]
    first[:1] = True
    first[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(first & ~space)
    words = np.zeros(0, np.uint64)
    if len(begin):
        place = np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
        low = _LOWER[data[begin[0] :]].astype(np.uint64) + np.uint64(1)
        low[space[begin[0] :]] = 0
        words = common.mix(np.add.reduceat(low * _powers(int(place.max()) + 1)[place], begin - begin[0]))
    n = np.diff(np.searchsorted(begin, at))
    out = np.empty(len(words) + n_docs, np.uint64)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    return out, n + 1


def pair_names(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each token with the one before it, and the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(n) - n] = BEGIN
    return common.mix(before * np.uint64(3) + (tokens ^ (tokens >> np.uint64(21)))), before


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE count), 0 for no count."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def estimate(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE**level - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _bits(key: np.ndarray, level: np.ndarray | int, i: int, size: int) -> np.ndarray:
    salt = np.atleast_1d(np.asarray(level)).astype(np.uint64) + np.uint64(1)  # arrays wrap around without a warning
    x = common.mix(key + np.uint64(0x632BE59BD9B4E019) * salt)
    step = (x << np.uint64(32)) | (x >> np.uint64(32)) | np.uint64(1)
    return (((x + np.uint64(i) * step) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def fill_segment(key: np.ndarray, level: np.ndarray, size: int) -> bytes:
    """Bits of a segment that holds every (key, 1) to (key, level)."""
    out = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = key[level >= j]
        for i in range(HASHES):
            out[_bits(some, j, i, size)] = True
    return np.packbits(out, bitorder="little").tobytes()


class LogFilter:
    """Segments side by side; ``level`` probes until a level is missing."""

    def __init__(self, segments: dict[int, bytes], size: int) -> None:
        self.size, self.row = size, -(-size // 8)
        self.known = np.full(max(segments, default=-1) + 1, -1, np.int64)
        self.known[list(segments)] = np.arange(len(segments))
        self.bits = np.frombuffer(b"".join(segments.values()), np.uint8)

    def has(self, part: np.ndarray) -> np.ndarray:
        """Whether the segment of each part is at hand."""
        return np.append(self.known, -1)[np.minimum(part, len(self.known))] >= 0

    def level(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Level of each key; -1 where this filter doesn't have its segment."""
        row = np.full(len(key), -1, np.int64)
        near = part < len(self.known)
        row[near] = self.known[part[near]]
        out = np.where(row < 0, -1, 0)
        at, j = np.flatnonzero(row >= 0), 1
        while len(at):
            for i in range(HASHES):
                bit = _bits(key[at], j, i, self.size).astype(np.int64)
                at = at[(self.bits[row[at] * self.row + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            out[at] = j
            j += 1
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tokens of some documents at a time: first and last row, tokens, number of tokens of each."""
    data, at = common.utf8(batch.column("text"))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1))
        yield i, j, *word_names(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _summed(key: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return [key[begin], *(np.add.reduceat(c[order], begin) if len(begin) else c[:0] for c in counts)]


COUNTED = "part int, words boolean, n int, key binary, count binary, seen binary"


def _planes(x: np.ndarray, size: int = 8) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T[:size]).tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        got = np.frombuffer(data, np.uint8).reshape(-1, n).T
        out[:, : got.shape[1]] = got
    return out.reshape(-1).view("<u8")


def _counted(part: int, words: bool, key: np.ndarray, count: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    cells = [part, words, len(key), _planes(key, 8 if words else 5), _planes(count), _planes(seen)]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 3))], ["part", "words", "n", "key", "count", "seen"])


_LOW = np.uint64((1 << 40) - 1)


def _count(parts: int):
    """Counts of words (in training texts and in all) and of pairs (in training texts) of a task, by part."""

    def split(words: bool, key, count, seen) -> Iterator[pa.RecordBatch]:
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            if edge[p] < edge[p + 1]:
                own = order[edge[p] : edge[p + 1]]
                k = key[own]
                if not words:
                    k, c, s = _summed((k // np.uint64(parts)) & _LOW, count[own], seen[own])
                    yield _counted(p, words, k, c, s)
                else:
                    yield _counted(p, words, k, count[own], seen[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for words, rows in held.items():
                if rows:
                    yield from split(words, *_summed(*(np.concatenate(x) for x in zip(*rows))))
                rows.clear()
            size = 0

        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for i, j, tokens, n in _texts(batch):
                train = np.repeat(~out[i:j], n)
                words = _summed(tokens, train.astype(np.int64), np.ones(len(tokens), np.int64))
                pairs = pair_names(tokens, n)[0][train]
                pairs = _summed(pairs, np.ones(len(pairs), np.int64))
                held[True].append(words)
                held[False].append((*pairs, np.zeros(len(pairs[0]), np.int64)))
                size += len(words[0]) + len(pairs[0])
                if size >= HELD:
                    yield from flush()
        yield from flush()

    return run


def _add(table: pa.Table) -> pa.Table:
    out = []
    for words in (True, False):
        rows = [i for i, w in enumerate(table.column("words").to_pylist()) if w == words]
        cols = [[], [], []]
        for i in rows:
            n = table.column("n")[i].as_py()
            for c, name in zip(cols, ("key", "count", "seen")):
                c.append(_unplanes(table.column(name)[i].as_py(), n))
        if rows:
            out.append(_counted(table.column("part")[0].as_py(), words, *_summed(*map(np.concatenate, cols))))
    return pa.Table.from_batches(out)


def count_table(docs: DataFrame, parts: int) -> DataFrame:
    """Exact counts, one row of packed columns for each part and kind; written in the shared folder."""
    return common.written(docs.mapInArrow(_count(parts), COUNTED).repartitionById(parts, "part").groupBy("part").applyInArrow(_add, COUNTED))


def _sizes(counts: DataFrame) -> DataFrame:
    """For each part: entries of the filter, training tokens, distinct training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_unplanes(c.as_py(), n.as_py()).astype(np.int64) for c, n in zip(batch.column("count"), batch.column("n"))]
            more = [[int(levels(c).sum()) for c in got], [int(c.sum()) for c in got], [int((c > 0).sum()) for c in got]]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("words"), *(pa.array(m, pa.int64()) for m in more)], ["part", "words", "entries", "tokens", "types"])

    return counts.select("part", "words", "n", "count").mapInArrow(run, "part int, words boolean, entries long, tokens long, types long")


def _filter(counts: DataFrame, words: bool, size: int, only: list[int]) -> LogFilter:
    """The segments of some parts; their size is bounded before they come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fill_segment(_unplanes(k.as_py(), n.as_py()), levels(_unplanes(c.as_py(), n.as_py()).astype(np.int64)), size) for k, c, n in zip(batch.column("key"), batch.column("count"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, pa.binary())], ["part", "bits"])

    rows = counts.where((F.col("words") == words) & F.col("part").isin(only)).select("part", "n", "key", "count")
    return LogFilter({r.part: bytes(r.bits) for r in rows.mapInArrow(run, "part int, bits binary").collect()}, size)


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Names and training counts of words with at least ``least`` tokens: at most all tokens / ``least`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c, s, n in zip(*(batch.column(x) for x in ("key", "count", "seen", "n"))):
                k, c, s = (_unplanes(x.as_py(), n.as_py()) for x in (k, c, s))
                some = s >= least
                yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array(c[some].astype(np.int64))], ["key", "count"])

    got = counts.where("words").select("n", "key", "count", "seen").mapInArrow(run, "key long, count long").toArrow()
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], got.column("count").to_numpy()[order]


RARE = "part int, n int, docs binary, key binary, doc binary, times binary"


def _base(parts: int, frequent):
    """Of each document the sum over frequent words, as a row of part -1; its rare words by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value
        log = np.log10(counts + 0.1)
        for batch in batches:
            who = np.stack([batch.column("row_id").to_numpy(), batch.column("h").to_numpy()], 1).astype("<i8")
            held = []
            for i, j, tokens, n in _texts(batch):
                doc = np.repeat(np.arange(i, j), n)
                at = np.minimum(np.searchsorted(keys, tokens), max(len(keys) - 1, 0))
                near = keys[at] == tokens if len(keys) else np.zeros(len(tokens), bool)
                own = doc[near] - i
                sums = np.bincount(own, log[at[near]], minlength=j - i), np.bincount(own, counts[at[near]] > 0, minlength=j - i).astype("<i8")
                cells = [-1, j - i, who[i:j].tobytes(), n.astype("<i8").tobytes(), sums[0].astype("<f8").tobytes(), sums[1].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "n", "docs", "key", "doc", "times"])
                held.append((tokens[~near], doc[~near]))
            key, doc = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, int)
            times = np.diff(np.append(begin, len(key)))
            key, doc = key[begin], doc[begin]
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[edge[p] : edge[p + 1]]
                if len(own):
                    used, number = np.unique(doc[own], return_inverse=True)
                    cells = [p, len(own), who[used].tobytes(), _planes(key[own]), _planes(number, 4), _planes(times[own], 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "n", "docs", "key", "doc", "times"])

    return run


HOMEWARD = "home int, data binary"
PARTIAL = "row_id long, h long, n_tokens long, logs double, n_known long"
_PARTIAL = pa.schema([("row_id", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("logs", pa.float64()), ("n_known", pa.int64())])


def _homeward(parts: int, who: np.ndarray, n, logs, known) -> Iterator[pa.RecordBatch]:
    """Sums of documents on their way to the part of each document, packed: a row for each part, not for each document."""
    columns = [who[:, 0], who[:, 1], n.astype("<i8"), logs.astype("<f8").view("<i8"), known.astype("<i8")]
    home = who[:, 0] % parts
    for p in np.unique(home).tolist():
        some = home == p
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.stack([c[some] for c in columns]).tobytes()], pa.binary())], ["home", "data"])


def _whole_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, n, logs, known in zip(*(batch.column(c) for c in ("docs", "key", "doc", "times"))):
                yield from _homeward(parts, np.frombuffer(docs.as_py(), "<i8").reshape(-1, 2), np.frombuffer(n.as_py(), "<i8"), np.frombuffer(logs.as_py(), "<f8"), np.frombuffer(known.as_py(), "<i8"))

    return run


def _rare_rows(parts: int):
    def run(rare: pa.Table, words: pa.Table) -> pa.Table:
        n = words.column("n")[0].as_py() if words.num_rows else 0
        keys, counts = (_unplanes(words.column(c)[0].as_py(), n) if n else np.zeros(0, np.uint64) for c in ("key", "count"))
        found = []
        for r in range(rare.num_rows):
            m, docs, key, doc, times = (rare.column(c)[r].as_py() for c in ("n", "docs", "key", "doc", "times"))
            who = np.frombuffer(docs, "<i8").reshape(-1, 2)
            key, doc, times = _unplanes(key, m), _unplanes(doc, m).astype(np.int64), _unplanes(times, m).astype(np.int64)
            c = counts[np.searchsorted(keys, key)].astype(np.int64)  # every word of a text was counted
            found.append((who, np.bincount(doc, times * np.log10(c + 0.1), minlength=len(who)), np.bincount(doc, times * (c > 0), minlength=len(who))))
        if not found:
            return pa.table({"home": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        who, logs, known = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_batches(list(_homeward(parts, who, np.zeros(len(who)), logs, known)))

    return run


def _summed_up(table: pa.Table) -> pa.Table:
    """One row for each document of a part."""
    rows = np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(5, -1) for x in table.column("data")], axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    begin = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    add = lambda x: np.add.reduceat(x, begin)
    cells = [rows[0][begin], rows[1][begin], add(rows[2]), add(np.ascontiguousarray(rows[3]).view("<f8")), add(rows[4])]
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cells], schema=_PARTIAL)


def _begin(single: LogFilter, parts: int) -> int:
    """Level of the mark before every text; -1 if its segment is not at hand."""
    return int(single.level(np.array([BEGIN]), np.array([int(BEGIN % np.uint64(parts))]))[0])


def _levels(parts: int, words):
    """Of each text the levels of the tokens whose segment is at hand, a byte each, in the order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = words.value
        for batch in batches:
            out = []
            for i, j, tokens, n in _texts(batch):
                known, back = np.unique(tokens, return_inverse=True)
                level = single.level(known, (known % np.uint64(parts)).astype(np.int64))[back]
                here = level >= 0
                edge = np.cumsum(np.bincount(np.repeat(np.arange(j - i), n)[here], minlength=j - i))[:-1]
                out += [x.tobytes() for x in np.split(level[here].astype(np.uint8), edge)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("h"), pa.array(out, pa.binary())], ["row_id", "h", "levels"])

    return run


def _with_levels(texts: DataFrame, counts: DataFrame, parts: int, size: int, per_pass: int) -> tuple[DataFrame, int]:
    """Texts with the levels of their words from passes over ranges of segments (all of the first pass, then of the second, and
    so on), and the level of the mark before a text. All passes together write a byte a token."""
    sc, begin, found = texts.sparkSession.sparkContext, -1, None
    for turn, i in enumerate(range(0, parts, per_pass)):
        single = _filter(counts, True, size, list(range(i, min(parts, i + per_pass))))
        begin = max(begin, _begin(single, parts))
        words = sc.broadcast(single)
        part = common.written(texts.mapInArrow(_levels(parts, words), "row_id long, h long, levels binary")).withColumn("turn", F.lit(turn))
        found = part if found is None else found.union(part)
        words.destroy()
    # rows that are equal in id and text give equal bytes: a set keeps one
    rows = found.groupBy("row_id", "h").agg(F.sort_array(F.collect_set(F.struct("turn", "levels"))).alias("found"))
    whole = F.aggregate("found", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["levels"]))
    return common.written(texts.join(rows.select("row_id", "h", whole.alias("levels")), ["row_id", "h"])), begin


def _model(parts: int, words, per_pass: int, begin: int, pairs, n_train: int, n_types: int):
    """Sums of log10 p over the tokens whose pair is in one of the segments at hand; levels of words from their filter, or, if
    they took several passes, from the column ``levels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = words.value if words else None, pairs.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, tokens, n in _texts(batch):
                doc = np.repeat(np.arange(j - i), n)
                pair = pair_names(tokens, n)[0]
                part = (pair % np.uint64(parts)).astype(np.int64)
                here = np.flatnonzero(double.has(part))
                # a pass looks up its own pairs and their words only
                some, of = np.unique(pair[here], return_inverse=True)
                c_pair = estimate(double.level((some // np.uint64(parts)) & _LOW, (some % np.uint64(parts)).astype(np.int64)))[of]
                if single is not None:
                    need = np.zeros(len(tokens) + 1, bool)
                    need[here + 1] = need[here] = True
                    need = np.flatnonzero(need[1:])
                    known, back = np.unique(tokens[need], return_inverse=True)
                    c = np.zeros(len(tokens))
                    c[need] = estimate(single.level(known, (known % np.uint64(parts)).astype(np.int64)))[back]
                else:
                    turn = (tokens % np.uint64(parts)).astype(np.int64) // per_pass
                    c = np.empty(len(tokens))
                    data, _ = common.utf8(batch.column("levels").slice(i, j - i))
                    c[np.lexsort((turn, doc))] = estimate(data.astype(np.int64))
                c_before = np.empty_like(c)
                c_before[1:] = c[:-1]
                c_before[np.cumsum(n) - n] = estimate(np.array([begin]))[0]
                c, c_before = c[here], c_before[here]
                p = (c + 0.1) / (n_train + 0.1 * (n_types + 1))
                p = (np.minimum(c_pair, c_before) + MU * p) / (c_before + MU)
                score[i:j] += np.bincount(doc[here], np.log10(p), minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("h"), pa.array(score)], ["row_id", "h", "score"])

    return run


def _count_begin(counts: DataFrame, parts: int, n_docs: int) -> DataFrame:
    """The mark before every text, counted as a word that stands for the training texts themselves."""
    spark, p = counts.sparkSession, int(BEGIN % np.uint64(parts))
    row = [(p, True, 1, bytearray(_planes(np.array([BEGIN]))), bytearray(_planes(np.array([n_docs]))), bytearray(_planes(np.array([0]))))]
    return counts.where("words").union(spark.createDataFrame(row, COUNTED)).groupBy("part").applyInArrow(_add, COUNTED)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every text.

    The model learns from documents whose crc32(doc_id) is not divisible by 10 and scores all. A null text is empty (one
    end token), a null doc_id counts as the id ''. Rows that are equal in id and text all count in training and get one
    row. An empty table gives no rows. Exact counts of the at most 1 / SHARE frequent words are broadcast for the base
    score; rare words travel to their counts, a document and word once for each batch."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(id_text).alias("row_id"), F.xxhash64(text).alias("h"), (F.crc32(id_text) % 10 == 0).alias("held_out"))
    n_docs, size = rows.agg(F.count_if(~F.col("held_out")), F.sum(F.octet_length("text"))).first()
    parts = max(common.n_parts(spark), -(-(size or 0) // PART))  # so no segment nears the bound of the filter
    counts = count_table(rows.select("text", "held_out"), parts)
    sizes = _sizes(counts).collect()  # two rows for each part
    n_train, n_types = (sum(r[x] for r in sizes if r.words) for x in ("tokens", "types"))
    limit = int(MAX_MB * (1 << 23))
    spread = lambda words: min(limit, max([64, *(int(r.entries * ENTRY_BITS) + 1 for r in sizes if r.words == words)]))
    word_size, size = spread(True), spread(False)
    words_per_pass, per_pass = max(1, limit // word_size), max(1, limit // size)

    sc = spark.sparkContext
    frequent = sc.broadcast(_frequent(counts, max(1.0, SHARE * n_train)))
    rare = rows.select("row_id", "h", "text").mapInArrow(_base(parts, frequent), RARE)
    rare = common.written(rare)
    base = rare.where("part < 0").select("docs", "key", "doc", "times").mapInArrow(_whole_rows(parts), HOMEWARD)
    far = rare.where("part >= 0").groupBy("part").cogroup(counts.where("words").groupBy("part")).applyInArrow(_rare_rows(parts), HOMEWARD)
    sums = base.union(far).groupBy("home").applyInArrow(_summed_up, PARTIAL)

    texts, with_begin, words, scores = rows.select("row_id", "h", "text"), _count_begin(counts, parts, n_docs), None, None
    if words_per_pass >= parts:
        single = _filter(with_begin, True, word_size, list(range(parts)))
        words, begin = sc.broadcast(single), _begin(single, parts)
    else:
        texts, begin = _with_levels(texts, common.written(with_begin), parts, word_size, words_per_pass)
    for i in range(0, parts, per_pass):
        pairs = sc.broadcast(_filter(counts, False, size, list(range(i, min(parts, i + per_pass)))))
        part = texts.mapInArrow(_model(parts, words, words_per_pass, begin, pairs, n_train, n_types), "row_id long, h long, score double")
        part = common.written(part)
        scores = part if scores is None else scores.union(part)
        pairs.destroy()
    ids = rows.groupBy("row_id", "h").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.count("*").alias("copies"))
    scores = scores.groupBy("row_id", "h").agg(F.sum("score").alias("score"))
    out = ids.join(sums, ["row_id", "h"]).join(scores, ["row_id", "h"])
    whole = float(np.log10(n_train + 0.1 * (n_types + 1)))
    n = (F.col("n_tokens") / F.col("copies")).cast("long")
    return out.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("copies") - n * whole).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )
