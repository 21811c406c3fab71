"""Phrases whose words belong together, counted by direct-address tiles of frequency ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens that share one dictionary; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Partitions of packed rows for each one that the session asks for: a task holds whole batches of them outside the JVM's heap.
FINER = 4
#: Ranks of the first band; every further band is as wide as all before it.
RANKS = 1 << 10
#: A tile of at most so many cells is a dense array, a larger one a sorted list of cells.
DENSE = 1 << 22
#: Entries that wait before a list is sorted and summed.
WAITING = 1 << 21
#: A-Z in lower case; ends of pieces become full stops, which no word holds.
_FOLD = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """Texts of one language in chunks: ``chunk``, ``lang``, the distinct ``words`` with their ``counts``, ``n`` and ``stream``, the
    places of its words in that list (32 bits each, -1 behind each piece). Written once, so that the numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[_Ids, list[np.ndarray], list[int]]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            ids, parts, _ = held.pop(lang)
            stream = np.concatenate(parts)
            words = [w.decode() for w in ids if w != b"."]
            counts = np.bincount(stream[stream >= 0], minlength=len(words))
            row = [[top + made], [lang], [words], [counts], [int(counts.sum())], [stream.tobytes()]]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        names = ["chunk", "lang", "words", "counts", "n", "stream"]
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                tokens = text.as_py().translate(_FOLD).replace(b".", b" . ").split()
                ids, parts, size = held.setdefault(lang, (_Ids({b".": -1}), [], [0]))
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.full(1, -1, np.int32))
                size[0] += len(tokens) + 1
                if size[0] >= CHUNK:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return common.written(rows.mapInArrow(run, "chunk long, lang string, words array<string>, counts array<long>, n long, stream binary"))


def ranked(table: DataFrame, *ties: str) -> DataFrame:
    """The written table with ``id``, 0 and up by falling ``a``. Ranges of the count, parted further by a hash, are numbered each by
    itself behind those before them; one number for each range passes the driver."""
    most = 1 << 42
    key = (most - F.least("a", F.lit(most - 1))) * (1 << 20) + F.xxhash64(*ties).bitwiseAND((1 << 20) - 1)
    spark, keyed = table.sparkSession, table.withColumn("_key", key)
    cuts = common.cut_points(keyed, F.col("_key"), common.n_parts(spark))
    parted = keyed.withColumn("_part", common.part_of(F.col("_key"), cuts))
    before = common.before_part(parted.groupBy("_part").agg(F.count("*")))
    if not before:
        return table.withColumn("id", F.lit(0).cast("long"))
    offsets = spark.createDataFrame(list(before.items()), "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key", *ties)) - 1
    out = parted.withColumn("id", place).join(F.broadcast(offsets), "_part").withColumn("id", F.col("id") + F.col("_before"))
    return common.written(out.select(*table.columns, "id"))


def band(rank: np.ndarray) -> np.ndarray:
    return np.frexp((rank // RANKS).astype(np.float64))[1].astype(np.int64)


def band_edge(b):
    """First rank and width of bands."""
    wide = RANKS << np.maximum(b - 1, 0)
    return np.where(b == 0, 0, wide), wide


def tile_of(u: np.ndarray, v: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile of each pair of ranks (bands of both, then the slot of the first) and its cell there."""
    if len(u) and (int(u.max()) // slots + 1) * 2 * (int(v.max()) + 1) >= 1 << 62:
        raise OverflowError("ranks too large for cells of 64 bits: set more shuffle partitions")
    bu, bv = band(u), band(v)
    (lo_u, _), (lo_v, wide) = band_edge(bu), band_edge(bv)
    row = u - lo_u
    return ((bu << 6 | bv) << 24) + row % slots, row // slots * wide + v - lo_v


def tile_pairs(tile: int, cell: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks back from the cells of a tile."""
    bands, slot = tile >> 24, tile & (1 << 24) - 1
    (lo_u, _), (lo_v, wide) = band_edge(np.int64(bands >> 6)), band_edge(np.int64(bands & 63))
    return cell // wide * slots + slot + lo_u, cell % wide + lo_v


def tile_cells(tile: int, slots: int) -> int:
    bands = tile >> 24
    (_, tall), (_, wide) = band_edge(np.int64(bands >> 6)), band_edge(np.int64(bands & 63))
    return int(-(-tall // slots) * wide)


def tally(u: np.ndarray, v: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (ranks u, v), their counts, and the number of each given pair among them. The tile of the first ranks is
    counted by direct address; the other pairs, named by ``local``, are sorted."""
    dense = (u < RANKS) & (v < RANKS)
    cell = u[dense] * RANKS + v[dense]
    table = np.bincount(cell, minlength=RANKS * RANKS)
    cells = np.flatnonzero(table)
    place = np.zeros(RANKS * RANKS, np.int32)
    place[cells] = np.arange(len(cells))
    _, first, turn, many = np.unique(local[~dense], return_index=True, return_inverse=True, return_counts=True)
    number = np.empty(len(u), np.int32)
    number[dense], number[~dense] = place[cell], len(cells) + turn
    return np.r_[cells // RANKS, u[~dense][first]], np.r_[cells % RANKS, v[~dense][first]], np.r_[table[cells], many], number


def count_chunks(rows: DataFrame, slots: int, last: bool) -> DataFrame:
    """Counts of neighbouring names in each chunk, one row for each tile that has any: ``tile``, ``chunk``, ``cells`` (differences
    of the rising cells), ``counts`` and ``at`` (number in the chunk of the first of these pairs; the others follow). Unless this is the ``last`` level, a row of
    tile -1 holds the chunk's ``stream`` of pair numbers. ``rows`` hold a stream, or numbers ``at`` of it and their names ``id``."""
    ordered = rows.repartition(FINER * common.n_parts(rows.sparkSession), "chunk").sortWithinPartitions("chunk", F.col("stream").isNull())
    names = ["tile", "chunk", "cells", "counts", "at", "stream"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def counted(chunk: int, stream: np.ndarray, at: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        size = int(stream.max(initial=-1)) + 1
        name = np.full(size + 1, -1, np.int64)  # the last one is for -1
        name[np.concatenate(at)] = np.concatenate(ids)
        full = name[stream]
        where = np.flatnonzero((full[:-1] >= 0) & (full[1:] >= 0))
        u, v, many, number = tally(full[where], full[where + 1], stream[where].astype(np.int64) * size + stream[where + 1])
        tile, cell = tile_of(u, v, slots)
        order = np.lexsort((cell, tile))
        tile, cell, many = tile[order], cell[order], many[order]
        edges = [*np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]).tolist(), len(tile)] if len(tile) else []
        out = []
        for s, e in zip(edges, edges[1:]):
            out.append((int(tile[s]), chunk, np.diff(cell[s:e], prepend=0).tobytes(), many[s:e].astype(np.int32).tobytes(), s, None))
        if not last and len(tile):
            turned = np.empty(len(order), np.int32)
            turned[order] = np.arange(len(order), dtype=np.int32)
            new = np.full(len(stream), -1, np.int32)
            new[where] = turned[number]
            out.append((-1, chunk, None, None, None, new.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, at, ids = None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column("chunk")[i].as_py()
                if chunk != now:
                    if at:
                        yield counted(now, stream, at, ids)
                    now, stream, at, ids = chunk, np.frombuffer(batch.column("stream")[i].as_py(), np.int32), [], []
                else:
                    at.append(batch.column("at")[i].values.to_numpy(zero_copy_only=False))
                    ids.append(batch.column("id")[i].values.to_numpy(zero_copy_only=False))
        if at:
            yield counted(now, stream, at, ids)

    return common.written(ordered.mapInArrow(run, "tile long, chunk long, cells binary, counts binary, at long, stream binary"))


def frequent_pairs(counted: DataFrame, slots: int, least: int) -> DataFrame:
    """``tile``, ``cell``, ranks ``u`` and ``v`` and count ``a`` of the pairs that all chunks together have ``least`` times or more.

    Rows of a tile pass one after another through one array of its cells or, in a tile of many cells, through a sorted list."""
    tiles = counted.where("tile >= 0").select("tile", "cells", "counts")
    ordered = tiles.repartition(FINER * common.n_parts(counted.sparkSession), "tile").sortWithinPartitions("tile")
    names = ["tile", "cell", "u", "v", "a"]

    def summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cell, count = np.concatenate(cells), np.concatenate(counts)
        order = np.argsort(cell, kind="stable")
        cell, count = cell[order], count[order]
        begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        return cell[begins], np.add.reduceat(count, begins)

    def found(tile: int, table: np.ndarray | None, cells: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        if table is not None:
            cell = np.flatnonzero(table >= least)
            count = table[cell]
        else:
            cell, count = summed(cells, counts)
            cell, count = cell[count >= least], count[count >= least]
        u, v = tile_pairs(tile, cell, slots)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), tile)), *map(pa.array, (cell, u, v, count))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, cells, counts, waiting = None, None, [], [], 0
        for batch in batches:
            for tile, raw, many in zip(batch.column("tile").to_pylist(), batch.column("cells"), batch.column("counts")):
                if tile != now:
                    if now is not None:
                        yield found(now, table, cells, counts)
                    now, cells, counts, waiting = tile, [], [], 0
                    size = tile_cells(tile, slots)
                    table = np.zeros(size, np.int64) if size <= DENSE else None
                cell, count = np.cumsum(np.frombuffer(raw.as_py(), np.int64)), np.frombuffer(many.as_py(), np.int32).astype(np.int64)
                if table is not None:
                    table[cell] += count  # a row holds a cell once
                    continue
                cells.append(cell)
                counts.append(count)
                waiting += len(cell)
                if waiting > max(WAITING, 2 * len(cells[0])):
                    one, many_ = summed(cells, counts)
                    cells, counts, waiting = [one], [many_], len(one)
        if now is not None:
            yield found(now, table, cells, counts)

    return common.written(ordered.mapInArrow(run, "tile long, cell long, u long, v long, a long"))


def renamed(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The chunks with frequent pairs for words: rows (``chunk``, ``stream``), and rows (``chunk``, ``at``, ``id``) that name the pairs of
    a chunk. In a tile the frequent pairs come first and the chunks pass behind them, so neither side is copied."""
    known = pairs.selectExpr("tile", "-1L AS chunk", "cell", "id", "CAST(NULL AS BINARY) AS cells", "CAST(NULL AS BIGINT) AS at")
    asked = counted.where("tile >= 0").selectExpr("tile", "chunk", "CAST(NULL AS BIGINT) AS cell", "CAST(NULL AS BIGINT) AS id", "cells", "at")
    both = known.unionByName(asked).repartition(FINER * common.n_parts(counted.sparkSession), "tile").sortWithinPartitions("tile", "chunk", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, ids = None, [], []
        for batch in batches:
            tile, chunk = (batch.column(c).to_numpy() for c in ("tile", "chunk"))
            cell, name, at = (batch.column(c).fill_null(-1).to_numpy() for c in ("cell", "id", "at"))
            turns = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | ((chunk[1:] < 0) != (chunk[:-1] < 0))])
            out: list[list] = [[], [], []]
            for s, e in zip(turns.tolist(), [*turns[1:].tolist(), len(tile)] if len(tile) else []):
                if tile[s] != now:
                    now, cells, ids = tile[s], [], []
                if chunk[s] < 0:
                    cells.append(cell[s:e])
                    ids.append(name[s:e])
                    continue
                if not cells:
                    continue
                all_cells, all_ids = np.concatenate(cells), np.concatenate(ids)
                cells, ids = [all_cells], [all_ids]
                for i in range(s, e):
                    own = np.cumsum(np.frombuffer(batch.column("cells")[i].as_py(), np.int64))
                    place = np.minimum(np.searchsorted(all_cells, own), len(all_cells) - 1)
                    hit = all_cells[place] == own
                    if hit.any():
                        out[0].append(int(chunk[i]))
                        out[1].append((at[i] + np.flatnonzero(hit)).astype(np.int32))
                        out[2].append(all_ids[place[hit]])
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["chunk", "at", "id"])

    names = both.mapInArrow(run, "chunk long, at array<int>, id array<long>")
    streams = counted.where("tile < 0").selectExpr("chunk", "stream", "CAST(NULL AS ARRAY<INT>) AS at", "CAST(NULL AS ARRAY<BIGINT>) AS id")
    return streams.unionByName(names.withColumn("stream", F.lit(None).cast("binary")))


def whole_quotient(a: Column, divisor: Column, factor: int) -> Column:
    """floor(factor * a / divisor) of longs; the product may have more than 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)"), divisor.cast("decimal(20,0)"))


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, keep: int | None = 2000, share: int = 80, factor: int = 2_000_000) -> DataFrame:
    """The ``keep`` best phrases of each language (all, if null): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``cut``.

    Words are parted by space and tab, pieces by ``.,;:!?`` and line ends; A-Z is lower-cased. A phrase is 2 to ``longest`` words
    of one piece that occur ``least`` times or more in its language. Its score is the lowest over its cuts of
    floor(factor * a / (l + r)), with the counts l and r of both parts. A phrase goes if one that holds its words and more has
    ``share`` percent of its count. Ties: score and count falling, then the phrase by its bytes.

    Words get ranks by falling frequency. Ranks fall into bands and pairs of bands into tiles, so that a tile of frequent words is
    a dense array that is addressed directly, and one of rare words a sorted list of cells. The frequent pairs of a tile are
    ranked in turn and stand for words on the next level, where two neighbours that overlap make a phrase one word longer.
    Only packed counts of chunks move, each distinct pair once a chunk; chunks meet the frequent pairs of a tile in a merge.

    Null texts are empty, a null language is ``und``; repeated rows count each. An empty table gives no rows, and other columns
    are left out. A language of any share is spread by its chunks, a frequent pair is one cell of each chunk."""
    spark = docs.sparkSession
    slots = max(1, common.n_parts(spark) // 8)
    texts = chunks(docs)
    each = texts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = ranked(common.written(each.groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least)), "lang", "word")
    sizes = texts.groupBy("lang").agg(F.sum("n").alias("n"))
    placed = texts.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    named = placed.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("x")).select("chunk", F.lit(None).cast("binary").alias("stream"), "x.at", "x.id")
    rows = texts.selectExpr("chunk", "stream", "CAST(NULL AS ARRAY<INT>) AS at", "CAST(NULL AS ARRAY<BIGINT>) AS id").unionByName(named)
    one = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tip"), F.array("a").alias("heads"), F.array("a").alias("tails"), "a")
    made = []
    for size in range(2, longest + 1):
        counted = count_chunks(rows, slots, last=size == longest)
        pairs = ranked(frequent_pairs(counted, slots, least), "u", "v")
        x, y = (one.select(F.col("id").alias(k), "lang", *(F.col(c).alias(f"{k}_{c}") for c in ("phrase", "tip", "heads", "tails"))) for k in "uv")
        both = pairs.select("id", "u", "v", "a").join(x, "u").join(y.drop("lang"), "v")
        longer = both.select(
            "id", "lang", F.concat("u_phrase", F.lit(" "), "v_tip").alias("phrase"), F.col("v_tip").alias("tip"),
            F.array_append("u_heads", F.col("a")).alias("heads"), F.array_append("v_tails", F.col("a")).alias("tails"), "a",
        )
        one = common.written(longer)
        made.append((size, one, pairs))
        if size < longest:
            rows = renamed(counted, pairs)
    kept = []
    for k, (size, table, _) in enumerate(made):
        if k + 1 < len(made):
            holds = made[k + 1][2]
            above = holds.select(F.col("u").alias("id"), "a").union(holds.select(F.col("v").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("above"))
            table = table.join(above, "id", "left").where(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * share))
        cuts = []
        for c in range(1, size):
            left, right = F.element_at("heads", c), F.element_at("tails", size - c)
            cuts.append(F.struct(whole_quotient(F.col("a"), left + right, factor).alias("score"), F.lit(c).cast("long").alias("cut"), left.alias("l"), right.alias("r")))
        kept.append(table.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("x")))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = out.select("lang", "phrase", "a", "x.*").withColumn("rank", F.row_number().over(order))
    out = out if keep is None else out.where(F.col("rank") <= keep)
    return out.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
