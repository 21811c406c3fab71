"""Exact top-k search by inner product: tiled matrix products, selection in each tile, merging up a tree."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a query block and of a shard: a task holds one block and one shard, whatever the size of the tables.
BLOCK, SHARD, FAN = 16_384, 8_192, 16
#: Scores beyond this, about the range of a long, are held at it.
FAR = (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def tile_lists(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = 1024) -> Iterator[tuple[int, list[int], list[int]]]:
    """Each query's k best of one shard. Products of whole numbers are exact: doubles hold them below 2^53, beyond that
    Python integers do (much slower, for huge components only)."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    exact = q.size == 0 or c.size == 0 or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) < 2**53
    if not exact:
        q, c = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    for i in range(0, len(q), step):
        scores = q[i : i + step] @ c.T
        for r, qid in enumerate(q_ids[i : i + step]):
            own = slice(*np.searchsorted(c_ids, [qid, qid + 1]))
            row = scores[r]
            if own.stop > own.start:
                others = np.r_[0 : own.start, own.stop : len(c_ids)]
                row, ids = row[others], c_ids[others]
            else:
                ids = c_ids
            if len(ids) == 0:
                continue
            if exact and len(ids) > 4 * k:
                cut = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= cut)
                at = at[np.argsort(-row[at], kind="stable")[:k]]
            else:
                row = [max(-FAR, min(FAR, int(x))) for x in row]
                at = np.array(sorted(range(len(ids)), key=lambda j: (-row[j], j))[:k])
            yield int(qid), ids[at].tolist(), [int(row[j]) for j in at]


def top_k(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id and ``score`` of the k rows with the highest inner product, own id left out.

    Components become floor(scale * x). Rows without an id or with a null vector or component, a NaN or an infinity take
    no part; vectors of different length have no product and are not compared. Scores beyond the range of a long are held at its
    ends. Ties go to the smaller id. An id that has
    several rows counts with each of them; a query with fewer than k others gets fewer ranks, and an empty table none.

    Every query meets every row, by tiles: queries are cut into blocks, rows into shards, and each (block, shard) is one
    matrix product with a selection right behind it, so only k rows per query leave a tile. Lists are merged FAN at a time.
    """
    use = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    pick = [F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.size(vector_col).alias("dim"), F.xxhash64(F.col(id_col)).alias("h")]
    q, c = queries.where(use).select(*pick), rows.where(use).select(*pick)
    n_q, n_c = q.count(), c.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, ceil(n_q / BLOCK))
    shards = max(1, ceil(n_c / SHARD), min(2 * parts, n_c // 256))
    block, shard = F.pmod("h", F.lit(blocks)).cast("int"), F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int")
    left = q.select("id", "v", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = c.select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard.alias("shard"))

    def tile(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ids, places = np.asarray(b.column("id")), a.num_rows and b.num_rows
        out = list(tile_lists(np.asarray(a.column("id")), _matrix(a.column("v")), ids, _matrix(b.column("v")), k)) if places else []
        cells = [[x[0] for x in out], [key[1].as_py() for _ in out], [[{"score": -s, "id": i} for i, s in zip(x[1], x[2])] for x in out]]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds)], ["query_id", "shard", "best"])

    lists = left.groupBy("block", "shard", "dim").cogroup(right.groupBy("block", "shard", "dim")).applyInArrow(tile, "query_id long, shard int, best array<struct<score: long, id: long>>")
    while shards > 1:  # score is kept negated, so the natural order of the structs is the order of rank
        lists = lists.groupBy("query_id", F.expr(f"shard div {FAN}").cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        shards = ceil(shards / FAN)
    return lists.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")).select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.score")).alias("score"))
