"""Token files: ids of a fixed bit width in blocks, with offsets for random access.

A file row is one block: a header, the offsets of its documents in ids, then all ids of the block side by side in
``bits`` bits each, lowest bit first. Id ``i`` begins at bit ``i * bits``, so any document is a slice of the payload and
numpy unpacks it without a loop. Blocks are rows of a Parquet table, written by Spark's committer: a lost task leaves
nothing behind and any store that Spark reads will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"TLT1"
_HEAD = "<4sBxxxIQ"  # magic, bits, documents, ids
BLOCK_SCHEMA = "part int, block int, ids_before long, n_docs long, n_ids long, doc_ids array<long>, data binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop``; only the bytes that hold them are touched."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    lo, hi = start * bits // 8, (stop * bits + 7) // 8
    raw = np.frombuffer(data, np.uint8, hi - lo, lo)
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - lo * 8 :][: (stop - start) * bits]
    return flat.reshape(-1, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def make_block(docs: list[np.ndarray], bits: int) -> bytes:
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    return struct.pack(_HEAD, MAGIC, bits, len(docs), len(ids)) + at.tobytes() + pack_bits(ids, bits)


def block_offsets(data: bytes) -> tuple[int, np.ndarray, memoryview]:
    """Bit width, where each document begins (and the last ends), and the payload."""
    magic, bits, n, _ = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = np.frombuffer(data, "<u8", n + 1, struct.calcsize(_HEAD)).astype(np.int64)
    return bits, at, memoryview(data)[struct.calcsize(_HEAD) + 8 * (n + 1) :]


def read_document(data: bytes, i: int) -> np.ndarray:
    bits, at, payload = block_offsets(data)
    return unpack_bits(payload, bits, int(at[i]), int(at[i + 1]))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 18) -> None:
    """Ids of every text (null: empty), the end id after each, in ascending ``doc_id`` order (null first, equal ids by text).

    Documents are cut into ranges of ``doc_id``; each task encodes its range in order. Other columns are not used.
    An empty table gives an empty file."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = common.cut_points(rows, key, common.n_parts(spark))
    ordered = common.in_ranges(rows, key, cuts, [F.col("doc_id").asc_nulls_first(), "text"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = max(enc.bits, int(end_id).bit_length())
        end = np.array([end_id], np.uint32)
        part, block, before, ids, held, size = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, ids, held, size
            cells = [[part], [block], [before], [len(held)], [size], [ids], [make_block(held, bits)]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names)
            block, before, ids, held, size = block + 1, before + size, [], [], 0
            return out

        for batch in batches:
            parts = batch.column("part").to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            for p, d, raw in zip(parts, doc_ids, _encoded(enc, batch.column("text"))):
                if part != p:
                    if held:
                        yield flush()
                    part, block, before = p, 0, 0
                held.append(np.concatenate([np.frombuffer(raw, enc.kind).astype(np.uint32), end]))
                ids.append(d)
                size += len(held[-1])
                if size >= block_ids:
                    yield flush()
        if held:
            yield flush()

    names = ["part", "block", "ids_before", "n_docs", "n_ids", "doc_ids", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    ordered.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _encoded(enc, column: pa.Array, step: int = 512) -> Iterator[bytes]:
    for i in range(0, len(column), step):
        yield from enc.encode(column.slice(i, step).to_pylist())


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Back from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit). One total for each range goes through the driver; nothing is sorted again."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    base = common.before_part(blocks.groupBy("part").agg(F.sum("n_ids")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, before, ids, data = (batch.column(c)[r].as_py() for c in ("part", "ids_before", "doc_ids", "data"))
                bits, at, payload = block_offsets(data)
                flat = unpack_bits(payload, bits, 0, int(at[-1])).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(at[:-1] + (base[part] + before)), pa.array(np.diff(at)), pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(flat)])],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.select("part", "ids_before", "doc_ids", "data").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
