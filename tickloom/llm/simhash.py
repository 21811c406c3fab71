"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

from . import common
from .components import components

BITS = 64
STEP = 1 << 18


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit words have each bit, lowest first: byte histograms times the bits of each byte value."""
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    values = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ values).ravel()


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` words have."""
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprint(text: str | None, shingle: int) -> int:
    """Bits that over half the hashes of the word shingles have. A-Z is lower-cased; without words it is zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hash64, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, STEP):
        part = words[i : min(i + STEP, n) + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        total += bit_counts(np.array([hash64(b" ".join(x), 42) for x in runs], np.uint64))
    return majority(total, n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 bit masks; any ``radius`` positions are outside at least one of them (R. Pagh, 2016).

    Each position has a non-zero vector of radius + 1 bits, and each non-zero vector v a mask: the positions whose vector
    has an odd product with v. Vectors of ``radius`` positions leave a direction free, so some v has even products with
    all of them, and two fingerprints that differ only there agree on the mask of v. The vectors are dealt so that all masks
    have about half of the bits: all in turn, or for seven bits a one and the position (a first-order Reed-Muller code)."""
    full = (1 << radius + 1) - 1
    vectors = [64 + i if radius == 6 else 1 + i % full for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, full + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints of column ``fp``, enough to connect all within the radius (1 or 2).

    A fingerprint that is alone in its bucket in every covering table has no neighbour. The others emit themselves and
    their 64 one-bit changes: two fingerprints share such a value exactly if they differ in two bits or fewer, so each
    value ties its at most 65 owners to the least of them. Whatever the size of a bucket, a row makes at most 65 rows
    and no two rows of a bucket are paired. For radius 1 only the pairs of those that differ in one bit are kept.

    For a radius of 3 to 6 see :func:`_by_leaders`."""
    if not 1 <= radius <= 6:
        raise ValueError("radius 1 to 6")
    masks = [_signed(m) for m in covering_masks(radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    if radius > 2:
        return _by_leaders(rows, radius)
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select("t", "k")
    near = rows.join(shared, ["t", "k"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    owned = near.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    if radius == 1:
        pairs = owned.where("fp <> value").join(fps.select(F.col("fp").alias("value")), "value", "left_semi")
        return pairs.select(F.col("fp").alias("a"), F.col("value").alias("b"))
    owners = owned.groupBy("value").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1).select(F.array_min("s").alias("b"), "s")
    return owners.select(F.explode("s").alias("a"), "b").where("a <> b").distinct()


def _by_leaders(rows: DataFrame, radius: int) -> DataFrame:
    """In each bucket all within the radius of its least fingerprint are linked to that one; the rest of the bucket goes on
    without them, until nothing is left. Rows only ever meet their leader, so a bucket costs its size for each round, and
    rounds end early since most buckets hold relatives of one text. Every pair within the radius shares a bucket, and the
    smaller one leads unless it has been linked to a still smaller one there; a pair is lost only if all buckets of both
    keep them apart in that way (a twentieth of the copies in stars of twenty whose every copy is up to six bits off), which
    the exact method for a radius of 2 rules out."""
    out, rest = None, rows
    while True:
        led = rest.groupBy("t", "k").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead"))) <= radius
        met = cut_lineage(rest.join(led, ["t", "k"]).where("fp <> lead").select("fp", "lead", "t", "k", near.alias("near")))
        found = met.where("near").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
        out, rest = found if out is None else out.union(found), met.where("not near").select("fp", "t", "k")
        if rest.isEmpty():
            return out.distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (least doc_id that links lead to, itself included).

    One row for each row of the table, repeated rows too. A null text is empty; all texts without a word have fingerprint
    zero and are linked. A null doc_id is a row like any other but never the name of a component unless it has no other.
    Equal fingerprints are one node of the graph, so copies cost nothing beyond their own row. An empty table gives none."""
    rows = common.written(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), radius), "a", "b")
    named = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
