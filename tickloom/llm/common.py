"""Shared folder, range partitions with running totals, and text as bytes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; all that separates words in this package.
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session may lack that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and no lost executor can undo it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession) -> int:
    """Number of partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, key: Column, parts: int) -> np.ndarray:
    """At most ``parts - 1`` values of a long key that cut the rows into ranges of like size."""
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, at, 10_000)).first()[0] if at else None
    return np.unique(np.array(found or [], dtype=np.int64))


def part_of(key: Column, cuts: np.ndarray) -> Column:
    """Number of the range that holds a long key."""

    @F.pandas_udf("int")
    def search(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right").astype(np.int32))

    return search(key)


def in_ranges(df: DataFrame, key: Column, cuts: np.ndarray, order: list) -> DataFrame:
    """Rows dealt out by range of the key, each range in order; adds the column ``part``."""
    return df.withColumn("part", part_of(key, cuts)).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", *order)


def before_part(totals: DataFrame) -> dict[int, int]:
    """Sum of all lower ranges, from one (part, total) row for each range."""
    out, run = {}, 0
    for part, total in sorted((r[0], r[1] or 0) for r in totals.collect()):
        out[part] = run
        run += total
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column one after another, and where each begins; a null is empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
