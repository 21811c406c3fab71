"""Parquet tables written in committed batches: appends without stored keys, and newer versions of rows.

A batch is a folder ``batch=<name>`` with rows by ``part``, a text that follows from the key (a month, say). It counts once
Spark has put its success mark there, which is the last step of a write: readers never see half a batch, a batch of the same
name is written once however often a job is tried again, and what a failed try left is overwritten. Stored keys are looked up
in the parts of the batch at hand only, so the cost of an append does not grow with the table's history. One writer at a time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART, BATCH, _MARK = "part", "batch", "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed batches in order (as texts)."""
    p, fs = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n.removeprefix(f"{BATCH}=") for n in names if n.startswith(f"{BATCH}=") and fs.exists(_folder(spark, f"{path}/{n}/{_MARK}")[0]))


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all committed batches with ``part`` and ``batch``; no rows before the first batch."""
    full = T.StructType([*(f for f in schema.fields if f.name not in (PART, BATCH)), T.StructField(PART, T.StringType()), T.StructField(BATCH, T.StringType())])
    names = batches(spark, path)
    if not names:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{BATCH}={n}" for n in names])


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last by ``order``; of equal ones the same on every run."""
    rest = [c for c in rows.columns if c not in keys]
    turn = F.struct(*order, F.xxhash64(*rest)) if order else F.xxhash64(*rest)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), turn).alias("_v")).select(*keys, "_v.*").select(*rows.columns)


def _write(rows: DataFrame, path: str, batch: str) -> None:
    """Rows balanced over tasks, a part that is large for one task in several files."""
    (
        rows.hint("rebalance", PART)
        .write.mode("overwrite")
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        .partitionBy(PART)
        .parquet(f"{path}/{BATCH}={batch}")
    )


def _prepared(rows: DataFrame, keys: Sequence[str], part: Column, order: Sequence[str]) -> DataFrame:
    if {PART, BATCH} & {c.lower() for c in rows.columns}:
        raise ValueError(f"{PART} and {BATCH} are columns of the table itself")
    return _last(rows, keys, order).withColumn(PART, F.coalesce(part.cast("string"), F.lit("none")))


def append_new(rows: DataFrame, path: str, keys: Sequence[str], part: Column, batch: str, order: Sequence[str] = ()) -> bool:
    """Append the rows whose key is not stored; of several rows of a key the last by ``order``. Null keys are keys.

    ``part`` must follow from the key columns. False if the batch had been committed before."""
    spark = rows.sparkSession
    if batch in batches(spark, path):
        return False
    new = _prepared(rows, keys, part, order)
    if batches(spark, path):
        at = [r[0] for r in new.select(PART).distinct().collect()]  # parts of one batch, so that only their folders are read
        old = stored(spark, path, rows.schema).where(F.col(PART).isin(at)).select(PART, *keys)
        same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (PART, *keys)])
        new = new.alias("n").join(old.alias("o"), same, "left_anti")
    _write(new, path, batch)
    return True


def put(rows: DataFrame, path: str, keys: Sequence[str], part: Column, batch: str, order: Sequence[str] = ()) -> bool:
    """Add versions of rows, the last of each key by ``order``; :func:`current` reads the valid one. Nothing is rewritten."""
    if batch in batches(rows.sparkSession, path):
        return False
    _write(_prepared(rows, keys, part, order), path, batch)
    return True


def current(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last version of each key by ``order``, then by the name of its batch; aggregated before the exchange."""
    d = stored(spark, path, schema)
    return _last(d, [PART, *keys], [*order, BATCH]).select(*schema.names)
