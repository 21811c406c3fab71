"""Versioned feature table with point-in-time reads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns

VERSION_KEYS = ["symbol", "feature", "version"]


def version_name(calculator: str, params: Mapping, computed_at: str) -> str:
    """Short reproducible version string from the calculator, its parameters and the time (ISO)."""
    body = {"calculator_name": calculator, "computed_at": computed_at, "params": dict(params)}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return f"{calculator}-{hashlib.sha256(text.encode()).hexdigest()[:8]}"


def content_hash(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free fingerprint per key: combined row hashes and the row count."""
    rest = [c for c in values.columns if c not in keys]
    return values.groupBy(*keys).agg(
        F.concat_ws("-", F.hex(F.bit_xor(F.xxhash64(*rest))), F.hex(F.sum(F.xxhash64(*rest).bitwiseAND(0xFFFFFFFF))), F.count(F.lit(1)).cast("string")).alias("content_hash")
    )


def tall(frame: DataFrame, features: Sequence[str], version: str, computed_at: str) -> DataFrame:
    """Rows of the feature table from a wide frame (symbol, timestamp, features)."""
    require_columns(frame, "symbol", "timestamp", *features)
    t = frame.select("symbol", "timestamp", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["symbol", "timestamp"], list(features), "feature", "value")
    return t.withColumn("version", F.lit(version)).withColumn("computed_at", F.lit(computed_at).cast("timestamp")).select("symbol", "feature", "version", "timestamp", "value", "computed_at")


def catalog_rows(values: DataFrame) -> DataFrame:
    """One metadata row per stored version."""
    g = values.groupBy(*VERSION_KEYS).agg(
        F.max("computed_at").alias("computed_at"), F.count(F.lit(1)).alias("row_count"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts")
    )
    return g.join(content_hash(values.select(*VERSION_KEYS, "timestamp", "value"), VERSION_KEYS), VERSION_KEYS)


def conflicts(values: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions about to be written that exist already: must be empty before a save."""
    return values.select(*VERSION_KEYS).distinct().join(versions.select(*VERSION_KEYS), VERSION_KEYS, "left_semi")


def save(values: DataFrame, path: str, versions: DataFrame | None = None) -> None:
    """Append a new version; refuses versions that exist. Partitioned by feature and month."""
    if versions is not None and conflicts(values, versions).limit(1).count():
        raise ValueError("version exists already")
    v = values.withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    v.repartition("feature", "month", "symbol").sortWithinPartitions("feature", "month", "symbol", "timestamp").write.mode("append").partitionBy("feature", "month").parquet(f"{path}/values")
    catalog_rows(values).write.mode("append").parquet(f"{path}/versions")


def features_of(versions: DataFrame) -> DataFrame:
    return versions.select("symbol", "feature").distinct()


def latest_version(versions: DataFrame, as_of: str | Column) -> DataFrame:
    """Version in force per symbol and feature at a time."""
    t = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    v = versions.filter(F.col("computed_at") <= t)
    return v.groupBy("symbol", "feature").agg(F.max_by("version", F.struct("computed_at", "version")).alias("version"))


def load(values: DataFrame, versions: DataFrame, features: Sequence[str], start: str, end: str, as_of: str, version: str | None = None) -> DataFrame:
    """Wide point-in-time frame: version as of a time, start <= t <= end, nothing computed later.

    The features are pivoted in one shuffle, so a timestamp present for any of them gives a row."""
    v = values.filter(F.col("feature").isin(*features))
    v = v.filter((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") <= F.lit(end).cast("timestamp")))
    v = v.filter(F.col("computed_at") <= F.lit(as_of).cast("timestamp"))
    if version is None:
        v = v.join(latest_version(versions, as_of), VERSION_KEYS, "left_semi")
    else:
        v = v.filter(F.col("version") == version)
    return v.groupBy("symbol", "timestamp").pivot("feature", list(features)).agg(F.first("value"))


def look_ahead(values: DataFrame, as_of: str) -> DataFrame:
    """Number of rows computed after ``as_of`` per feature: must be empty in a point-in-time frame."""
    return values.filter(F.col("computed_at") > F.lit(as_of).cast("timestamp")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def coverage(frame: DataFrame, columns: Sequence[str], index: str | None = None, warm_up: int = 0) -> DataFrame:
    """Nulls per column beyond the warm-up rows, in one pass."""
    f = frame.filter(F.col(index) >= warm_up) if index else frame
    one = f.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["n_rows"], list(columns), "column", "n_null")


# -- calculators by name -----------------------------------------------------------------------
CALCULATORS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], tuple[str, ...]]] = {}


def register_calculator(name: str, fn: Callable[..., DataFrame], requires: Sequence[str], adds: Sequence[str]) -> None:
    """A calculator is a function DataFrame -> DataFrame that declares the columns it needs and adds."""
    CALCULATORS[name] = (fn, tuple(requires), tuple(adds))


def run_calculators(frame: DataFrame, names: Sequence[str], params: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Chain calculators; required and added columns are checked on the plan."""
    for n in names:
        fn, need, adds = CALCULATORS[n]
        frame = require_columns(frame, *need).transform(fn, **dict((params or {}).get(n, {})))
        require_columns(frame, *adds)
    return frame


def _defaults() -> None:
    from . import orderflow

    register_calculator("order_flow", orderflow.order_flow, ("symbol", "timestamp", "seq"), ("ofi_10", "ofi_50", "ofi_100", "ofi_signal"))
    register_calculator("cvd_kyle", orderflow.cvd_kyle, ("symbol", "timestamp", "seq", "price", "quantity", "side"), ("cvd", "cvd_divergence", "kyle_lambda", "combined_signal"))
    register_calculator("session_vwap", orderflow.session_vwap, ("symbol", "timestamp", "price", "quantity"), ("vwap",))


_defaults()
