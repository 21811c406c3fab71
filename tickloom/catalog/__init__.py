"""Catalog: every operator as a runnable query over the provided tables, most with a SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = (
    "bars",
    "orderflow",
    "volatility",
    "technical",
    "quality",
    "joins",
    "labels",
    "trades",
    "performance",
    "signals",
    "risk",
    "research",
    "ingest",
    "store",
    "learning",
    "streams",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise


def rnd(x: Column | str, digits: int = 6) -> Column:
    """Rounded result column, without negative zero.

    A nudge far below the last digit keeps exact ties (frequent for ratios of whole numbers) from being
    rounded up by one engine and down by the other."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1.7 * 10.0 ** -(digits + 4)), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int | None = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (unless ``digits`` is None); timestamps become zone-free."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "double" and f.name not in keep and digits is not None:
            out.append(rnd(f.name, digits).alias(f.name))
        elif t in ("timestamp", "date"):
            out.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """SQL twin of :func:`rnd`."""
    return f"(round(({expr}) + {1.7 * 10.0 ** -(digits + 4)!r}, {digits}) + 0.0e0) AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits) for n in names)
