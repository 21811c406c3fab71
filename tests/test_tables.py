"""Committed batches: repeated and failed appends, versions, null keys."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tickloom.sources import tables as TB

SCHEMA = "k string, day int, v double, version int"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).repartition(3)


def _got(df):
    return sorted(map(tuple, df.select("k", "day", "v").collect()), key=str)


def test_appending_twice_changes_nothing(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.col("day") % 2
    a = _rows(spark, ("x", 1, 1.0, 1), ("x", 1, 2.0, 2), (None, 1, 3.0, 1), ("y", None, 4.0, 1))
    assert TB.stored(spark, path, a.schema).count() == 0
    assert TB.append_new(a, path, ["k", "day"], part, "a", ["version"])
    first = [(None, 1, 3.0), ("x", 1, 2.0), ("y", None, 4.0)]
    assert _got(TB.stored(spark, path, a.schema)) == sorted(first, key=str)
    assert not TB.append_new(a, path, ["k", "day"], part, "a", ["version"])  # the batch again
    assert TB.append_new(a, path, ["k", "day"], part, "b", ["version"])  # the rows again, under another name
    assert _got(TB.stored(spark, path, a.schema)) == sorted(first, key=str)
    more = _rows(spark, ("x", 1, 9.0, 9), ("x", 2, 5.0, 1), (None, 1, 9.0, 9))
    TB.append_new(more, path, ["k", "day"], part, "c")
    assert _got(TB.stored(spark, path, a.schema)) == sorted([*first, ("x", 2, 5.0)], key=str)
    assert TB.batches(spark, path) == ["a", "b", "c"]


def test_half_written_batch_is_not_seen_and_is_written_anew(spark, tmp_path):
    path, a = str(tmp_path / "t"), _rows(spark, ("x", 1, 1.0, 1))
    TB.append_new(a, path, ["k", "day"], F.col("day"), "a")
    TB.append_new(_rows(spark, ("y", 1, 7.0, 1)), path, ["k", "day"], F.col("day"), "b")
    os.remove(f"{path}/batch=b/_SUCCESS")  # as if the writer had been lost before its last step
    assert _got(TB.stored(spark, path, a.schema)) == [("x", 1, 1.0)]
    assert TB.append_new(_rows(spark, ("y", 1, 2.0, 1)), path, ["k", "day"], F.col("day"), "b")
    assert _got(TB.stored(spark, path, a.schema)) == [("x", 1, 1.0), ("y", 1, 2.0)]


def test_only_touched_parts_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a = _rows(spark, *[("x", i, float(i), 1) for i in range(20)])
    TB.append_new(a, path, ["k", "day"], F.col("day"), "a")
    plans, write = [], TB._write

    def spy(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, *rest)

    monkeypatch.setattr(TB, "_write", spy)
    TB.append_new(_rows(spark, ("x", 3, 0.0, 1), ("x", 25, 0.0, 1)), path, ["k", "day"], F.col("day"), "b")
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \((3,25|25,3)\)", plans[0])
    assert TB.stored(spark, path, a.schema).count() == 21


def test_versions(spark, tmp_path):
    path, a = str(tmp_path / "t"), _rows(spark, ("x", 1, 1.0, 2), ("y", 1, 1.0, 1))
    TB.put(a, path, ["k", "day"], F.col("day"), "1", ["version"])
    TB.put(_rows(spark, ("x", 1, 0.0, 1), ("y", 1, 5.0, 3), ("y", 1, 4.0, 2), ("z", 2, 6.0, 1)), path, ["k", "day"], F.col("day"), "2", ["version"])
    now = lambda: _got(TB.current(spark, path, a.schema, ["k", "day"], ["version"]))
    assert now() == [("x", 1, 1.0), ("y", 1, 5.0), ("z", 2, 6.0)]
    assert not TB.put(a, path, ["k", "day"], F.col("day"), "2", ["version"]) and now()[1] == ("y", 1, 5.0)
    TB.put(_rows(spark, ("x", 1, 8.0, 2)), path, ["k", "day"], F.col("day"), "3", ["version"])  # a tie: the later batch
    assert now()[0] == ("x", 1, 8.0)


def test_reserved_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        TB.append_new(_rows(spark, ("x", 1, 1.0, 1)).withColumn("part", F.lit(1)), str(tmp_path / "t"), ["k"], F.col("day"), "a")
