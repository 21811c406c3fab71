"""Sliding frames by array operations against plain loops, and the queries that use them."""

import math
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.plans.sliding import Frame, sliding


@pytest.mark.parametrize("batch", [7, 10_000])
def test_frames_equal_loops(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [(k, i, None if (i * 7 + len(k)) % 11 == 0 else 0.1 if i < 9 else float((i * 37) % 13)) for k in ("a", "bb", "ccc") for i in range(40)]
        df = spark.createDataFrame(rows, "k string, t int, x double")
        df = df.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("t")))
        got = sliding(df, "at", {"p": Frame("x", 5, 1), "q": Frame("x", 11, ddof=1)}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for r in got:
        own = [x for k, t, x in rows if k == r.k]
        for name, part, sd in (("p", own[max(0, r.t - 5) : r.t], statistics.pstdev), ("q", own[max(0, r.t - 11) : r.t + 1], statistics.stdev)):
            known = [x for x in part if x is not None]
            assert r[f"{name}_n"] == len(known)
            assert r[f"{name}_m"] == (pytest.approx(statistics.fmean(known)) if known else None)
            enough = len(known) > (name == "q")
            assert r[f"{name}_sd"] == (pytest.approx(sd(known), abs=1e-12) if enough else None)
            if enough and len(set(known)) == 1:
                assert r[f"{name}_sd"] == 0.0 and r[f"{name}_m"] == known[0]


def test_bars_are_flagged_without_sliding_frames_of_spark(spark):
    flat = [("A", i, 0.1) for i in range(150)] + [("B", i, 100.0 + i % 2) for i in range(150)] + [("B", 150, 200.0)]
    bars = spark.createDataFrame(flat, "symbol string, day int, close double").select(
        "symbol", F.timestamp_seconds(F.lit(946_684_800) + F.col("day") * 86_400).alias("timestamp"), "close",
        *[F.col("close").alias(c) for c in ("open", "high", "low")], F.lit(1.0).alias("volume"),
    )
    assets = spark.createDataFrame([("A", "crypto", None), ("B", "crypto", None)], "symbol string, asset_class string, listing_date date")
    flagged = Q.flag_bars(bars, assets, "1d", F.lit("2010-01-01").cast("timestamp"))
    assert "RowFrame, -100" not in flagged._jdf.queryExecution().executedPlan().toString()
    issues = Q.issue_table(flagged).collect()
    assert [(r.symbol, r.check_type, r.severity) for r in issues] == [("B", "outlier", "FAIL")]  # equal prices of 0.1 are none
    assert math.isclose(float(issues[0].details.split(":")[1].rstrip("}")), 199.0)
