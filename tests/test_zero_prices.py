"""Prices of 0: quotients as IEEE 754 (and the SQL twins) have them instead of an error."""

import math

import numpy as np
import pandas as pd
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from conftest import SF
from tickloom import catalog
from tickloom.operators import performance as P
from tickloom.operators import research as R
from tickloom.operators import volatility as X
from tickloom.plans.ordered import HALO, INDEX, TICKS

catalog.load()


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """The smallest tables with a few ticks at price 0, two of them next to each other in their symbol."""
    d = tmp_path_factory.mktemp("zeros")
    e = spark.read.parquet(f"{SF}/events.parquet")
    at = [r[0] for r in e.filter("user_id % 12 = 3").orderBy("ts").select("event_id").collect()]
    hit = F.col("event_id").isin([at[5], at[6], at[20], at[-1]])
    e.withColumn("value", F.when(hit, 0.0).otherwise(F.col("value"))).write.parquet(f"{d}/events.parquet")
    return str(d)


def _twin(zeros, name):
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{zeros}/events.parquet/*.parquet'")
    return con.execute(catalog.SQL[name]).df()


@pytest.mark.parametrize("name", ["forward_returns", "weighted_fusion", "impact_estimate", "quote_columns"])
def test_query_equals_sql(spark, zeros, name):
    diff = compare(catalog.QUERIES[name](spark, zeros).toPandas(), _twin(zeros, name))
    assert diff is None or diff.startswith("TYPES"), diff


def test_forward_returns(spark):
    p = [1.0, 0.0, 0.0, 2.0]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "symbol string, seq long, price double").withColumn("timestamp", F.timestamp_seconds("seq"))
    got = [r.fwd_1 for r in R.forward_returns(d, (1,), TICKS).orderBy("seq").collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == math.inf and got[3] is None


def test_window_ic_ties_nan():
    x, y = np.array([1.0, np.nan, 2.0, np.nan, 0.0]), np.array([1.0, 4.0, 3.0, 5.0, 2.0])
    want = pd.Series([2.0, 4.5, 3.0, 4.5, 1.0]).corr(pd.Series(y))
    assert R._window_ic(x, y, 5, np.array([4]))[0] == pytest.approx(want, abs=1e-12)


def test_chunk_without_a_window_keeps_its_types():
    rows = pd.DataFrame({"symbol": ["a"] * 3, INDEX: [0, 1, 2], HALO: [False] * 3, "value": [1.0, 2.0, 3.0], "fwd": [1.0, 2.0, 3.0]})
    got = R._chunk_ic(["symbol"], 252, 5)(rows)
    assert len(got) == 0 and got["symbol"].dtype == rows["symbol"].dtype


def test_intraday_days_return_across_a_zero(spark):
    p = [100.0, 0.0, 110.0]
    d = spark.createDataFrame([("a", i * 300, x) for i, x in enumerate(p)], "symbol string, s long, close double").withColumn("timestamp", F.timestamp_seconds("s"))
    got = X.intraday_days(d).collect()
    assert len(got) == 1 and got[0].rv == pytest.approx(math.log(1.1) ** 2) and got[0].log_return == pytest.approx(math.log(1.1))


def test_longest_drawdown_counts_from_the_peak(spark):
    d = spark.createDataFrame([("x", i, e) for i, e in enumerate([100.0, 90.0, 95.0, 120.0, 110.0])], "strategy_id string, pos long, equity double")
    assert P.longest_drawdown(d).first().longest_periods == 2
