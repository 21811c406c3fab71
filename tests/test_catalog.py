"""A selection of catalog queries against their SQL twins on the smallest tables, and catalog rules."""

import pytest
from conftest import SF
from oracle import compare, connect

from tickloom import catalog

catalog.load()

FAST = [
    "bars_1h", "order_flow_book", "order_flow_trade", "cvd_kyle", "recent_microstructure", "session_vwap", "vpin_buckets", "daily_realized_variance", "rsi", "atr", "bollinger", "bar_quality_issues",
    "tick_quality_issues", "asof_join_strict", "previous_value", "blackout_join", "barrier_labels", "sample_weights", "trade_group_stats", "rolling_win_rate", "daily_returns", "drawdown", "session_tags",
    "component_scores", "meta_score", "order_screening", "loss_windows", "adjusted_p_values", "weighted_auc", "tick_walk_forward", "ingest_crypto_trades", "ingest_delimited_macro", "meeting_panels", "point_in_time_load",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(catalog.SQL[name]).df()
    diff = compare(got, want)
    assert diff is None or diff.startswith("TYPES"), diff


def test_names():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 150


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert e.queries().keys() >= e.oracle_sql().keys()
