"""Plans that repeat their inputs outgrow the driver: the matrix of the training queries reads materialised tables."""

from conftest import SF

from tickloom import catalog
from tickloom.catalog import learning
from tickloom.operators import performance as P
from tickloom.sources import views as V

catalog.load()


def test_training_matrix_does_not_repeat_its_inputs(spark):
    plan = learning._matrix(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == 0


def test_blackout_join_cuts_distinct_windows(spark):
    plan = catalog.QUERIES["blackout_join"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan or "Distinct" in plan


def test_in_out_split_sends_series_rows_to_the_trades(spark):
    plan = catalog.QUERIES["in_out_split"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=broadcast") == 3  # the starts are read from trades that have met the counts


def test_reports_read_the_trades_once(spark):
    """What follows the one pass over the trades works on a row per day."""
    t = V.trades(spark, SF)
    for made in (P.report(t), P.breakdowns(t)):
        assert made._jdf.queryExecution().analyzed().toString().count("Relation") == 0


def test_span_uniqueness_sweeps_stored_points(spark):
    """The trades are read for the spans that come out, and not for each sum over the points."""
    plan = catalog.QUERIES["span_uniqueness"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [o_orderkey") == 1
