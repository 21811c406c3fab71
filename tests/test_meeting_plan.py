"""The dates of a meeting row are read once, not again for each use."""

from tickloom.sources import calendars as C


def test_each_step_of_a_date_stands_in_the_plan_once(spark):
    pages = spark.createDataFrame([(1, '<div class="panel x"><h4>2024</h4><div class="fomc-meeting">January 30-31* (Released February 21, 2024)</div></div>')], "page_id long, html string")
    found = C.panel_meetings(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") <= 12  # two for each month that is looked up
    got = sorted((r.event_type, str(r.scheduled_time)) for r in found.collect())
    assert got == [("fomc_minutes", "2024-02-21 18:00:00"), ("fomc_press_conference", "2024-01-31 18:30:00"), ("fomc_statement", "2024-01-31 18:00:00")]
