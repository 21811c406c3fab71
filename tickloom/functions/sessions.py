"""Trading sessions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import minutes_of_day, pick


def _within(m: Column, a: int, b: int) -> Column:
    return (m >= a) & (m < b)


def utc_session(ts: Column) -> Column:
    """Six sessions by UTC clock; weekends first."""
    m = minutes_of_day(ts)
    return pick(
        [
            (F.weekday(ts) >= 5, "weekend"),
            (_within(m, 870, 930) | _within(m, 1200, 1260), "us_prime"),
            (_within(m, 870, 1260), "us_normal"),
            (_within(m, 480, 600), "london"),
            (_within(m, 0, 120), "asian"),
        ],
        "after_hours",
    )


# Size multiplier of the nine exchange-clock sessions.
SESSION_MULTIPLIER = {
    "us_open": 1.30,
    "us_morning": 1.00,
    "us_lunch": 0.60,
    "us_afternoon": 1.10,
    "us_close": 1.20,
    "after_hours": 0.50,
    "asian": 0.70,
    "london": 0.90,
    "weekend": 0.40,
}


def exchange_session(ts: Column) -> Column:
    """Nine sessions: New York clock (daylight saving included) during US hours, UTC otherwise."""
    ny = minutes_of_day(F.from_utc_timestamp(ts, "America/New_York"))
    m = minutes_of_day(ts)
    return pick(
        [
            (F.weekday(ts) >= 5, "weekend"),
            (_within(ny, 570, 630), "us_open"),
            (_within(ny, 630, 720), "us_morning"),
            (_within(ny, 720, 810), "us_lunch"),
            (_within(ny, 810, 900), "us_afternoon"),
            (_within(ny, 900, 960), "us_close"),
            (_within(m, 0, 480), "asian"),
            (_within(m, 480, 810), "london"),
        ],
        "after_hours",
    )


def session_multiplier(session: Column) -> Column:
    return pick([(session == k, v) for k, v in SESSION_MULTIPLIER.items()], F.lit(None).cast("double"))


def prime(session: Column) -> Column:
    return session.isin("us_open", "us_close")


def session_bonus(ts: Column) -> Column:
    """Multi-timeframe bonus by UTC clock."""
    m = minutes_of_day(ts)
    return pick(
        [(_within(m, 870, 930) | _within(m, 1200, 1260), 1.20), (_within(m, 480, 600), 1.10), (_within(m, 0, 120), 0.70)], 1.00
    )


def cyclical(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week on the unit circle."""
    import math

    h, d = F.hour(ts) * (2 * math.pi / 24), F.weekday(ts) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "dow_sin": F.sin(d), "dow_cos": F.cos(d)}


def crypto(symbol: Column) -> Column:
    return F.upper(symbol).rlike("(USDT|BTC|ETH|BNB)$")


def asset_class(symbol: Column, explicit: Column | None = None) -> Column:
    guess = F.when(crypto(symbol), "crypto").otherwise("equity")
    return guess if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), guess)
