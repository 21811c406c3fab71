"""Meeting calendars from pages of HTML, in bulk over a table of pages.

Pages are cut into elements, each a row of text. A text is a list of tokens (words, numbers, marks); where one is the name
of a month, the tokens around it are read by position as a day, a range of days and a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Month names and clock times (UTC) of the announcements.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STATEMENT, PRESS, MINUTES = (18, 0), (18, 30), (18, 0)
COUNCIL_DECISION, COUNCIL_PRESS = (12, 15), (12, 45)
BOARD_ANNOUNCEMENT = (3, 0)


def plain_text(html: Column) -> Column:
    """Tags and comments out, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def month_number(name: Column) -> Column:
    m = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(name)).cast("int")
    return F.nullif(m, F.lit(0))


def moment(year: Column, month: Column, day: Column, clock: tuple[int, int]) -> Column:
    """UTC time, null where the date does not exist."""
    return F.try_make_timestamp(year.cast("int"), month, day.cast("int"), F.lit(clock[0]), F.lit(clock[1]), F.lit(0).cast("decimal(16,6)"))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later columns refer to them."""
    made = df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_once"))
    return made.select(*df.columns, "_once.*")


def _digits(x: Column) -> Column:
    return F.nullif(x, F.lit("")).try_cast("int")


def tokens(text: Column) -> Column:
    """Words in lower case, numbers, and every other mark by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+|[^a-z0-9 ]"), F.lit(0))


def _day(token: Column) -> Column:
    return F.when(F.length(token) <= 2, token.try_cast("int"))


def _year(token: Column) -> Column:
    return F.when(F.length(token) == 4, token.try_cast("int"))


def dates(tokens: str, between: Sequence[str]) -> Column:
    """What the tokens around each month say, in order: ``month`` and ``day`` (the last of a range whose ends one of the marks
    ``between`` parts), ``year`` behind it or null, and ``lead``, the day in front of the month."""
    t = lambda i: F.get(F.col(tokens), i)

    # in steps, each a struct, so that no step is worked out again wherever a later one refers to it
    def place(i: Column) -> Column:
        taken = F.when(t(i - 2).isin(*between) & _day(t(i - 3)).isNotNull() & month_number(t(i - 4)).isNotNull(), True).otherwise(False)  # end of a range
        return F.struct(i.alias("i"), (i + F.when(t(i + 1) == ".", 2).otherwise(1)).alias("day"), taken.alias("taken"))

    def span(x: Column) -> Column:
        day = x["day"]
        ranged = t(day + 1).isin(*between)
        far = F.when(ranged & month_number(t(day + 2)).isNotNull() & _day(t(day + 3)).isNotNull(), 2).when(ranged & _day(t(day + 2)).isNotNull(), 1).otherwise(0)
        return F.struct(x["i"].alias("i"), day.alias("day"), far.alias("far"))

    def end(x: Column) -> Column:
        last = x["day"] + F.when(x["far"] == 2, 3).when(x["far"] == 1, 2).otherwise(0)
        name = t(F.when(x["far"] == 2, x["day"] + 2).otherwise(x["i"]))
        return F.struct(x["i"].alias("i"), last.alias("last"), name.alias("name"))

    def read(x: Column) -> Column:
        i, last = x["i"], x["last"]
        year = F.coalesce(_year(t(last + 1)), F.when(t(last + 1) == ",", _year(t(last + 2))))
        return F.struct(month_number(x["name"]).alias("month"), _day(t(last)).alias("day"), year.alias("year"), F.when(i > 0, _day(t(i - 1))).alias("lead"), _year(t(i + 1)).alias("next"))

    months = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: t(i).isin(*MONTHS))  # places; only these are read
    free = F.filter(F.transform(months, place), lambda x: ~x["taken"])
    return F.transform(F.transform(F.transform(free, span), end), read)


def elements(pages: DataFrame, tags: Sequence[str], html: str = "html", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """(keys, n, tag, text) for each element with one of the tags, in page order."""
    rx = r"(?is)<(" + "|".join(tags) + r")\b[^>]*>(.*?)</\1\s*>"
    whole = F.regexp_extract_all(F.col(html), F.lit(rx), F.lit(0))
    d = pages.select(*keys, F.posexplode(whole).alias("n", "e"))
    tag = F.lower(F.regexp_extract("e", r"^<(\w+)", 1))
    return d.select(*keys, "n", tag.alias("tag"), plain_text(F.col("e")).alias("text")).filter(F.col("text") != "")


def _clip(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    e = events.filter(F.col("scheduled_time").isNotNull())
    if start:
        e = e.filter(F.col("scheduled_time") >= F.lit(start).cast("timestamp"))
    return e.filter(F.col("scheduled_time") < F.lit(end).cast("timestamp")) if end else e


_BETWEEN = ("-", "\u2013")


def panel_meetings(pages: DataFrame, start: str | None = None, end: str | None = None, html: str = "html", keys: Sequence[str] = ("page_id",), panel: str = "panel", row: str = "fomc-meeting", prefix: str = "fomc") -> DataFrame:
    """Divisions of class ``panel`` with a year in their heading and rows of class ``row``: statement on the last day, '*' adds
    a press conference, a later full date is the minutes release; unscheduled and notation rows are skipped."""
    opened = lambda name: rf'(?i)<div[^>]*class="{name}[ "]'
    p = pages.select(*keys, F.posexplode(F.split(F.col(html), opened(panel))).alias("_p", "part"))
    cells = F.split("part", opened(row))
    p = _once(p.select(*keys, cells.alias("_cells")), _head=tokens(plain_text(F.concat(F.lit("<"), F.get("_cells", F.lit(0))))))
    p = p.withColumn("_rows", F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))))
    years = F.filter("_head", lambda x: _year(x).isNotNull())
    p = _once(p, year=F.get(years, F.lit(0)).cast("int")).where("year is not null")
    text = F.lower(plain_text(F.concat(F.lit("<"), F.substring_index("raw", "</div>", 1))))
    r = _once(p.select(*keys, "year", F.explode("_rows").alias("raw")), text=text).drop("raw")
    r = r.where(~F.contains("text", F.lit("unscheduled")) & ~F.contains("text", F.lit("notation")))
    r = _once(_once(r, _t=tokens(F.col("text"))), _d=dates("_t", _BETWEEN))
    later = F.get(F.filter(F.slice("_d", 2, F.greatest(F.size("_d") - 1, F.lit(0))), lambda x: x["year"].isNotNull()), F.lit(0))
    r = _once(r, first=F.get("_d", F.lit(0)), later=later)
    first, later = F.col("first"), F.col("later")
    held = lambda clock: moment(F.col("year"), first["month"], first["day"], clock)
    event = lambda name, time: F.struct(F.lit(f"{prefix}_{name}").alias("event_type"), time.alias("scheduled_time"))
    ev = F.array(
        event("statement", held(STATEMENT)),
        event("press_conference", F.when(F.array_contains("_t", F.lit("*")), held(PRESS))),
        event("minutes", moment(later["year"], later["month"], later["day"], MINUTES)),
    )
    return _clip(r.select(*keys, F.explode(ev).alias("e")).select(*keys, "e.*", F.lit(3).alias("impact_score")), start, end)


def council_meetings(pages: DataFrame, start: str | None = None, end: str | None = None, html: str = "html", keys: Sequence[str] = ("page_id",), tags: Sequence[str] = ("tr",), prefix: str = "ecb") -> DataFrame:
    """'D Month YYYY' anywhere in a row; monetary rows give a decision and a press conference, others a
    council meeting. The first row of a time wins."""
    e = elements(pages, tags, html, keys).withColumn("_t", tokens(F.col("text")))
    words = lambda *x: F.exists(F.sequence(F.lit(0), F.size("_t")), lambda i: F.array(*[F.get("_t", i + k) for k in range(len(x))]) == F.array(*map(F.lit, x)))
    negated = words("non", "-", "monetary") | words("non", "monetary")
    money = F.contains(F.lower("text"), F.lit("monetary")) & ~negated
    e = e.select(*keys, "n", money.alias("money"), F.posexplode(dates("_t", ())).alias("k", "d"))
    e = e.withColumn("t", moment(F.col("d.next"), F.col("d.month"), F.col("d.lead"), COUNCIL_DECISION)).where("t is not null")
    e = e.groupBy(*keys, "t").agg(F.min_by("money", F.struct("n", "k")).alias("money"))
    gap = (COUNCIL_PRESS[0] * 60 + COUNCIL_PRESS[1] - COUNCIL_DECISION[0] * 60 - COUNCIL_DECISION[1]) * 60_000_000
    later = F.timestamp_micros(F.unix_micros("t") + gap)
    row = lambda n, ts, i: F.struct(F.lit(f"{prefix}_{n}").alias("event_type"), ts.alias("scheduled_time"), F.lit(i).alias("impact_score"))
    ev = F.when(F.col("money"), F.array(row("rate_decision", F.col("t"), 3), row("press_conference", later, 3))).otherwise(F.array(row("governing_council", F.col("t"), 2)))
    return _clip(e.select(*keys, F.explode(ev).alias("e")).select(*keys, "e.*"), start, end)


HEADINGS = ("h2", "h3", "h4", "h5", "caption")


def board_meetings(pages: DataFrame, start: str | None = None, end: str | None = None, html: str = "html", keys: Sequence[str] = ("page_id",), tags: Sequence[str] = (*HEADINGS, "tr", "li", "p"), prefix: str = "boj") -> DataFrame:
    """Dates without year below headings that carry one: the last year seen applies, ranges end on the last day."""
    e = elements(pages, tags, html, keys).withColumn("_t", tokens(F.col("text")))
    years = F.filter("_t", lambda x: _year(x).between(2000, 2099))
    # A page is one document; its elements are ordered within the page only.
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_y", F.get(years, F.lit(0)).cast("int")).withColumn("year", F.last("_y", ignorenulls=True).over(w))
    e = e.where(~(F.col("tag").isin(*HEADINGS) & F.col("_y").isNotNull()) & F.col("year").isNotNull())
    e = e.select(*keys, "year", F.explode(dates("_t", (*_BETWEEN, ","))).alias("d"))
    t = moment(F.col("year"), F.col("d.month"), F.col("d.day"), BOARD_ANNOUNCEMENT)
    out = e.select(*keys, F.lit(f"{prefix}_meeting").alias("event_type"), t.alias("scheduled_time"), F.lit(3).alias("impact_score"))
    return _clip(out.distinct(), start, end)
