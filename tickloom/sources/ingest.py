"""Readers and normalisers for raw market, macro and fundamental data.

Readers return raw columns; normalisers turn raw columns into table rows. Normalisers are plain
DataFrame functions, so they work on files and on streams alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import pick
from ..functions.sessions import utc_session

DEC = "decimal(20,8)"


def _clip(df: DataFrame, start: str | None, end: str | None, time: str = "timestamp") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    return df.filter(F.col(time) < F.lit(end).cast("timestamp")) if end is not None else df


# -- ticks in Parquet --------------------------------------------------------------------------
def normalize_ticks(raw: DataFrame) -> DataFrame:
    """Fill optional tick columns; rows without symbol, time or a positive price are left out."""
    have = set(raw.columns)
    opt = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    price = F.col("price").cast("double")
    out = raw.select(
        F.upper("symbol").alias("symbol"),
        (F.col("market") if "market" in have else F.lit("crypto")).alias("market"),
        F.col("timestamp_ms").cast("long").alias("timestamp_ms"),
        F.timestamp_millis(F.col("timestamp_ms").cast("long")).alias("timestamp"),
        price.alias("price"),
        F.col("volume").cast("double").alias("volume"),
        opt("side", F.lit("unknown")).alias("side"),
        opt("bid", price).cast("double").alias("bid"),
        opt("ask", price).cast("double").alias("ask"),
        opt("spread_bps", F.lit(1.0)).cast("double").alias("spread_bps"),
        opt("session", F.lit("after_hours")).alias("session"),
    )
    return out.filter(F.col("symbol").isNotNull() & F.col("timestamp_ms").isNotNull() & (F.col("price") > 0) & (F.col("volume") >= 0))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return normalize_ticks(spark.read.parquet(path))


def write_ticks(ticks: DataFrame, path: str, mode: str = "append") -> None:
    """Date-partitioned, clustered by symbol and time inside a file so that row groups can be skipped.

    Rows are spread by (date, symbol, hour), which also splits a busy symbol."""
    t = ticks.withColumn("date", F.to_date("timestamp"))
    t.repartition("date", "symbol", F.hour("timestamp")).sortWithinPartitions("date", "symbol", "timestamp").write.mode(mode).partitionBy("date").parquet(path)


def quote_columns(df: DataFrame, nominal_bps: float | None = None) -> DataFrame:
    """Mid price and spread in basis points, rounded half-even to two digits. Where the mid price is 0 the
    spread is ``nominal_bps``, the relative width of a source that quotes at a fixed distance (null without one)."""
    mid = (F.col("bid") + F.col("ask")) / 2
    bps = F.bround(F.when(mid > 0, (F.col("ask") - F.col("bid")) / F.when(mid > 0, mid) * 10_000), 2)
    return df.withColumn("mid", mid).withColumn("spread_bps", F.when(mid == 0, F.lit(nominal_bps).cast("double")).otherwise(bps))


# -- delimited market data ------------------------------------------------------------------------
# Column order of the delimited formats.
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_base", "taker_quote", "ignore")
AGG_TRADE = ("agg_id", "price", "quantity", "first_id", "last_id", "time", "buyer_is_maker", "best_match")
MINUTE_AGG = ("ticker", "volume", "open", "close", "high", "low", "window_start", "transactions")


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], header: bool = False) -> DataFrame:
    """All columns as text (no inference pass). A .gz file is one task, so write many small archives."""
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, header=header)


def normalize_klines(raw: DataFrame, bar_size: str, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars with the volume-weighted price from quote volume (null without volume)."""
    num = lambda c: F.col(c).cast(DEC)
    bars = raw.select(
        *keys,
        F.lit("time").alias("bar_type"),
        F.lit(bar_size).alias("bar_size"),
        F.timestamp_millis(F.col("open_time").cast("long")).alias("timestamp"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("trade_count").cast("long").alias("trade_count"),
        F.when(num("volume") > 0, num("quote_volume") / F.when(num("volume") > 0, num("volume"))).cast(DEC).alias("vwap"),
    )
    return _clip(bars, start, end)


def normalize_agg_trades(raw: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    maker = F.lower(F.trim("buyer_is_maker")) == "true"
    t = raw.select(
        *keys,
        F.timestamp_millis(F.col("time").cast("long")).alias("timestamp"),
        F.col("agg_id").alias("trade_id"),
        F.col("price").cast(DEC).alias("price"),
        F.col("quantity").cast(DEC).alias("quantity"),
        F.when(maker, "sell").otherwise("buy").alias("side"),
    )
    return _clip(t, start, end)


def normalize_minute_aggs(raw: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    if symbols is not None:
        raw = raw.filter(F.upper("ticker").isin([s.upper() for s in symbols]))
    ns = F.col("window_start").cast("long")
    b = raw.select(
        F.upper("ticker").alias("symbol"),
        F.timestamp_micros((ns / 1000).cast("long")).alias("timestamp"),
        *[F.col(c).cast(DEC).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("transactions").cast("long").alias("trade_count"),
        F.lit(None).cast(DEC).alias("vwap"),
    )
    return _clip(b, start, end)


# -- JSON market data ---------------------------------------------------------------------------------
def iso_micros(text: Column) -> Column:
    """ISO time with any number of fraction digits, cut to microseconds; no zone means UTC."""
    return F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp")


def normalize_bar_payload(raw: DataFrame, payload: str = "payload", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    j = F.from_json(F.col(payload), "timestamp string, open double, high double, low double, close double, volume double, trade_count long, vwap double")
    d = raw.withColumn("_j", j)
    return d.select(
        *keys, iso_micros(F.col("_j.timestamp")).alias("timestamp"), *[F.col(f"_j.{c}").cast(DEC).alias(c) for c in ("open", "high", "low", "close", "volume")], F.col("_j.trade_count").alias("trade_count"), F.col("_j.vwap").cast(DEC).alias("vwap")
    )


def normalize_daily_index(raw: DataFrame, zone: str = "America/New_York", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily rows with local time stamps to UTC; missing volume counts as 0."""
    v = F.col("volume").cast("double")
    return raw.select(
        *keys,
        F.to_utc_timestamp(F.col("timestamp").cast("timestamp"), zone).alias("timestamp"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)).alias("volume"),
    )


def normalize_crypto_trades(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Trades from JSON (s, T or t, p, q, m, b, a) with session; ``error`` is set where a row is unusable."""
    j = F.from_json(F.col(payload), "s string, T long, t long, p string, q string, m boolean, b string, a string", {"caseSensitive": "true"})
    field = lambda k: F.get_json_object(F.col(payload), f"$.{k}")
    ms = F.coalesce(F.nullif(field("T").try_cast("long"), F.lit(0)), F.nullif(field("t").try_cast("long"), F.lit(0)))
    ts = F.timestamp_millis(ms)
    d = raw.select(
        *raw.columns,
        F.upper(F.coalesce(field("s"), F.lit(""))).alias("symbol"),
        F.lit("crypto").alias("market"),
        ts.alias("timestamp"),
        field("p").try_cast(DEC).alias("price"),
        field("q").try_cast(DEC).alias("volume"),
        F.when(F.coalesce(field("m").try_cast("boolean"), F.lit(False)), "sell").otherwise("buy").alias("side"),
        field("b").try_cast(DEC).alias("bid"),
        field("a").try_cast(DEC).alias("ask"),
    )
    bad = pick([(F.col("timestamp").isNull(), "missing_time"), (F.col("price").isNull() | F.col("volume").isNull(), "missing_field")], F.lit(None).cast("string"))
    return d.withColumn("session", utc_session(F.col("timestamp"))).withColumn("error", bad)


def normalize_equity_trades(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Trades from JSON (S, t, p, s) with unknown side."""
    field = lambda k: F.get_json_object(F.col(payload), f"$.{k}")
    d = raw.select(
        *raw.columns,
        F.upper(F.coalesce(field("S"), F.lit(""))).alias("symbol"),
        F.lit("equity").alias("market"),
        iso_micros(field("t")).alias("timestamp"),
        field("p").try_cast(DEC).alias("price"),
        field("s").try_cast(DEC).alias("volume"),
        F.lit("unknown").alias("side"),
    )
    bad = pick([(F.col("timestamp").isNull(), "missing_time"), (F.col("price").isNull() | F.col("volume").isNull(), "missing_field")], F.lit(None).cast("string"))
    return d.withColumn("session", utc_session(F.col("timestamp"))).withColumn("error", bad)


def split_errors(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reason)."""
    return normalized.filter("error IS NULL").drop("error"), normalized.filter("error IS NOT NULL")


# -- macro series --------------------------------------------------------------------------------------
def partial_date(text: Column) -> Column:
    """'YYYY-MM-DD...', 'YYYY-MM' or 'YYYY' as a timestamp."""
    return (
        F.when(F.length(text) == 7, F.concat(text, F.lit("-01")))
        .when(F.length(text) == 4, F.concat(text, F.lit("-01-01")))
        .otherwise(text)
        .try_cast("timestamp")
    )


def macro_observations(raw: DataFrame, payload: str = "payload", end: str | None = None) -> DataFrame:
    """(series_id, observations[{date, value}]) documents to rows; unreadable values are dropped."""
    j = F.from_json(F.col(payload), "series_id string, observations array<struct<date string, value string>>")
    d = raw.select(j.alias("j")).select("j.series_id", F.explode("j.observations").alias("o"))
    v = F.col("o.value").try_cast("double")
    d = d.select("series_id", partial_date(F.col("o.date")).alias("timestamp"), v.alias("value"))
    return _clip(d.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("timestamp").isNotNull()), None, end)


def sdmx_observations(raw: DataFrame, payload: str = "payload", start: str | None = None, end: str | None = None, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Observation maps keyed by position into the list of times."""
    j = F.from_json(
        F.col(payload),
        "dataSets array<struct<series map<string, struct<observations map<string, array<double>>>>>>, "
        "structure struct<dimensions struct<observation array<struct<values array<struct<id string>>>>>>",
    )
    d = raw.select(*keys, j.alias("j"))
    d = d.select(*keys, F.col("j.dataSets")[0]["series"].alias("s"), F.col("j.structure.dimensions.observation")[0]["values"].alias("times"))
    d = d.select(*keys, "times", F.explode("s").alias("_k", "_v")).select(*keys, "times", F.explode("_v.observations").alias("i", "obs"))
    at = F.try_element_at("times", F.col("i").cast("int") + 1)
    d = d.select(*keys, partial_date(at["id"]).alias("timestamp"), F.try_element_at("obs", F.lit(1)).alias("value"))
    return _clip(d.filter(F.col("value").isNotNull() & F.col("timestamp").isNotNull()), start, end)


# Date patterns in the order they are tried, and cells that mean "no value".
DATE_PATTERNS = ("yyyy/M", "yyyy/M/d", "yyyy-M-d", "yyyy-M", "yyyy")
EMPTY_CELLS = ("", "-", "...", "n.a.", "N/A")


# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "shift_jis", "cp932")


def read_lines(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """Text lines of small files in mixed encodings: per file the first encoding that decodes it."""
    enc = list(encodings)

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                for e in enc:
                    try:
                        text = bytes(raw).decode(e)
                    except UnicodeDecodeError:
                        continue
                    yield pd.DataFrame({"line": text.splitlines()})
                    break

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "line string")


def delimited_macro(lines: DataFrame, line: str = "line", start: str | None = None, end: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose first cell is a date in a known pattern, with the first numeric cell after it."""
    cells = F.transform(F.split(F.col(line), r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "﻿", "")), "^[\"']|[\"']$", "")))
    d = lines.select(*keys, cells.alias("c")).filter(F.size("c") >= 2)
    when = F.coalesce(*[F.try_to_timestamp(F.col("c")[0], F.lit(p)) for p in DATE_PATTERNS])
    plain = F.filter(F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x: F.regexp_replace(x, ",", "")), lambda x: ~x.isin(*EMPTY_CELLS))
    num = F.filter(F.transform(plain, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    d = d.select(*keys, when.alias("timestamp"), F.try_element_at(num, F.lit(1)).alias("value"))
    return _clip(d.filter(F.col("timestamp").isNotNull() & F.col("value").isNotNull()), start, end)


# -- fundamentals and events -----------------------------------------------------------------------------
# Reporting concept to metric, in priority order, and form to period.
CONCEPTS = {
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "NetIncomeLoss": "net_income",
    "Assets": "total_assets",
    "Liabilities": "total_liabilities",
    "StockholdersEquity": "stockholders_equity",
    "EarningsPerShareBasic": "eps_basic",
    "EarningsPerShareDiluted": "eps_diluted",
    "OperatingIncomeLoss": "operating_income",
    "GrossProfit": "gross_profit",
    "CashAndCashEquivalentsAtCarryingValue": "cash_and_equivalents",
    "LongTermDebt": "long_term_debt",
    "CommonStockSharesOutstanding": "shares_outstanding",
}
FORM_PERIOD = {"10-K": "annual", "10-Q": "quarterly", "8-K": "current"}


def company_facts(raw: DataFrame, forms: Sequence[str], start: str, end: str, payload: str = "payload", keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Nested facts to (report_date, period_type, metric_name, value); the first entry in source order wins."""
    entry = "struct<val double, form string, filed string>"
    j = F.from_json(F.col(payload), f"facts struct<`us-gaap` map<string, struct<units map<string, array<{entry}>>>>>")
    d = raw.select(*keys, F.explode(j["facts"]["us-gaap"]).alias("concept", "c"))
    metric = pick([(F.col("concept") == k, v) for k, v in CONCEPTS.items()], F.lit(None).cast("string"))
    rank = pick([(F.col("concept") == k, i) for i, k in enumerate(CONCEPTS)], F.lit(None).cast("int"))
    d = d.withColumn("metric_name", metric).withColumn("_k", rank).filter(F.col("_k").isNotNull())
    d = d.select(*keys, "metric_name", "_k", F.posexplode(F.map_entries("c.units")).alias("_u", "u"))
    d = d.select(*keys, "metric_name", "_k", "_u", F.col("u.key").alias("unit"), F.posexplode("u.value").alias("_e", "e"))
    form = F.upper("e.form")
    d = d.withColumn("form", form).withColumn("report_date", F.col("e.filed").try_cast("date"))
    d = d.filter(F.col("form").isin([f.upper() for f in forms]) & (F.col("report_date") >= F.lit(start).cast("date")) & (F.col("report_date") < F.lit(end).cast("date")))
    d = d.withColumn("period_type", pick([(F.col("form") == k, v) for k, v in FORM_PERIOD.items()], "other"))
    dedup = [*keys, "metric_name", "report_date", "period_type"]
    first = d.groupBy(*dedup).agg(F.min_by(F.struct(F.col("e.val").alias("value"), "unit"), F.struct("_k", "_u", "_e")).alias("x"))
    return first.select(*dedup, F.col("x.value").alias("value"), F.when(F.col("x.unit") != "shares", F.col("x.unit")).alias("currency"))


def filing_events(raw: DataFrame, form: str = "8-K", start: str | None = None, end: str | None = None, payload: str = "payload", keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Parallel arrays of filings to corporate events of one form."""
    j = F.from_json(F.col(payload), "filings struct<recent struct<accessionNumber array<string>, filingDate array<string>, form array<string>>>")
    d = raw.select(*keys, j["filings"]["recent"].alias("r"))
    d = d.select(*keys, F.explode(F.arrays_zip("r.accessionNumber", "r.filingDate", "r.form")).alias("f"))
    d = d.select(
        *keys,
        F.col("f.filingDate").try_cast("date").alias("event_date"),
        F.lit("filing_" + form.lower().replace("-", "")).alias("event_type"),
        F.to_json(F.struct(F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession_number"))).alias("details"),
        F.col("f.form").alias("_f"),
    ).filter(F.col("_f") == form)
    return _clip(d.drop("_f"), start, end, "event_date")


# Statement and ratio fields to metric names, and period codes.
STATEMENT_FIELDS = {
    "Revenue": "revenue",
    "Net Income": "net_income",
    "Total Assets": "total_assets",
    "Total Liabilities": "total_liabilities",
    "Total Equity": "stockholders_equity",
    "Earnings Per Share, Basic": "eps_basic",
    "Earnings Per Share, Diluted": "eps_diluted",
    "Operating Income (Loss)": "operating_income",
    "Gross Profit": "gross_profit",
    "Cash, Cash Equivalents & Short Term Investments": "cash_and_equivalents",
    "Long Term Debt": "long_term_debt",
    "Shares (Basic)": "shares_outstanding",
}
RATIO_FIELDS = {
    "Return on Equity": "roe",
    "Return on Assets": "roa",
    "Gross Profit Margin": "gross_margin",
    "Operating Margin": "operating_margin",
    "Net Profit Margin": "net_margin",
    "Current Ratio": "current_ratio",
    "Debt / Equity": "debt_to_equity",
    "Price / Earnings Ratio": "pe_ratio",
    "Price / Book Value": "pb_ratio",
    "Dividend Yield": "dividend_yield",
}
PERIODS = {"FY": "annual", "Q1": "quarterly", "Q2": "quarterly", "Q3": "quarterly", "Q4": "quarterly", "H1": "semi_annual", "H2": "semi_annual"}


def period_type(code: Column) -> Column:
    return pick([(F.upper(code) == k, v) for k, v in PERIODS.items()], "annual")


def unpivot_statements(wide: DataFrame, keys: Sequence[str], fields: Mapping[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Wide statements (report_date, period_type, one column per field) to one row per present metric."""
    have = {f: m for f, m in fields.items() if f in wide.columns}
    base = wide.withColumn("period_type", F.coalesce(F.col("period_type") if "period_type" in wide.columns else F.lit(None).cast("string"), F.lit("annual")))
    ids = [*keys, "report_date", "period_type"]
    vals = [F.col(f"`{f}`").cast("double").alias(m) for f, m in have.items()]
    t = base.select(*ids, *vals).unpivot(ids, list(dict.fromkeys(have.values())), "metric_name", "value")
    return _clip(t.filter(F.col("value").isNotNull()), start, end, "report_date")


# Release clock (UTC) per series.
RELEASE_TIMES = {
    "PAYEMS": (12, 30),
    "CPIAUCSL": (12, 30),
    "CPILFESL": (12, 30),
    "GDP": (12, 30),
    "RSAFS": (12, 30),
    "NAPM": (14, 0),
    "ICSA": (12, 30),
    "UMCSENT": (14, 0),
}


def release_calendar(releases: DataFrame, event_type: str = "event_type", start: str | None = None, end: str | None = None, default: tuple[int, int] = (12, 30), times: Mapping[str, tuple[int, int]] = RELEASE_TIMES) -> DataFrame:
    """Distinct release dates per series at the series' usual time of day."""
    minutes = pick([(F.col("series_id") == k, h * 60 + m) for k, (h, m) in times.items()], default[0] * 60 + default[1])
    d = releases.select("series_id", event_type, "impact_score", F.to_date("release_date").alias("d")).dropDuplicates(["series_id", "d"])
    t = F.timestamp_micros(F.unix_micros(F.col("d").cast("timestamp")) + minutes.cast("long") * 60_000_000)
    return _clip(d.select("series_id", event_type, "impact_score", t.alias("scheduled_time")), start, end, "scheduled_time")
