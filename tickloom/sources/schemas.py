"""Table schemas: exact decimals in storage, doubles in features."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE, STEP, SHARE = "decimal(20,8)", "decimal(20,10)", "decimal(5,4)"


def _schema(ddl: str) -> T.StructType:
    out = T.StructType()
    for part in ddl.split(";"):
        name, kind = part.split()
        out = out.add(name, _TYPES[kind])
    return out


_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "price": T.DecimalType(20, 8),
    "step": T.DecimalType(20, 10),
    "share": T.DecimalType(5, 4),
}

ASSETS = _schema("asset_id string;symbol string;exchange string;asset_class string;currency string;timezone string;tick_size step;lot_size step;is_active boolean;listing_date date;delisting_date date;metadata string")
BARS = _schema("asset_id string;bar_type string;bar_size string;timestamp timestamp;open price;high price;low price;close price;volume price;trade_count long;vwap price;adj_close price")
TICKS = _schema("asset_id string;timestamp timestamp;trade_id string;price price;quantity price;side string")
BOOK = _schema("asset_id string;timestamp timestamp;depth_level int;bid_price price;bid_size price;ask_price price;ask_size price")
MACRO = _schema("series_id string;timestamp timestamp;value double")
MACRO_META = _schema("series_id string;source string;name string;frequency string;unit string;description string")
FUNDAMENTALS = _schema("asset_id string;report_date date;period_type string;metric_name string;value double;currency string")
CORPORATE_EVENTS = _schema("event_id string;asset_id string;event_date date;event_type string;details string")
ECONOMIC_EVENTS = _schema("event_id string;event_type string;scheduled_time timestamp;actual double;consensus double;prior double;impact_score int;source string")
QUALITY_LOG = _schema("check_id string;check_type string;severity string;asset_id string;timestamp timestamp;details string")
FEATURE_VALUES = _schema("symbol string;feature string;version string;timestamp timestamp;value double;computed_at timestamp")
FEATURE_VERSIONS = _schema("symbol string;feature string;version string;computed_at timestamp;content_hash string;row_count long;start_ts timestamp;end_ts timestamp")
TRADES = _schema("trade_id string;strategy_id string;symbol string;direction string;entry_time timestamp;exit_time timestamp;entry_price price;exit_price price;size price;gross_pnl price;net_pnl price;commission price;slippage_cost price;signal_type string;regime string;session string;exit_reason string;confidence share")

# Allowed values of coded columns.
ENUMS = {
    "bar_type": ("time", "tick", "volume", "dollar"),
    "bar_size": ("1m", "5m", "15m", "1h", "4h", "1d", "1w", "1M"),
    "side": ("buy", "sell", "unknown"),
    "severity": ("pass", "warn", "fail"),
}
