"""Canonical market-data inputs derived from the provided tables (see FIXTURES.md).

Each view exists twice: as a DataFrame function and, in ``VIEW_SQL``, as the same projection in plain
SQL, which the SQL twins in the catalog use as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import order_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    qty = F.get_json_object("props", "$.k").cast("long") + 1
    price = F.col("value")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 12).cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").alias("seq"),
        price.alias("price"),
        qty.cast("double").alias("quantity"),
        F.when(F.col("event_type").isin("error", "view"), "SELL").otherwise("BUY").alias("side"),
        (price * 0.999).alias("bid"),
        (price * 1.001).alias("ask"),
        (qty + F.col("user_id") % 7).cast("double").alias("bid_size"),
        (qty + F.col("event_id") % 5).cast("double").alias("ask_size"),
    )


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_shipdate")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    row = F.struct(*[c for c in LINE_ORDER if c != "l_suppkey"])  # the whole row is kept once for each end, not key and price
    of = lambda x: F.col(f"{x}.l_extendedprice") / F.col(f"{x}.l_quantity")
    return (
        li.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("timestamp"))
        .agg(F.min(row).alias("_a"), F.max(p).alias("high"), F.min(p).alias("low"), F.max(row).alias("_z"), F.sum("l_quantity").alias("volume"))
        .select("symbol", "timestamp", of("_a").alias("open"), "high", "low", of("_z").alias("close"), "volume")
    )


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    from ..operators.bars import resample

    return resample(ticks(spark, sf_dir), seconds)


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_partkey") % 50 + 75).cast("double").alias("strike"),
        F.when(F.col("l_returnflag") == "R", " Put").otherwise("CALL").alias("option_type"),
        F.col("l_quantity").alias("open_interest"),
        F.col("l_discount").alias("gamma"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("_p"),
    )
    spot = base.groupBy("timestamp").agg(F.avg("_p").alias("spot_price"))
    return base.drop("_p").join(spot, "timestamp").withColumn("expiry", F.date_add(F.to_date("timestamp"), 30))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws(
            "-",
            *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("long").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        ).alias("trade_id"),
        F.col("l_suppkey").alias("symbol"),
        F.col("o_orderpriority").alias("strategy_id"),
        F.least("o_orderdate", "l_shipdate").cast("timestamp").alias("entry_time"),
        F.greatest("o_orderdate", "l_shipdate").cast("timestamp").alias("exit_time"),
        F.when(F.col("l_linenumber") % 3 == 0, "short").otherwise("long").alias("direction"),
        price.alias("entry_price"),
        (price * (1 + F.col("l_discount") - F.col("l_tax"))).alias("exit_price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("net_pnl"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("gross_pnl"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
        F.col("l_returnflag").alias("regime"),
        F.col("l_linestatus").alias("session"),
        F.col("o_orderstatus").alias("signal_type"),
    )


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cu, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.join(cu, o.o_custkey == cu.c_custkey)
        .join(n, cu.c_nationkey == n.n_nationkey)
        .groupBy(F.col("n_name").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
        .agg(F.sum("o_totalprice").alias("value"))
    )


def economic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderkey") % 100 == 0, "cpi").otherwise("rate_decision").alias("event_type"),
        F.col("o_orderdate").cast("timestamp").alias("scheduled_time"),
        F.round(F.col("o_totalprice") / 1000, 2).alias("actual"),
        F.round(F.col("o_totalprice") / 1000 - F.col("o_orderkey") % 7 + 3, 2).alias("consensus"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("impact_score"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("asset_id"),
            F.col("s_name").alias("symbol"),
            F.col("r_name").alias("exchange"),
            F.when(F.col("s_suppkey") % 3 == 0, "crypto")
            .when(F.col("s_suppkey") % 3 == 1, "equity")
            .otherwise("forex")
            .alias("asset_class"),
            F.lit("1996-01-01").cast("date").alias("listing_date"),
        )
    )


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select(
        F.col("seq").alias("order_id"),
        "symbol",
        "timestamp",
        "price",
        F.col("price").alias("entry"),
        (F.col("price") * 0.98).alias("stop_loss"),
        (F.col("price") * F.when(F.col("seq") % 2 == 0, 1.03).otherwise(1.02)).alias("target"),
        F.col("quantity").alias("size"),
        F.when(F.col("seq") % 3 == 0, "short").otherwise("long").alias("direction"),
    )


def fundamentals_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("asset_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("report_date"),
        F.when(F.col("p_partkey") % 4 == 0, "annual").when(F.col("p_partkey") % 4 == 1, "quarterly").alias("period_type"),
        F.col("p_size").cast("double").alias("size"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("retail_price"),
    )


# The same projections in plain SQL.
VIEW_SQL = {
    "ticks": """ticks AS (SELECT 'S' || CAST(user_id % 12 AS VARCHAR) AS symbol, ts AS timestamp, event_id AS seq,
      value AS price, q + 0.0e0 AS quantity,
      CASE WHEN event_type IN ('error','view') THEN 'SELL' ELSE 'BUY' END AS side,
      value * 0.999e0 AS bid, value * 1.001e0 AS ask,
      (q + user_id % 7) + 0.0e0 AS bid_size, (q + event_id % 5) + 0.0e0 AS ask_size
      FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) + 1 AS q FROM events))""",
    "bars_1d": """bars_1d AS (SELECT l_suppkey AS symbol, l_shipdate AS timestamp,
      first(l_extendedprice / l_quantity ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) AS open,
      max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
      last(l_extendedprice / l_quantity ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) AS close,
      sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)""",
    "bars_1h": """bars_1h AS (SELECT symbol, date_trunc('hour', timestamp) AS timestamp,
      first(price ORDER BY timestamp, seq) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY timestamp, seq) AS close, sum(quantity) AS volume, count(*) AS trade_count
      FROM ticks GROUP BY 1, 2)""",
    "option_chain": """option_chain AS (SELECT l_shipdate AS timestamp, (l_partkey % 50 + 75) + 0.0e0 AS strike,
      CASE WHEN l_returnflag = 'R' THEN ' Put' ELSE 'CALL' END AS option_type, l_quantity AS open_interest,
      l_discount AS gamma, avg(l_extendedprice / l_quantity) OVER (PARTITION BY l_shipdate) AS spot_price FROM lineitem)""",
    "trades": """trades AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
      CAST(round(l_extendedprice * 100) AS BIGINT)) AS trade_id, l_suppkey AS symbol, o_orderpriority AS strategy_id,
      least(o_orderdate, l_shipdate) AS entry_time, greatest(o_orderdate, l_shipdate) AS exit_time,
      CASE WHEN l_linenumber % 3 = 0 THEN 'short' ELSE 'long' END AS direction,
      l_extendedprice / l_quantity AS entry_price, l_extendedprice / l_quantity * (1 + l_discount - l_tax) AS exit_price,
      l_quantity AS size, l_extendedprice * (l_discount - l_tax) AS net_pnl, l_extendedprice * l_discount AS gross_pnl,
      l_extendedprice * l_tax AS commission, l_returnflag AS regime, l_linestatus AS session, o_orderstatus AS signal_type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "macro_series": """macro_series AS (SELECT n_name AS series_id, o_orderdate AS timestamp, sum(o_totalprice) AS value
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
    "economic_events": """economic_events AS (SELECT o_orderkey AS event_id,
      CASE WHEN o_orderkey % 100 = 0 THEN 'cpi' ELSE 'rate_decision' END AS event_type, o_orderdate AS scheduled_time,
      round(o_totalprice / 1000, 2) AS actual, round(o_totalprice / 1000 - o_orderkey % 7 + 3, 2) AS consensus,
      CAST(o_orderkey % 3 + 1 AS INTEGER) AS impact_score FROM orders)""",
    "assets": """assets AS (SELECT s_suppkey AS asset_id, s_name AS symbol, r_name AS exchange,
      CASE s_suppkey % 3 WHEN 0 THEN 'crypto' WHEN 1 THEN 'equity' ELSE 'forex' END AS asset_class,
      DATE '1996-01-01' AS listing_date FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)""",
    "order_candidates": """order_candidates AS (SELECT seq AS order_id, symbol, timestamp, price, price AS entry,
      price * 0.98e0 AS stop_loss, price * CASE WHEN seq % 2 = 0 THEN 1.03e0 ELSE 1.02e0 END AS target, quantity AS size,
      CASE WHEN seq % 3 = 0 THEN 'short' ELSE 'long' END AS direction
      FROM ticks)""",
    "fundamentals_wide": """fundamentals_wide AS (SELECT p_partkey AS asset_id, DATE '2020-01-01' + p_size AS report_date,
      CASE WHEN p_partkey % 4 = 0 THEN 'annual' WHEN p_partkey % 4 = 1 THEN 'quarterly' END AS period_type,
      p_size + 0.0e0 AS size, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS retail_price FROM part)""",
}


def with_views(*names: str) -> str:
    """``WITH ...,`` prefix holding the named views (and what they need), without a trailing comma."""
    order = [n for n in VIEW_SQL if n in names or (n == "ticks" and {"bars_1h", "order_candidates"} & set(names))]
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in order)
