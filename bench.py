"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom import catalog  # noqa: E402
from tickloom.session import build_session  # noqa: E402

HEADLINE = (
    "order_flow_book",
    "order_flow_trade",
    "cvd_kyle",
    "recent_microstructure",
    "session_vwap",
    "vpin_buckets",
    "bars_multi_timeframe",
    "har_features",
    "rough_vol_features",
    "rsi",
    "bollinger",
    "barrier_labels",
    "sample_weights",
    "asof_join_strict",
    "tick_quality_issues",
    "bar_quality_split",
    "trade_equity_curve",
    "risk_ratios",
    "span_uniqueness",
    "order_screening",
    "gex_features",
    "combinatorial_splits",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    n_ticks = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # also starts the executors
    times, rates = {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    for name in ("order_flow_book", "order_flow_trade", "cvd_kyle"):
        rates[name] = round(n_ticks / times[name])
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "ticks_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
