"""Headline queries, wall seconds each; prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local width. One warm-up run
of the bar view, then the median of BENCH_RUNS runs (default 1) per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans.catalog import load  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = (
    "bars_daily",
    "bars_from_ticks",
    "resample_month",
    "ind_ma",
    "ind_macd_sma",
    "ind_adx",
    "ind_vote",
    "feature_table",
    "screening_facts",
    "signal_rule",
    "change_rank_stocks",
    "change_daily_counts",
    "asof_latest",
    "point_in_time",
    "factor_ic",
    "factor_preprocess",
    "barrier_backtest",
    "performance_metrics",
    "portfolio_risk",
    "fifo_positions",
    "chip_distribution",
    "news_sentiment",
    "exact_median",
    "fifo_rows",
    "sector_flow_series",
    "factor_external",
    "data_quality",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    spark = local_session("bench", cpus=cpus, shuffle=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()

    def once(name: str) -> float:
        t0 = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    once("bars_daily")
    picked = [n for n in (sys.argv[1:] or HEADLINE) if n in registry]
    seconds = {n: round(statistics.median(once(n) for _ in range(runs)), 3) for n in picked}
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
