"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.plans import load_all
from barloom.plans.base import REGISTERED
from barloom.session import local_session

HEADLINE = ["bars_daily", "a5_panel", "j2_volume_spike", "j1_amount_spike", "j3_range_breakout",
            "f1_sma", "f5_rsi", "f6_macd", "f18_adjusted_prices", "c13_eligible_symbols", "d1_as_of",
            "d3_profit_streak", "c14_verdicts", "j9_quality_checks", "e17_downsample",
            "k12_partial_trades", "e5_performance"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    load_all()
    REGISTERED["bars_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
