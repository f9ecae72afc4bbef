"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlab.plans.queries import queries
from marketlab.session import local_session

HEADLINE = [
    "price_timeseries", "price_timeseries_wide", "liquidity_timeseries", "volume_timeseries",
    "derived_features_go", "price_at", "new_token", "active_token_at", "trailing_windows",
    "active_token_per_event", "time_exit", "trailing_stop", "liquidity_guard", "trade_records",
    "strategy_aggregates", "drawdown_and_streak", "trade_metrics", "sufficiency", "decision",
    "dataset_fingerprint", "merged_events", "append_unique_skip", "decode_swaps",
    "replay_apply", "stream_volume", "stream_new_token",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registered, times = queries(), {}
    # one untimed query starts the executors and loads the classes
    registered["price_derivatives"](spark, path).write.format("noop").mode("overwrite").save()
    for name in only:
        start = time.perf_counter()
        registered[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(path).lstrip("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
