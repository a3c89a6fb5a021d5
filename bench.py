"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from delaycohorts.plans import queries
from delaycohorts.session import local_session

HEADLINE = (
    "clean_flights", "quality_by_source", "refresh_history", "exact_periods", "pattern_exclusions", "route_stability",
    "schedule_stability", "operating_patterns", "reconstruction_accuracy", "lookup_flights", "stratified_weights",
    "normalize_payloads", "flag_secrets", "connection_probability",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries.registered()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
