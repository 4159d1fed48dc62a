"""Time the headline queries and print one JSON line.

Each query is run three times in one session and its median is reported; the total
is the sum of the medians. Results are written to the no-op sink, so that every row
and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from clustrial.checks.queries import QUERIES
from clustrial.session import local_session

HEADLINE = [
    "measure_region_month",
    "measure_all_single_scan",
    "period_region_rates",
    "pct_rank_min",
    "avg_rank_by_group",
    "allocate_all_practices",
    "allocate_seeded",
    "arm_summary_change",
    "top3_per_cluster_rate",
    "ols_primary_cost",
    "ols_by_measure",
    "ols_order_lines",
    "describe_percentiles",
    "histogram_bins",
    "winsorise_upper",
    "event_window_views",
    "event_window_alerts",
    "report_flatten",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
