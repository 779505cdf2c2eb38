"""Time the headline queries: one cold run to warm up, then the median of three.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores),
BENCH_QUERIES (comma-separated names, default the headline set). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.registry import queries  # noqa: E402
from faultline.session import build_session  # noqa: E402

HEADLINE = [
    *[f"q{i:02d}" for i in range(1, 20)],
    "q08_dedup", "q11_exact", "q13_all",
    "w_percent_rank", "w_row_number", "w_first_per_key", "a_median", "a_histogram",
    "plot_q02c", "plot_q05b", "plot_q10c", "plot_q16",
    "ml_ols_injuries", "ml_logit_recalls",
]
RUNS = 3


def timed(query, spark, root: str) -> float:
    start = time.perf_counter()
    query(spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(cores)
    registry = queries()
    seconds = {}
    for name in names:
        timed(registry[name], spark, root)
        seconds[name] = round(statistics.median(timed(registry[name], spark, root) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of 3 warm runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(root).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
