"""Times headline reports; prints one JSON line.

Each report is run once to warm up and then three times; the median counts. A run plans
the report from scratch and writes every row to Spark's no-op sink, so nothing is cached
between runs and no column is pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaarlens.plans import reports  # noqa: E402
from bazaarlens.session import build_session  # noqa: E402

HEADLINE = [
    "dedup_orders",
    "orders_enriched",
    "payments_enriched",
    "monthly_revenue_summary",
    "seller_performance",
    "payment_audit_trail",
    "reconciliation_report",
    "seller_audit_list",
    "channel_scorecard",
    "channel_roi",
    "monthly_channel_trend",
    "cohort_retention_matrix",
    "cohort_ltv_matrix",
    "ab_segment_results",
    "high_velocity_sellers",
    "rapid_repeat_orders",
    "gmv_spikes",
    "fraud_risk_register",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    files = [os.path.join(d, f) for d, _, names in os.walk(directory) for f in names]
    spark = build_session(
        "bazaarlens-bench",
        f"local[{cpus}]",
        input_bytes=sum(map(os.path.getsize, files)),
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bazaarlens-bench-"))
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            reports.run(name, spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
