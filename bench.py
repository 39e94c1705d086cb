"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
``queries`` holds the wall seconds of one run whose rows all come to the driver, as in
the same query written to Spark's noop sink, which is the work a cluster would do.
Every query runs once, untimed, on the smallest tables first, so that class loading
and compilation are not counted.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import local_session  # noqa: E402
from checks.registry import queries  # noqa: E402

HEADLINE = [
    "failure_rate_by_machine_type",
    "failure_trends_monthly",
    "sensor_trends_hourly_failed_machines",
    "fleet_overview",
    "machine_status",
    "failure_records_enriched",
    "maintenance_backlog",
    "maintenance_impact",
    "cost_benefit",
    "failure_probability_by_temperature",
    "vibration_heatmap",
    "operational_machine_count",
    "maintenance_page_counts",
    "health_indicators_recent",
    "failure_probability_by_days_since_maintenance",
    "maintenance_cost_monthly",
    "temperature_anomaly_impact",
    "pressure_trend_latest_day",
    "anomaly_hourly",
    "machine_status_page",
    "etl_machines_upsert",
    "etl_health_indicators",
    "etl_failure_trends",
    "scoring_requests_checked",
    "prepared_features",
    "evaluation_report",
    "evaluation_roc_curve",
    "stream_sensor_hourly",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    known = queries()
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        known[name](spark, smallest if os.path.isdir(smallest) else sf_dir).collect()
    collected, no_output = {}, {}
    for name in HEADLINE:
        query = known[name]
        collected[name] = timed(lambda: query(spark, sf_dir).toArrow())
        no_output[name] = timed(
            lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    result = {
        "metric": "headline queries, sum of times with all rows moved to the driver",
        "value": round(sum(collected.values()), 3),
        "unit": "sec",
        "queries": collected,
        "no_output": no_output,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
