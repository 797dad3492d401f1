"""Time the headline jobs and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_RUNS (1, the median counts).  Every job runs over its whole tables into
the no-op sink, after one unmeasured run.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from taskframe.plans.registry import all_jobs
from taskframe.session import local_session

HEADLINE = (
    "validate_messages", "reject_report", "route_by_step", "normalize_messages",
    "serialize_messages", "uri_parts", "upsert_tasks", "upsert_jobs", "task_state",
    "job_rollup", "join_barrier", "list_tasks", "children_of", "purge_jobs",
    "claim_batch", "queue_stats", "dlq_records", "dedup_messages", "pending_tasks",
    "result_layout", "primary_result", "completions", "fanout_children", "outbox",
    "outbox_batches", "apply_hook", "model_requests", "parse_responses",
    "extract_answers", "call_metrics", "log_latency", "contract_audit",
    "stream_validate", "stream_upsert",
)


def measure(spark, run, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, shuffle_partitions=cpus)
    jobs = all_jobs()
    timings = {}
    for name in only.split(",") if only else HEADLINE:
        measure(spark, jobs[name].run, sf_dir)
        timings[name] = round(statistics.median(
            measure(spark, jobs[name].run, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
