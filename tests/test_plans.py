"""Plans stay free of shapes that do not scale."""

import pytest

from taskframe.plans.registry import all_jobs

SF_DIR = "/root/testdata/sf0.001"
JOBS = {n: j for n, j in all_jobs().items()
        if not n.startswith(("stream_", "scan_", "object_", "log_scan"))}
PYTHON_JOBS = {"apply_hook", "hook_artifacts", "hook_children"}
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
       "CollectLimit", "Scan ExistingRDD")


@pytest.mark.parametrize("name", list(JOBS))
def test_plan_shape(spark, name):
    df = JOBS[name].run(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [b for b in BAD if b in plan] == []
    assert ("MapInArrow" in plan) == (name in PYTHON_JOBS)
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:]):
        # Only partial aggregates of a whole table may meet in one task.
        if "Exchange SinglePartition" in above:
            assert "HashAggregate(keys=[]" in below or "SortAggregate(key=[]" in below
