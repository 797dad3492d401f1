"""The contract audit: one pass over each input, one shuffle, every check by hand."""

import re

from taskframe.operators import audit

TASKS = "job_id string, step string, task_id string, status string, step_prefix string"


def frames(spark, tasks=(), events=(), paths=(), children=()):
    return (spark.createDataFrame(list(tasks), TASKS),
            spark.createDataFrame(list(events), "job_id string, step string, task_id string, status string"),
            spark.createDataFrame([(p,) for p in paths], "path string"),
            spark.createDataFrame(list(children), "job_id string, step string, task_id string, input_uri string, params string"))


def counts(df):
    return {r.check_name: (r.checked, r.failed) for r in df.collect()}


def test_checks(spark):
    x, y = "s3://w/x/", "s3://w/y/"
    got = counts(audit.contract_audit(*frames(
        spark,
        [("a", "X", "S0", "SUCCEEDED", x), ("a", "X", "S1", "SUCCEEDED", x), ("a", "X", "t", "SUCCEEDED", x),
         ("b", "Y", "u", "SUCCEEDED", y), ("b", "Y", "v", "SUCCEEDED", y), ("b", "Y", "S9", "CANCELLED", y),
         ("c", "Y", "S0", "STARTED", y), ("c", "Y", "S1", "CANCELLED", y), ("d", "X", "S0", "QUEUED", x),
         ("e", "X", "S3", "STARTED", x), ("e", "X", "S4", "DLQ", x), ("f", "X", "z", "SUCCEEDED", None)],
        [("a", "X", "S0", "SUCCEEDED")] * 2 + [("a", "X", "S0", "FAILED"), ("b", "Y", "u", "SUCCEEDED"), (None, "Y", "u", "SUCCEEDED")],
        [x + "S0/result.png", x + "S0/result.png", x + "metrics.json", "metrics.json", y + "S9/result.png", None, ""],
        [("a", "X", "S0", "u", "1"), ("a", "X", "S0", "u", "1"), ("a", "X", "S1", "u", "1"), ("a", "X", "S1", "u", "2"),
         ("a", "X", "S2", None, "1"), ("a", "X", "S2", "u", "1"), ("b", "X", "S1", "u1", "1"), ("b", "X", "S1", "u", "11")])))
    assert got == {
        # S1 has no result; u, v have neither a step result nor metrics; z has no prefix.
        "result_present": (6, 4), "metrics_present": (3, 2), "no_repeated_work": (3, 1),
        # a S2 has one child that can be compared.
        "child_ids_unique": (4, 2),
        # a succeeded, b was cancelled in part, e failed; c and d go on, f succeeded.
        "job_finished": (6, 2)}


def test_nothing_to_check(spark):
    assert counts(audit.contract_audit(*frames(spark))) == {name: (0, 0) for name in audit.CHECKS}


def test_one_shuffle_and_one_pass(spark, tmp_path):
    kinds = frames(spark)
    stored = []
    for i, df in enumerate(kinds):
        df.write.parquet(f"{tmp_path}/{i}")
        stored.append(spark.read.parquet(f"{tmp_path}/{i}"))
    df = audit.contract_audit(*stored)
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert len(re.findall(r"Exchange (?:hash|Single)", initial)) == 2
    assert len(re.findall("FileScan parquet", initial)) == 4
    assert "Join" not in initial and "SortAggregate" not in initial
