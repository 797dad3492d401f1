"""Runs over messages: bounded hook output, outcomes, and one commit."""

import json

import pytest
from pyspark.sql import functions as F

from taskframe.operators import hooks, runs
from taskframe.session import scratch_dir
from taskframe.sources import commits
from taskframe.sources.dag import Dag

MESSAGE = ("message_id string, job_id string, step string, task_id string, user_id string, schema string, input_uri string, "
           "output_prefix string, params string, retry_count bigint, trace_id string, parent_task_id string")


def messages(spark, *rows, step="ENHANCEMENT"):
    return spark.createDataFrame(
        [(m, "j", step, t, "u", "v1", "", f"s3://work/u/j/{step}/{t}/", params, 0, None, None) for m, t, params in rows], MESSAGE)


class Wide(hooks.Hook):
    """Puts out `n` megabytes, one at a time, and then fails if told so."""

    def emit(self, model, message):
        for i in range(message["params"].get("n", 0)):
            yield hooks.Artifact(bytes([i % 256]) * (1 << 20), "files", f"{i}.txt", file_pos=i)
        for i in range(message["params"].get("children", 0)):
            yield hooks.Child({"i": i})
        if message["params"].get("fail"):
            raise ValueError("late \ud800")
        if "odd" in message["params"]:
            yield hooks.Artifact(b"x", "files", {"int": 5, "half": "\ud800"}[message["params"]["odd"]])


def work_off(spark, rows, hook=None, base=None, id="run", **more):
    base = base or scratch_dir(spark, "run")
    runs.run_messages(rows, hook or Wide(), Dag.default(), "work", base, id, **more)
    return base


def test_outputs_beyond_the_bound_leave_in_parts(spark):
    """64 MB of one message in batches of 4 MB: the last batch holds the closing row."""
    df = messages(spark, ("a", "S0", '{"n": 64}')).withColumn("step_prefix", F.lit("s3://work/u/j/ENHANCEMENT/"))
    sizes = []
    source = iter([df.toArrow().to_batches()[0]])
    made = {}

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            made["run"] = run

    hooks.stream_hook(Frame(), Wide(), flush_bytes=4 << 20)
    for batch in made["run"](source):
        sizes.append(sum(len(c or b"") for c in batch.column("content").to_pylist()))
    assert max(sizes) <= 4 << 20 and sum(sizes) == 64 << 20 and len(sizes) == 17


def test_failures_keep_nothing(spark):
    base = work_off(spark, messages(
        spark, ("a", "S0", '{"n": 3, "children": 2}'), ("b", "S1", '{"n": 5, "children": 3, "fail": 1}'),
        ("c", "S2", '{"odd": "int"}'), ("d", "S3", '{"odd": "half"}'), ("e", "S4", "{}"), ("f", "S5", "nope")), flush_bytes=1 << 20)
    got = {r.message_id: r for r in runs.read_outcomes(spark, base).collect()}
    assert {m: r.status for m, r in got.items()} == {
        "a": "SUCCEEDED", "b": "FAILED", "c": "FAILED", "d": "FAILED", "e": "SUCCEEDED", "f": "FAILED"}
    assert got["b"].error_message == "late ?" and got["b"].n_artifacts == 5
    stored = runs.read_artifacts(spark, base).collect()
    assert sorted(r.uri for r in stored) == [f"s3://work/u/j/ENHANCEMENT/S0/{i}.txt" for i in range(3)]
    assert all(len(r.content) == 1 << 20 for r in stored)
    sent = runs.read_messages(spark, base).collect()
    assert sorted((r.kind, json.loads(r.body)["task_id"]) for r in sent) == [
        ("child", "S0"), ("child", "S1"), ("completion", "S0"), ("completion", "S4")]
    child = json.loads(next(r.body for r in sent if r.kind == "child"))
    assert child["input_uri"] == "s3://work/u/j/ENHANCEMENT/S0/0.txt"
    assert json.loads(next(r.body for r in sent if r.kind == "completion" and '"S4"' in r.body))["primary_result_uri"] is None


def test_size_refused(spark):
    class One(hooks.Hook):
        def process(self, model, message):
            return {"result": b"x" * 11, "aux": {"n.txt": 5}}

    base = work_off(spark, messages(spark, ("a", "S0", "{}")), One(), max_bytes=10)
    row = runs.read_outcomes(spark, base).first()
    assert (row.status, row.error_message, row.n_refused) == ("FAILED", "artifact 0 refused: size", 2)
    assert runs.read_artifacts(spark, base).count() == runs.read_messages(spark, base).count() == 0


def test_hook_runs_once_and_repeats_add_nothing(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted(Wide):
        def emit(self, model, message):
            calls.add(1)
            return super().emit(model, message)

    rows = messages(spark, ("a", "S0", '{"n": 1}'), ("b", "S0", '{"n": 2}'), ("c", "S1", '{"n": 1}'))
    base = work_off(spark, rows, Counted())
    assert calls.value == 2  # one message per task, the first
    work_off(spark, rows, Counted(), base)
    assert calls.value == 2
    assert sorted(r.message_id for r in runs.read_outcomes(spark, base).collect()) == ["a", "c"]
    # A later run of the same task replaces what it writes again.
    work_off(spark, messages(spark, ("a", "S0", '{"n": 2}')), base=base, id="again")
    assert sorted(r.uri[-8:] for r in runs.read_artifacts(spark, base).collect()) == ["S0/0.txt", "S0/1.txt", "S1/0.txt"]


def test_run_killed_before_its_commit_shows_nothing(spark, monkeypatch):
    base = work_off(spark, messages(spark, ("a", "S0", '{"n": 1}')))

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    rows = messages(spark, ("b", "S1", '{"n": 2, "children": 2}'))
    monkeypatch.setattr(commits, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        work_off(spark, rows, base=base, id="second")
    monkeypatch.undo()
    assert runs.read_outcomes(spark, base).count() == runs.read_artifacts(spark, base).count() == 1
    work_off(spark, rows, base=base, id="second")
    assert (runs.read_outcomes(spark, base).count(), runs.read_artifacts(spark, base).count()) == (2, 3)


def test_finished_and_unsendable(spark):
    rows = messages(spark, ("a", "S0", '{"children": 1}'), ("b", "S1", '{"children": 1}'))
    listing = spark.createDataFrame([("s3://work/u/j/ENHANCEMENT/S0/result.png",)], "path string")
    base = work_off(spark, rows, listing=listing)
    assert [r.task_id for r in runs.read_outcomes(spark, base).collect()] == ["S1"]
    base = scratch_dir(spark, "run")
    with pytest.raises(Exception, match="body_too_large"):
        work_off(spark, rows, base=base, max_body=50)
    assert commits.live(spark, base) == []
    empty = work_off(spark, rows.limit(0))
    assert runs.read_messages(spark, empty, "results").count() == 0
    assert runs.read_outcomes(spark, empty).count() == runs.read_artifacts(spark, empty).count() == 0
