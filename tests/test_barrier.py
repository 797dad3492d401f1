"""Join steps released from streams."""

import datetime as dt

import pytest

from taskframe.sources import commits
from taskframe.sources.dag import Dag
from taskframe.streaming import barrier, state

SCHEMA = "job_id string, step string, task_id string, ts timestamp_ntz, status string"
T0 = dt.datetime(2024, 1, 1)
STEP = "VIDEO_GENERATION"


def event(job, task, status="SUCCEEDED", hour=0, step=STEP):
    return job, step, task, T0 + dt.timedelta(hours=hour), status


class Stream:
    def __init__(self, spark, folder, siblings):
        self.spark, self.folder = spark, folder
        self.expected = spark.createDataFrame([(j, STEP, n) for j, n in siblings.items()], "job_id string, step string, siblings int")
        self.base = str(folder / "base")

    def take(self, rows, **options):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        barrier.stream_barrier(stream, self.expected, Dag.default(), self.base, str(self.folder / "progress"), **options).awaitTermination()

    def released(self):
        return sorted(tuple(r) for r in barrier.read_released(self.spark, self.base).select(
            "job_id", "step", "task_id", "siblings").collect())

    def kept(self):
        """Release rows of all commits, unmerged."""
        return commits.read(self.spark, self.base, "released").count()


def test_each_join_step_is_released_once(spark, tmp_path):
    s = Stream(spark, tmp_path, {"a": 2, "b": 2, "n": 1})
    s.take([event("a", "S0"), event("a", "S0"), event("b", "S1"), event("b", "S0", "FAILED"), event("c", "S0"),
            event(None, "S0"), event("n", None), event("a", "S9", step="ANALYSIS")])
    assert s.released() == []
    # A success counts for good, whatever comes after it.
    s.take([event("a", "S1"), event("a", "S0", "RETRIED", 5)])
    assert s.released() == [("a", "STITCH", "S0", 2)]
    state.compact(spark, s.base)
    s.take([event("a", "S0"), event("a", "S7"), event("b", "S0", hour=9)])
    s.take([event("a", "S1")])
    assert s.released() == [("a", "STITCH", "S0", 2), ("b", "STITCH", "S0", 2)]
    assert s.kept() == 2


def test_half_written_batches_release_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path, {"a": 1})

    def fail(batch, batch_id):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        s.take([event("a", "S0")], after_writes=fail)
    assert s.released() == []
    s.take([event("z", "S0")])
    assert s.released() == [("a", "STITCH", "S0", 1)] and s.kept() == 1


def test_stalled_groups(spark, tmp_path):
    s = Stream(spark, tmp_path, {"a": 2, "b": 1, "c": 3, "d": 2})
    s.take([event("a", "S0", hour=1), event("b", "S0"), event("d", "S0", hour=30)])
    got = {(r.job_id, r.done, r.siblings) for r in barrier.stalled(
        spark, s.base, s.expected, T0 + dt.timedelta(hours=24)).collect()}
    assert got == {("a", 1, 2), ("c", 0, 3)}
