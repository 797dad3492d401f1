"""Streams give what batches give; replays and compaction change nothing."""

import datetime as dt
import random
from collections import Counter

import pytest

from taskframe import schemas
from taskframe.operators import state, transitions
from taskframe.session import scratch_dir
from taskframe.sources import commits
from taskframe.sources.tables import table
from taskframe.streaming import state as streams
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, SF_DIR, "completion_rows").withColumns({
        "schema": F.lit("v1"), "trace_id": F.lit(None).cast("string")})


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_stream_state(spark, rows):
    landing, base = scratch_dir(spark, "landing"), scratch_dir(spark, "state")
    rows.repartition(3).write.parquet(landing)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    seen = []
    streams.stream_upsert(
        source, base, scratch_dir(spark, "progress"),
        after_writes=lambda batch, n: seen.append((n, batch.count()))).awaitTermination()
    assert len(seen) == 3 and sum(n for _, n in seen) == rows.count()

    expected = state.apply_completions(rows)
    assert same(streams.read_state(spark, base, "tasks"), expected.tasks)
    assert same(streams.read_state(spark, base, "results"), expected.results)

    # Half-written folders of another attempt are not seen.
    streams.read_state(spark, base, "tasks").limit(3).write.parquet(f"{base}/tasks/half-written")
    assert same(streams.read_state(spark, base, "tasks"), expected.tasks)
    before = {e.folder for e in commits.live(spark, base)}
    streams.compact(spark, base)
    after = commits.live(spark, base)
    assert {e.name for e in after} == set(streams.TABLES) and len(after) == 3
    assert same(streams.read_state(spark, base, "tasks"), expected.tasks)
    assert same(streams.read_state(spark, base, "results"), expected.results)
    assert commits.expire(spark, base) == len(before) == 9
    assert same(streams.read_state(spark, base, "tasks"), expected.tasks)
    streams.compact(spark, base)
    assert same(streams.read_state(spark, base, "jobs"), state.upsert_jobs(
        rows.withColumns({"status": F.lit("QUEUED"), "attrs": F.lit("{}")})))


def test_failed_batch_is_not_seen_and_runs_again(spark, rows):
    landing, base, progress = (scratch_dir(spark, n) for n in ("landing", "state", "progress"))
    rows.repartition(2).write.parquet(landing)

    def run(after_writes):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        query = streams.stream_upsert(source, base, progress, after_writes=after_writes)
        query.awaitTermination()

    def stop(batch, n):
        if n == 1:
            raise RuntimeError("stopped before the commit")

    with pytest.raises(Exception, match="stopped before the commit"):
        run(stop)
    assert len(commits.live(spark, base, "tasks")) == 1
    part = streams.read_state(spark, base, "tasks").agg(F.count("*"), F.max("last_seq")).first()
    # The rest of the state is as consistent: no job of the unseen batch.
    assert part[0] < state.apply_completions(rows).tasks.count()
    run(None)
    assert same(streams.read_state(spark, base, "tasks"), state.apply_completions(rows).tasks)
    # The first batch under its number again, as after a lost offset: passed over.
    id = commits.live(spark, base, "tasks")[0].id
    streams.write_state(spark, base, id, streams.fold_batch(rows.limit(5)))
    assert len(commits.live(spark, base, "tasks")) == 2


def test_batches_go_on_during_compaction(spark, rows):
    base = scratch_dir(spark, "state")
    commits.create(spark, base)
    half = F.col("seq") % 2 == 0
    streams.write_state(spark, base, "a", streams.fold_batch(rows.where(half)))
    covered = commits.live(spark, base)
    streams.write_state(spark, base, "b", streams.fold_batch(rows.where(~half)))
    monkey = pytest.MonkeyPatch()
    whole = commits.live
    monkey.setattr(commits, "live", lambda s, b, name=None: covered if name is None else whole(s, b, name))
    streams.compact(spark, base)
    monkey.undo()
    assert {e.id for e in commits.live(spark, base, "tasks")} == {"b", *(
        e.id for e in commits.live(spark, base) if e.id.startswith("base-"))}
    assert same(streams.read_state(spark, base, "tasks"), state.apply_completions(rows).tasks)


def test_purge_hides_what_came_before(spark, rows):
    base = scratch_dir(spark, "state")
    commits.create(spark, base)
    jobs = sorted({r.job_id for r in rows.select("job_id").distinct().collect()})
    gone = spark.createDataFrame([(jobs[0],), (jobs[1],), ("unknown",)], "job_id string")
    back = rows.where(F.col("job_id") == jobs[1])
    streams.write_state(spark, base, "a", streams.fold_batch(rows))
    streams.purge(spark, base, "p", gone)
    streams.write_state(spark, base, "b", streams.fold_batch(back.where("seq % 2 = 0")))
    want = state.apply_completions(rows.where(~F.col("job_id").isin(*jobs[:2]))).tasks.unionByName(
        state.apply_completions(back.where("seq % 2 = 0")).tasks)
    assert same(streams.read_state(spark, base, "tasks"), want)
    streams.compact(spark, base)
    assert same(streams.read_state(spark, base, "tasks"), want)
    assert commits.live(spark, base, streams.PURGED) == []
    streams.purge(spark, base, "q", gone)
    assert streams.read_state(spark, base, "tasks").where(F.col("job_id").isin(*jobs[:2])).count() == 0
    empty = scratch_dir(spark, "state")
    commits.create(spark, empty)
    assert streams.read_state(spark, empty, "tasks", schemas.tasks()).count() == 0


def random_moves(spark, n=400):
    rng = random.Random(4)
    rows = [("j", "A", f"S{rng.randint(0, 6)}", rng.choice(["STARTED", "RETRIED", "SUCCEEDED", "FAILED", "ODD"]), i,
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"E{i}") for i in range(n)]
    rows += [("j", "A", "hot", "RETRIED", i, dt.datetime(2024, 1, 1), None) for i in range(5000, 12000)]
    return rows, "job_id string, step string, task_id string, status string, seq long, ts timestamp_ntz, error_code string"


def test_transitions_in_any_order(spark):
    rows, kind = random_moves(spark)
    whole = spark.createDataFrame(rows, kind)
    moves, retries = transitions.fold_moves(whole), transitions.fold_retries(whole)
    hot = retries.where("task_id = 'hot'").collect()
    assert [(s.lo, s.hi) for r in sorted(hot, key=lambda r: r.block) for s in r.spans] == [
        (max(5000, b * 1024), min(11999, b * 1024 + 1023)) for b in range(4, 12)]
    rng = random.Random(1)
    for _ in range(2):
        again = rows + rng.choices(rows, k=300)
        rng.shuffle(again)
        parts = [spark.createDataFrame(again[i::3], kind) for i in range(3)]
        folded = [transitions.fold_moves(p) for p in parts]
        assert same(transitions.merge_moves(folded[2].union(folded[0]).union(folded[1]).union(folded[0])), moves)
        folded = [transitions.fold_retries(p) for p in parts]
        assert same(transitions.merge_retries(folded[1].union(folded[2]).union(folded[0]).union(folded[2])), retries)
    counts = {r.task_id: r.retries for r in transitions.retry_counts(retries).collect()}
    want = Counter(r[2] for r in rows if r[3] == "RETRIED")
    assert counts == dict(want)


def test_state_rows_take_late_transitions(spark):
    rows, kind = random_moves(spark, 60)
    rows = [r for r in rows if r[2] != "hot"]
    base = spark.createDataFrame(
        [("j", "A", f"S{k}", "QUEUED", 1, dt.datetime(2023, 1, 1), 20) for k in range(7)],
        "job_id string, step string, task_id string, status string, retry_count int, updated_at timestamp_ntz, last_seq long")
    once = state.task_state(base, spark.createDataFrame(rows, kind))
    late = state.task_state(state.task_state(base, spark.createDataFrame(rows[30:], kind)),
                            spark.createDataFrame(rows[:35], kind))
    def facts(df):
        return sorted(map(str, df.withColumn("seen", F.array_sort("seen.retries")).collect()))
    assert facts(once) == facts(late)
    jobs = spark.createDataFrame([("j", "QUEUED", dt.datetime(2023, 1, 1), None)],
                                 "job_id string, status string, updated_at timestamp_ntz, status_seq long")
    updates = spark.createDataFrame(
        [("j", s, i, dt.datetime(2024, 1, i)) for i, s in enumerate(["RUNNING", "SUCCEEDED"], 1)],
        "job_id string, status string, seq long, ts timestamp_ntz")
    done = state.job_state(jobs, updates)
    assert done.first().status == "SUCCEEDED"
    assert done.collect() == state.job_state(done, updates.where("seq = 1")).collect()
