"""Job, task and result state as folds over events.

A state row is a partial fold: the earliest values and the latest values of a
key, with the sequence numbers they came from.  Folding is associative, so
`merge_*` serves a whole table, a micro-batch, and old state joined with new
rows alike, and Spark combines rows ahead of the one shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.operators import transitions as moved
from taskframe.schemas import JOB_KEY, JOB_STATUSES, TASK_KEY, TASK_STATUSES

JOB_FIRST = ("user_id", "schema", "status", "trace_id", "attrs")
TASK_FIRST = ("user_id", "parent_task_id", "parent_step", "input_uri", "output_prefix")
TASK_LAST = ("status", "retry_count", "params", "error_code", "error_message")
RESULT_LAST = ("primary_result_uri", "metrics_uri", "primary_mime", "primary_size_bytes",
               "extra")

STATE_TIMES = ("created_at", "updated_at", "first_seq", "last_seq")
# Set by transitions; no event carries them.
TRANSITION_TIMES = ("started_at", "finished_at")

# Which transitions a state row has seen.
SEEN = "seen"
SEEN_TYPE = ("struct<started:struct<seq:bigint,ts:timestamp_ntz>,finished:struct<seq:bigint,ts:timestamp_ntz>,"
             "failed:struct<seq:bigint,error_code:string,error_message:string>,retries:array<bigint>>")

# A task is over in these states, and a job whose tasks all are is not running.
FINAL_STATUSES = ("SUCCEEDED", "FAILED", "CANCELLED", "DLQ")


class Split(NamedTuple):
    valid: DataFrame
    invalid: DataFrame


class Completed(NamedTuple):
    tasks: DataFrame
    results: DataFrame


def split_by_status(df: DataFrame, statuses: Sequence[str]) -> Split:
    known = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    return Split(df.filter(known), df.filter(~known))


def split_job_statuses(df: DataFrame) -> Split:
    return split_by_status(df, JOB_STATUSES)


def split_task_statuses(df: DataFrame) -> Split:
    return split_by_status(df, TASK_STATUSES)


def _lift(events: DataFrame) -> DataFrame:
    """Every event as a state row of its own."""
    return events.withColumns({
        "first_seq": F.col("seq"), "last_seq": F.col("seq"),
        "created_at": F.col("ts"), "updated_at": F.col("ts")})


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _merge(rows: DataFrame, key: Sequence[str], first: Sequence[str],
           last: Sequence[str]) -> DataFrame:
    first = [*_present(rows, first), "created_at"]
    last = [*_present(rows, last), "updated_at"]
    times = _present(rows, (*TRANSITION_TIMES, SEEN))
    merged = rows.groupBy(*key).agg(
        F.min_by(F.struct(*first), "first_seq").alias("_first"),
        F.max_by(F.struct(*last), "last_seq").alias("_last"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        *[F.max(c).alias(c) for c in times])
    return merged.select(
        *key, "_first.*", "_last.*", "first_seq", "last_seq", *times)


def merge_jobs(rows: DataFrame) -> DataFrame:
    return _merge(rows, JOB_KEY, JOB_FIRST, ())


def merge_tasks(rows: DataFrame) -> DataFrame:
    return _merge(rows, TASK_KEY, TASK_FIRST, TASK_LAST)


def merge_results(rows: DataFrame) -> DataFrame:
    return _merge(rows, TASK_KEY, (), RESULT_LAST)


def upsert_jobs(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Create-or-get: the first event decides every column but `updated_at`."""
    return _upsert(split_job_statuses(events).valid, state, merge_jobs)


def upsert_tasks(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Identity from a task's first event; status, retries, params, errors from its last."""
    return _upsert(split_task_statuses(events).valid, state, merge_tasks)


def upsert_results(saves: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The last save of a task's result wins."""
    return _upsert(saves, state, merge_results)


def _upsert(events: DataFrame, state: DataFrame | None, merge) -> DataFrame:
    """Events folded into a state, which may be a created table without rows."""
    rows = _lift(events)
    if state is not None:
        known = {*state.columns, *JOB_KEY, *TASK_KEY, *JOB_FIRST, *TASK_FIRST, *TASK_LAST,
                 *RESULT_LAST, *STATE_TIMES}
        rows = state.unionByName(
            rows.select([c for c in rows.columns if c in known]), allowMissingColumns=True)
    return merge(rows)


def has_result(events: DataFrame) -> Column:
    """A success that carries result metadata; empty URIs count as none."""
    def uri(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    return (F.col("status") == "SUCCEEDED") & (
        uri("primary_result_uri") | uri("metrics_uri")
        | F.col("primary_mime").isNotNull() | F.col("primary_size_bytes").isNotNull())


def apply_completions(completions: DataFrame, tasks: DataFrame | None = None,
                      results: DataFrame | None = None) -> Completed:
    """Fold completion records into task state and result state."""
    valid = split_task_statuses(completions).valid
    return Completed(
        tasks=upsert_tasks(valid, tasks),
        results=upsert_results(valid.filter(has_result(valid)), results))


def task_state(tasks: DataFrame, transitions: DataFrame) -> DataFrame:
    """Tasks after their start, success, failure and retry transitions.

    Retries add to the count of the task; an error stays until the next one.
    Transitions of unknown tasks change nothing.

    A state row, one with last_seq, remembers which transitions it has seen
    (`seen`), so late, repeated and reordered ones give the same row: the last
    one decides status and updated_at if no later event has, and every retry
    counts once.
    """
    moves, retries = moved.fold_moves(transitions), moved.fold_retries(transitions)
    if "last_seq" not in tasks.columns:
        return moved.apply_moves(tasks, moves, retries)
    known = tasks.columns
    if SEEN not in known:
        tasks = tasks.withColumn(SEEN, F.lit(None).cast(SEEN_TYPE))
    numbers = retries.groupBy(*TASK_KEY).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    out = tasks.join(moves, list(TASK_KEY), "left").join(numbers, list(TASK_KEY), "left")
    seen, c = F.col(SEEN), F.col
    merged = {f: F.greatest(seen[f], c(f)) for f in ("started", "finished", "failed")}
    before = F.coalesce(seen["retries"], F.array().cast("array<bigint>"))
    now = F.coalesce(F.flatten(F.transform("_spans", lambda s: F.sequence(s["lo"], s["hi"]))), F.array().cast("array<bigint>"))
    later = F.coalesce(c("moved.seq") > c("last_seq"), c("moved").isNotNull())
    both = out.withColumns({f"_{f}": v for f, v in merged.items()}).withColumn("_retries", F.array_union(before, now))
    kept = F.coalesce("_failed", F.struct(F.lit(None).cast("bigint").alias("seq"), *[
        (c(n) if n in known else F.lit(None).cast("string")).alias(n) for n in ("error_code", "error_message")]))
    made = both.withColumns({
        "status": F.when(later, c("moved.status")).otherwise(c("status")),
        "updated_at": F.when(later, c("moved.ts")).otherwise(c("updated_at")),
        "last_seq": F.greatest("last_seq", "moved.seq"),
        "retry_count": (c("retry_count") + F.size("_retries") - F.size(before)).cast("int"),
        "started_at": F.coalesce("_started.ts", *_present(tasks, ("started_at",))),
        "finished_at": F.coalesce("_finished.ts", *_present(tasks, ("finished_at",))),
        "error_code": kept["error_code"], "error_message": kept["error_message"],
        SEEN: F.struct(c("_started").alias("started"), c("_finished").alias("finished"), c("_failed").alias("failed"),
                       c("_retries").alias("retries")).cast(SEEN_TYPE)})
    added = [n for n in (*TRANSITION_TIMES, "error_code", "error_message", SEEN) if n not in known]
    return made.select(*known, *added)


def job_state(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after their status updates; the latest decides, even over the row's own.

    A row that carries status_seq, the update its status came from, takes later
    updates only, so old ones may come again.
    """
    latest = split_job_statuses(updates).valid.groupBy(*JOB_KEY).agg(
        F.max(F.struct("seq", "ts", "status")).alias("_last"))
    out = jobs.join(latest, list(JOB_KEY), "left")
    later, moved_on = F.col("_last").isNotNull(), {}
    if "status_seq" in jobs.columns:
        later = later & F.coalesce(F.col("_last.seq") > F.col("status_seq"), F.lit(True))
        moved_on["status_seq"] = F.when(later, F.col("_last.seq")).otherwise(F.col("status_seq"))
    return out.withColumns({
        **moved_on,
        "status": F.when(later, F.col("_last.status")).otherwise(F.col("status")),
        "updated_at": F.when(later, F.col("_last.ts")).otherwise(F.col("updated_at")),
    }).drop("_last")


def job_rollup(tasks: DataFrame) -> DataFrame:
    """Status of each job from the states of its tasks.

    Any failure fails the job; otherwise it succeeds, or is queued, when all
    tasks are; it is cancelled when a task is and none is open; else it runs.
    """
    status = F.col("status")
    counts = tasks.groupBy(*JOB_KEY).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(status == "SUCCEEDED").alias("succeeded"),
        F.count_if(status.isin("FAILED", "DLQ")).alias("failed"),
        F.count_if(status == "QUEUED").alias("queued"),
        F.count_if(status == "CANCELLED").alias("cancelled"),
        F.count_if(~status.isin(*FINAL_STATUSES)).alias("open"))
    c = F.col
    rolled = (
        F.when(c("failed") > 0, "FAILED")
        .when(c("succeeded") == c("tasks"), "SUCCEEDED")
        .when(c("queued") == c("tasks"), "QUEUED")
        .when((c("cancelled") > 0) & (c("open") == 0), "CANCELLED")
        .otherwise("RUNNING"))
    return counts.withColumn("status", rolled)


def join_barrier(tasks: DataFrame, dag, released: DataFrame | None = None) -> DataFrame:
    """One join task per job whose tasks of a joining step have all succeeded.

    Jobs in `released` already have theirs.
    """
    joined = tasks.withColumn("_join", dag.join_step(F.col("step"))).filter("_join is not null")
    ready = (
        joined.groupBy("job_id", "_join")
        .agg(F.count(F.lit(1)).alias("siblings"),
             F.count_if(F.col("status") != "SUCCEEDED").alias("_open"),
             F.max("last_seq").alias("ready_seq"))
        .filter("_open = 0")
        .select("job_id", F.col("_join").alias("step"), F.lit("S0").alias("task_id"),
                "siblings", "ready_seq"))
    if released is not None:
        ready = ready.join(released.select("job_id", "step"), ["job_id", "step"], "left_anti")
    return ready
