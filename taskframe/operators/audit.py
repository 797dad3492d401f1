"""Reports on whether tasks kept their contract and queues drained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.operators.queues import is_poison, queue_stats
from taskframe.operators.reads import union_all
from taskframe.operators.routing import METRICS_FILE, finished_by, task_done_key
from taskframe.operators.state import FINAL_STATUSES, merge_tasks
from taskframe.schemas import TASK_KEY


# What is checked, each with keys of its own.
CHECKS = ("result_present", "metrics_present", "no_repeated_work", "child_ids_unique", "job_finished")
_MARKS = ("n", "found", "failed", "succeeded", "cancelled", "open", "h1", "h2")


def _mark(check: str, *key: str | Column, **values) -> Column:
    """A row for a key of a check: `n` rows to check, or evidence about them."""
    key = [*key, *[F.lit(None).cast("string")] * (3 - len(key))]
    return F.struct(
        F.lit(CHECKS.index(check)).alias("check"), *[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(key)],
        *[values.get(m, F.lit(None)).cast("bigint").alias(m) for m in _MARKS])


def contract_audit(tasks: DataFrame, events: DataFrame, listing: DataFrame,
                   children: DataFrame) -> DataFrame:
    """Rows checked and failed per point of the contract.

    `tasks` is task state with step_prefix, `events` the task events, `listing`
    the stored objects, `children` the fan-out messages.

    Each input is read once and turned into marks on the keys of the checks.  All
    marks meet in one shuffle, where they have been summed up per key before.
    A check without rows has 0 of both.
    """
    c, one = F.col, F.lit(1)
    status, good = c("status"), c("status") == "SUCCEEDED"
    of_tasks = tasks.select(F.inline(F.array_compact(F.array(
        F.when(good, _mark("result_present", task_done_key(c("step_prefix"), c("task_id")), n=one)),
        F.when(good, _mark("metrics_present", "step_prefix", n=one)),
        _mark("job_finished", "job_id", n=one, failed=status.isin("FAILED", "DLQ"), succeeded=good,
              cancelled=status == "CANCELLED", open=~status.isin(*FINAL_STATUSES))))))
    of_events = events.filter(good).select(F.inline(F.array(_mark("no_repeated_work", *TASK_KEY, n=one))))
    stored = finished_by(listing)
    is_metrics = c("path").endswith(f"/{METRICS_FILE}")
    of_objects = stored.select(F.inline(F.concat(
        F.transform("done_keys", lambda k: _mark("result_present", k, found=one)),
        F.array_compact(F.array(F.when(is_metrics, _mark("metrics_present", "_dir", found=one)))))))
    # Two children differ if their digests do: 120 bits of SHA-256, as numbers.
    known = c("input_uri").isNotNull() & c("params").isNotNull()
    digest = F.when(known, F.sha2(F.to_json(F.struct("input_uri", "params")), 256))
    of_children = children.withColumn("_digest", digest).select(F.inline(F.array(_mark(
        "child_ids_unique", *TASK_KEY, n=one,
        **{f"h{i + 1}": F.conv(F.substring("_digest", 15 * i + 1, 15), 16, 10) for i in range(2)}))))

    per_key = union_all([of_tasks, of_events, of_objects, of_children]).groupBy("check", "k0", "k1", "k2").agg(
        F.sum("n").alias("n"), F.max("found").alias("found"),
        *[F.sum(m).alias(m) for m in ("failed", "succeeded", "cancelled", "open")],
        ((F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))).alias("differ")).filter("n > 0")
    finished = (c("failed") > 0) | (c("succeeded") == c("n")) | ((c("cancelled") > 0) & (c("open") == 0))
    missing = c("found").isNull()
    # Rows checked of a key, and how many of them failed.
    counted = {
        "result_present": (c("n"), F.when(missing, c("n"))),
        "metrics_present": (one, missing), "no_repeated_work": (one, c("n") > 1),
        "child_ids_unique": (one, c("differ")), "job_finished": (one, ~finished)}
    totals = [
        F.coalesce(F.sum(F.when(c("check") == i, value.cast("bigint"))), F.lit(0)).alias(f"{name}_{what}")
        for i, name in enumerate(CHECKS) for what, value in zip(("checked", "failed"), counted[name])]
    return per_key.agg(*totals).select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("check_name"), c(f"{name}_checked").alias("checked"), c(f"{name}_failed").alias("failed"))
        for name in CHECKS])))


def drain_audit(queue_rows: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """One row: what is still queued, dead or open."""
    queued = queue_stats(queue_rows).agg(
        F.sum("visible").alias("visible"), F.sum("inflight").alias("inflight"),
        F.sum("delayed").alias("delayed"))
    dead = messages.agg(F.count_if(is_poison(F.col("receive_count"))).alias("dead"))
    lifted = events.withColumns({
        "first_seq": F.col("seq"), "last_seq": F.col("seq"),
        "created_at": F.col("ts"), "updated_at": F.col("ts")})
    tasks = merge_tasks(lifted.select(
        *TASK_KEY, "status", "first_seq", "last_seq", "created_at", "updated_at"))
    open_tasks = tasks.agg(
        F.count_if(~F.col("status").isin(*FINAL_STATUSES)).alias("open_tasks"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded_tasks"))
    # Three single rows side by side.
    totals = union_all([queued, dead, open_tasks]).agg(*[
        F.max(n).alias(n) for n in ("visible", "inflight", "delayed", "dead", "open_tasks",
                                    "succeeded_tasks")])
    pending = F.col("visible") + F.col("inflight") + F.col("delayed")
    return totals.withColumn(
        "drained", (pending == 0) & (F.col("dead") == 0) & (F.col("open_tasks") == 0))
