"""Ancestry of tasks over all levels, by doubling parent pointers.

After round r a task knows what lies within 2^r steps above and below it, so a
chain of n tasks takes log2(n) rounds, each one join and one aggregation on the
key.  Only keys and counters travel.  A parent with very many children is one row
of the looked-up side, and its sum combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.schemas import TASK_KEY
from taskframe.session import scratch_dir


def _stored(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _key(*names: str) -> Column:
    """One value for the key; null if any part is."""
    parts = [F.col(n) for n in names]
    whole = parts[0].isNotNull()
    for part in parts[1:]:
        whole = whole & part.isNotNull()
    return F.when(whole, F.struct(*[p.alias(k) for p, k in zip(parts, TASK_KEY)]))


def lineage(tasks: DataFrame) -> DataFrame:
    """Root, depth and subtree size of every task.

    Tasks have the key columns, each key once, with parent_step and parent_task_id
    (a parent is of the same job).  A parent that is null or not among the tasks
    counts as none.  `root_step` and `root_task_id` name the topmost task, `depth`
    is 0 there, and `subtree` counts the task with all below it.  Tasks on or below
    a cycle have nulls in all four.  Tasks whose own key holds a null stand alone.
    """
    folder = scratch_dir(tasks.sparkSession, "lineage")
    links = tasks.select(
        *TASK_KEY, _key(*TASK_KEY).alias("me"),
        _key("job_id", "parent_step", "parent_task_id").alias("up"))
    known = links.select(F.col("me").alias("up"), F.lit(True).alias("there")).filter("up is not null")
    state = links.join(known, "up", "left").select(
        *TASK_KEY, "me", F.when(F.col("me").isNotNull() & F.col("there"), F.col("up")).alias("jump"),
        F.col("me").alias("top"), F.lit(0).cast("bigint").alias("depth"), F.lit(1).cast("bigint").alias("subtree"))
    state = _stored(state, f"{folder}/0")
    before, step, rounds = None, 1, 0
    while True:
        open_tasks = state.filter("jump is not null").count()
        # Some chain ends in every round, so what stays open can only go in circles.
        if open_tasks in (0, before):
            break
        above = state.filter("me is not null").select(
            F.col("me").alias("jump"), F.col("jump").alias("next_jump"), F.col("top").alias("next_top"),
            F.col("depth").alias("more"))
        below = state.filter("jump is not null").groupBy(F.col("jump").alias("me")).agg(
            F.sum("subtree").alias("added"))
        moved = F.col("jump").isNotNull()
        state = (
            state.join(above, "jump", "left").join(below, "me", "left").select(
                *TASK_KEY, "me", F.col("next_jump").alias("jump"),
                F.when(moved, F.col("next_top")).otherwise(F.col("top")).alias("top"),
                F.when(moved, F.col("more") + step).otherwise(F.col("depth")).alias("depth"),
                (F.col("subtree") + F.coalesce("added", F.lit(0))).alias("subtree")))
        rounds += 1
        state = _stored(state, f"{folder}/{rounds}")
        before, step = open_tasks, step * 2
    ends = F.col("jump").isNull()
    return state.select(
        *TASK_KEY,
        F.when(ends, F.coalesce(F.col("top.step"), F.col("step"))).alias("root_step"),
        F.when(ends, F.coalesce(F.col("top.task_id"), F.col("task_id"))).alias("root_task_id"),
        F.when(ends, F.col("depth")).alias("depth"), F.when(ends, F.col("subtree")).alias("subtree"))
