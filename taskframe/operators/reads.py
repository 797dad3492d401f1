"""Reads, integrity checks and removal over the state tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.operators.ranking import top_per_group
from taskframe.schemas import LIST_JOBS_LIMIT, LIST_TASKS_LIMIT, TASK_KEY


class StateTables(NamedTuple):
    jobs: DataFrame
    tasks: DataFrame
    results: DataFrame


def by_key(state: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a state table whose key is listed."""
    return state.join(keys.select(*on), list(on), "left_semi")


def list_jobs(jobs: DataFrame, status: str | None = None,
              limit: int = LIST_JOBS_LIMIT) -> DataFrame:
    """The newest jobs of every user."""
    if status:
        jobs = jobs.filter(F.col("status") == status)
    order = [F.desc("created_at"), F.asc("job_id")]
    return top_per_group(jobs, ["user_id"], order, limit, ["job_id"])


def list_tasks(tasks: DataFrame, step: str | None = None, status: str | None = None,
               limit: int = LIST_TASKS_LIMIT) -> DataFrame:
    """The newest tasks of every job."""
    if step:
        tasks = tasks.filter(F.col("step") == step)
    if status:
        tasks = tasks.filter(F.col("status") == status)
    order = [F.desc("created_at"), F.asc("step"), F.asc("task_id")]
    return top_per_group(tasks, ["job_id"], order, limit, ["step", "task_id"])


def jobs_of_user(jobs: DataFrame, user_id: str, status: str | None = None,
                 limit: int = LIST_JOBS_LIMIT) -> DataFrame:
    """The newest jobs of one user, newest first."""
    mine = jobs.filter(F.col("user_id") == user_id)
    if status:
        mine = mine.filter(F.col("status") == status)
    return mine.orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit)


def tasks_of_job(tasks: DataFrame, job_id: str, step: str | None = None,
                 status: str | None = None, limit: int = LIST_TASKS_LIMIT) -> DataFrame:
    """The newest tasks of one job, newest first."""
    mine = tasks.filter(F.col("job_id") == job_id)
    if step:
        mine = mine.filter(F.col("step") == step)
    if status:
        mine = mine.filter(F.col("status") == status)
    order = [F.desc("created_at"), F.asc("step"), F.asc("task_id")]
    return mine.orderBy(*order).limit(limit)


def children_of(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    """Tasks whose parent, within the same job, is listed.

    Ids repeat between steps, so a parent_step, if the tasks have one, counts too.
    """
    key = {"job_id": "job_id", "task_id": "parent_task_id"}
    if "parent_step" in tasks.columns:
        key["step"] = "parent_step"
    listed = parents.select(*[F.col(c).alias(n) for c, n in key.items()])
    return tasks.join(listed, list(key.values()), "left_semi")


def children_of_task(tasks: DataFrame, job_id: str, parent_task_id: str,
                     parent_step: str | None = None) -> DataFrame:
    """Children of one task, oldest first; of the task of that step, if given."""
    mine = (F.col("job_id") == job_id) & (F.col("parent_task_id") == parent_task_id)
    if parent_step is not None:
        mine = mine & (F.col("parent_step") == parent_step)
    return tasks.filter(mine).orderBy("created_at", "step", "task_id")


def task_with_result(tasks: DataFrame, results: DataFrame) -> DataFrame:
    names = ["primary_result_uri", "metrics_uri", "primary_mime", "primary_size_bytes", "extra"]
    found = results.select(*TASK_KEY, *[n for n in names if n in results.columns])
    return tasks.join(found, list(TASK_KEY), "left")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that refer to a missing row."""
    return child.join(parent.select(*on), list(on), "left_anti")


def purge_jobs(state: StateTables, purge: DataFrame) -> StateTables:
    """Drop jobs with their tasks and results; unknown ids are ignored."""
    listed = purge.select("job_id")
    return StateTables(*[t.join(listed, "job_id", "left_anti") for t in state])


def empty_table(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def create_tables(spark, base: str, schemas: dict[str, T.StructType]) -> None:
    """Create the state tables that do not exist yet, without rows."""
    for name, schema in schemas.items():
        empty_table(spark, schema).write.mode("ignore").parquet(f"{base}/{name}")


def audit_constraints(df: DataFrame, schema: T.StructType, key: Sequence[str],
                      statuses: Sequence[str] | None = None) -> DataFrame:
    """Violations per rule: nulls in required columns, repeated keys, statuses."""
    required = [f.name for f in schema if not f.nullable and f.name in df.columns]
    counts = {f"not_null:{n}": F.count_if(F.col(n).isNull()) for n in required}
    if statuses is not None:
        counts["status"] = F.count_if(~F.coalesce(
            F.col("status").isin(*statuses), F.lit(False)))
    flat = df.agg(*[v.alias(f"c{i}") for i, v in enumerate(counts.values())])
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"))
            for i, rule in enumerate(counts)]
    repeated = (
        df.groupBy(*key).count()
        .agg(F.count_if(F.col("count") > 1).alias("violations"))
        .select(F.lit("unique_key").alias("rule"), "violations"))
    return flat.select(F.inline(F.array(*rows))).unionByName(repeated)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
