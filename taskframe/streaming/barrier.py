"""Join steps released from a stream of task events, each once.

A join step may start when as many sibling tasks have succeeded as the fan-out made.
Events come late, repeated and in any order; a success counts for good, so what is
released does not depend on order.  Successes and releases of a micro-batch are one
commit: a batch that fails half-way releases nothing, one that is repeated nothing
more.  No group is held in one task: siblings are counted by a grouping that combines
before its shuffle, and state lies in committed tables instead of the memory of a key.
A batch reads the stored keys of succeeded tasks once; `state.compact` folds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taskframe.schemas import TASK_KEY
from taskframe.streaming import state

GROUP = ["job_id", "step"]
ENDED = "job_id string, step string, task_id string, ts timestamp_ntz"
RELEASED = "job_id string, step string, task_id string, joined_step string, siblings bigint"


def _stored(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    return state.read_state(spark, base, name, spark.createDataFrame([], schema).schema)


def fold_barrier(batch: DataFrame, base: str, expected: DataFrame, dag) -> dict[str, DataFrame]:
    """Succeeded siblings of a micro-batch, and the join steps they release."""
    spark = batch.sparkSession
    ended = state.merge_ended(
        batch.filter("status = 'SUCCEEDED' and job_id is not null and task_id is not null")
        .filter(dag.join_step(F.col("step")).isNotNull()).select(*TASK_KEY, F.col("ts").cast("timestamp_ntz").alias("ts")))
    known = _stored(spark, base, "ended", ENDED).join(ended.select(*GROUP).distinct(), GROUP, "left_semi")
    done = state.merge_ended(known.unionByName(ended)).groupBy(*GROUP).agg(F.count("*").alias("done"))
    ready = (
        done.join(expected.select(*GROUP, F.col("siblings").cast("bigint").alias("siblings")), GROUP)
        .filter("done >= siblings")
        .select("job_id", dag.join_step(F.col("step")).alias("step"), F.lit("S0").alias("task_id"),
                F.col("step").alias("joined_step"), "siblings"))
    before = _stored(spark, base, "released", RELEASED).select("job_id", "joined_step")
    return {"ended": ended, "released": ready.join(before, ["job_id", "joined_step"], "left_anti")}


def stream_barrier(events: DataFrame, expected: DataFrame, dag, base: str, checkpoint: str, once: bool = True,
                   after_writes: state.AfterWrites | None = None) -> StreamingQuery:
    """Release join steps from a stream of events (the key, ts and status).

    `expected` says how many siblings each (job_id, step) has, one row each; groups it
    lacks wait.  `after_writes` is as in `state.stream_upsert`.
    """
    def fold(batch: DataFrame) -> dict[str, DataFrame]:
        return fold_barrier(batch, base, expected, dag)

    return state._stream(events, base, checkpoint, fold, once, after_writes)


def read_released(spark: SparkSession, base: str) -> DataFrame:
    """Join tasks released so far: job, step, task, the step joined and its siblings."""
    return _stored(spark, base, "released", RELEASED)


def stalled(spark: SparkSession, base: str, expected: DataFrame, before) -> DataFrame:
    """Groups that wait for siblings and had no success since a time.

    With `done`, `siblings` and the time of the last success, null without any.
    """
    done = _stored(spark, base, "ended", ENDED).groupBy(*GROUP).agg(F.count("*").alias("done"), F.max("ts").alias("last_ts"))
    released = read_released(spark, base).select("job_id", F.col("joined_step").alias("step"))
    return (
        expected.select(*GROUP, "siblings").join(released, GROUP, "left_anti").join(done, GROUP, "left")
        .filter(F.col("last_ts").isNull() | (F.col("last_ts") < F.lit(before).cast("timestamp_ntz")))
        .select(*GROUP, F.coalesce("done", F.lit(0).cast("bigint")).alias("done"), "siblings", "last_ts"))
