"""Task, job and result state kept from streams of completions and transitions.

A micro-batch is folded to one row per key and written to folders of its own;
one commit then makes the rows of all tables visible together.  A batch that
was committed before is passed over, so a restart changes nothing, and one that
failed half-way is never seen.  Readers fold the committed folders with the same
merge.  `compact` folds them into a base that covers exactly those it read, so
batches may go on being committed meanwhile.  A batch thus costs what it holds,
not what the state holds.

Purged jobs are rows of a table of their own, applied when state is read: they
hide what was committed before them, so a job that comes back is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from taskframe.operators import state, transitions
from taskframe.schemas import JOB_KEY, TASK_KEY
from taskframe.sources import commits


def merge_ended(rows: DataFrame) -> DataFrame:
    """Succeeded tasks, once each, with their last success."""
    return rows.groupBy(*TASK_KEY).agg(F.max("ts").alias("ts"))


def merge_released(rows: DataFrame) -> DataFrame:
    return rows.distinct()


MERGES = {"jobs": state.merge_jobs, "tasks": state.merge_tasks, "results": state.merge_results,
          "moves": transitions.merge_moves, "retries": transitions.merge_retries,
          "ended": merge_ended, "released": merge_released}
TABLES = ("jobs", "tasks", "results")
PURGED = "purged"

AfterWrites = Callable[[DataFrame, int], None]
Fold = Callable[[DataFrame], dict[str, DataFrame]]


def fold_batch(batch: DataFrame) -> dict[str, DataFrame]:
    """State rows of a micro-batch of completion records."""
    done = state.apply_completions(batch)
    jobs = batch.select("seq", "ts", "job_id", "user_id", "schema", "trace_id",
                        F.lit("QUEUED").alias("status"), F.lit("{}").alias("attrs"))
    return {"jobs": state.upsert_jobs(jobs), "tasks": done.tasks, "results": done.results}


def fold_transitions(batch: DataFrame) -> dict[str, DataFrame]:
    """State rows of a micro-batch of task transitions."""
    return {"moves": transitions.fold_moves(batch), "retries": transitions.fold_retries(batch)}


def write_state(spark: SparkSession, base: str, id: str, tables: dict[str, DataFrame]) -> None:
    """Write folded rows of several tables and commit them together under an id."""
    folders = {name: commits.new_folder(base, name) for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(folders[name])
    commits.commit(spark, base, id, folders)


def _stream(rows: DataFrame, base: str, checkpoint: str, fold: Fold, once: bool,
            after_writes: AfterWrites | None) -> StreamingQuery:
    spark = rows.sparkSession
    commits.create(spark, base)
    # Batch numbers belong to a checkpoint.
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        own, id = batch.sparkSession, f"{stream}-{batch_id}"
        if commits.has(own, base, id):
            return
        held = batch.persist()
        try:
            folders = {}
            for name, folded in fold(held).items():
                folders[name] = commits.new_folder(base, name)
                folded.write.parquet(folders[name])
            if after_writes is not None:
                after_writes(held, batch_id)
            commits.commit(own, base, id, folders)
        finally:
            held.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_upsert(completions: DataFrame, base: str, checkpoint: str, once: bool = True,
                  after_writes: AfterWrites | None = None) -> StreamingQuery:
    """Keep job, task and result state of a stream of completion records.

    `after_writes(batch, batch_id)` runs when the rows of a batch are written and
    before they are committed.  If anything fails nothing of the batch is seen,
    and it runs again.
    """
    return _stream(completions, base, checkpoint, fold_batch, once, after_writes)


def stream_transitions(moves: DataFrame, base: str, checkpoint: str, once: bool = True,
                       after_writes: AfterWrites | None = None) -> StreamingQuery:
    """Keep what task transitions say, in whatever order they come."""
    return _stream(moves, base, checkpoint, fold_transitions, once, after_writes)


def purge(spark: SparkSession, base: str, id: str, jobs: DataFrame) -> None:
    """Hide all that is committed of the listed jobs so far."""
    write_state(spark, base, id, {PURGED: jobs.select(*JOB_KEY).distinct()})


def _visible(spark: SparkSession, base: str, name: str, entries: list[commits.Entry],
             purges: list[commits.Entry]) -> DataFrame:
    """Rows of the entries that no later purge hides.

    Entries between the same purges are read together.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for e in entries:
        later = tuple(p.folder for p in purges if p.number > e.number)
        groups.setdefault(later, []).append(e.folder)
    parts = []
    for later, folders in groups.items():
        rows = spark.read.option("mergeSchema", "true").parquet(*folders)
        if later:
            rows = rows.join(spark.read.parquet(*later).select(*JOB_KEY), list(JOB_KEY), "left_anti")
        parts.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_state(spark: SparkSession, base: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Current rows of a state table; without any commit it is empty, in the given schema."""
    entries = commits.live(spark, base, name)
    if not entries:
        return commits.read(spark, base, name, schema)
    return MERGES[name](_visible(spark, base, name, entries, commits.live(spark, base, PURGED)))


def read_tasks(spark: SparkSession, base: str, moves_base: str | None = None) -> DataFrame:
    """Tasks with their transitions, which may be kept elsewhere."""
    at = moves_base or base
    return transitions.apply_moves(read_state(spark, base, "tasks"), read_state(spark, at, "moves"), read_state(spark, at, "retries"))


def compact(spark: SparkSession, base: str) -> None:
    """Fold all tables into one base, without what is purged.

    The base takes the place of the last commit it covers, so what is committed
    meanwhile, purges too, still comes after it.
    """
    covered = commits.live(spark, base)
    names = sorted({e.name for e in covered} - {PURGED})
    purges = [e for e in covered if e.name == PURGED]
    folders = {}
    for name in names:
        rows = MERGES[name](_visible(spark, base, name, [e for e in covered if e.name == name], purges))
        folders[name] = commits.new_folder(base, name)
        rows.write.parquet(folders[name])
    ids = sorted({e.id for e in covered})
    if folders:
        digest = hashlib.sha256("\n".join(ids).encode()).hexdigest()[:12]
        commits.commit(spark, base, f"base-{digest}", folders, ids, max(e.number for e in covered))
