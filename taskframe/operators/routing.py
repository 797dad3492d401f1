"""Which messages a worker takes, and which of them are done already."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import computed_once
from taskframe.functions.paths import is_slot

# Files that mark a task as done.
RESULT_FILES = ("result.json", "result.png", "result.mp4")
MORE_RESULT_FILES = ("result.mp3", "result.wav")
METRICS_FILE = "metrics.json"


class Routed(NamedTuple):
    mine: DataFrame
    released: DataFrame


class Work(NamedTuple):
    pending: DataFrame
    skipped: DataFrame


def route_by_step(messages: DataFrame, dag) -> DataFrame:
    """Add the queue that serves the message's step."""
    return messages.withColumn("queue", dag.queue(F.col("step")))


def split_for_worker(messages: DataFrame, step: str) -> Routed:
    """A worker's own messages, and those of other steps on its queue."""
    mine = F.coalesce(F.col("step") == step, F.lit(False))
    return Routed(messages.filter(mine), messages.filter(~mine))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*/)[^/]*\z", 1)


def finished_by(listing: DataFrame, all_types: bool = False) -> DataFrame:
    """Stored objects by folder and file, with the keys of the work each of them finishes.

    A result file in a slot finishes the slot.  A result or metrics file at
    step level, or a result in slot S0, finishes tasks that are not slots.
    """
    results = RESULT_FILES + (MORE_RESULT_FILES if all_types else ())
    df = computed_once(
        listing.select("path"), _dir=_folder(F.col("path")),
        _file=F.substring_index("path", "/", -1))
    folder, name = F.col("_dir"), F.col("_file")
    is_result = name.isin(*results)
    keys = F.array(
        F.when(is_result & folder.rlike(r"/S[0-9]+/\z"), F.concat(F.lit("slot "), folder)),
        F.when(is_result | (name == METRICS_FILE), F.concat(F.lit("step "), folder)),
        F.when(is_result & folder.endswith("/S0/"),
               F.concat(F.lit("step "), F.substring(folder, F.lit(1), F.length(folder) - 3))))
    return df.withColumn("done_keys", F.array_compact(keys))


def done_keys(listing: DataFrame, all_types: bool = False) -> DataFrame:
    """Keys of finished work found in an object listing, repeats included."""
    return finished_by(listing, all_types).select(F.explode("done_keys").alias("done_key"))


def task_done_key(step_prefix: Column, task_id: Column) -> Column:
    folder = F.concat(F.regexp_replace(step_prefix, r"/+\z", ""), F.lit("/"))
    return F.when(
        is_slot(task_id), F.concat(F.lit("slot "), folder, task_id, F.lit("/")),
    ).otherwise(F.concat(F.lit("step "), folder))


def split_done(tasks: DataFrame, listing: DataFrame, all_types: bool = False) -> Work:
    """Tasks still to do, and tasks whose result exists.

    `tasks` carries step_prefix and task_id.  Both sides meet on one derived
    key, so each half is a plain semi or anti join.
    """
    done = done_keys(listing, all_types)
    keyed = tasks.withColumn("done_key", task_done_key(F.col("step_prefix"), F.col("task_id")))
    return Work(
        pending=keyed.join(done, "done_key", "left_anti").drop("done_key"),
        skipped=keyed.join(done, "done_key", "left_semi").drop("done_key"))
