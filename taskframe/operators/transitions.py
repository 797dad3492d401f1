"""Task transitions as a fold that takes them in any order, any number of times.

What transitions say about a task are facts with a sequence number: the last
one, the last start, the last end, the last failure, and which retries were
seen.  Each fact is a maximum or a set, so late, repeated and reordered rows
give the same state.

Retries are a set of numbers, kept as merged spans in blocks of `BLOCK` numbers:
a row has at most BLOCK / 2 spans, and a task with very many retries is spread
over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.schemas import TASK_KEY

MOVES = ("STARTED", "RETRIED", "SUCCEEDED", "FAILED")
BLOCK = 1024
FACTS = ("moved", "started", "finished", "failed")


def _known(transitions: DataFrame) -> DataFrame:
    return transitions.filter(F.coalesce(F.col("status").isin(*MOVES), F.lit(False)) & F.col("seq").isNotNull())


def fold_moves(transitions: DataFrame) -> DataFrame:
    """Per task: moved, started, finished and failed, each with its sequence number."""
    status = F.col("status")

    def text(name: str) -> Column:
        return (F.col(name) if name in transitions.columns else F.lit(None).cast("string")).alias(name)

    def at(*names: str) -> Column:
        return F.max(F.when(status.isin(*names), F.struct("seq", "ts")))

    return _known(transitions).groupBy(*TASK_KEY).agg(
        F.max(F.struct("seq", "ts", "status")).alias("moved"),
        at("STARTED").alias("started"), at("SUCCEEDED", "FAILED").alias("finished"),
        F.max(F.when(status == "FAILED", F.struct("seq", text("error_code"), text("error_message")))).alias("failed"))


def merge_moves(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TASK_KEY).agg(*[F.max(c).alias(c) for c in FACTS])


def spans(numbers: Column) -> Column:
    """An array of distinct numbers as merged spans (lo, hi), in order."""
    ordered = F.array_sort(numbers)
    return F.get(F.transform(F.array(ordered), lambda s: F.arrays_zip(
        F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) < x - 1)).alias("lo"),
        F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) > x + 1)).alias("hi"))), 0).cast(
            "array<struct<lo:bigint,hi:bigint>>")


def _by_block(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy(*TASK_KEY, "block").agg(spans(F.collect_set("number")).alias("spans"))


def fold_retries(transitions: DataFrame, number: str = "seq") -> DataFrame:
    """Per task and block: the retry numbers seen, as spans."""
    seen = _known(transitions).filter((F.col("status") == "RETRIED") & F.col(number).isNotNull())
    n = F.col(number).cast("bigint")
    return _by_block(seen.select(*TASK_KEY, F.floor(n / BLOCK).alias("block"), n.alias("number")))


def merge_retries(rows: DataFrame) -> DataFrame:
    each = rows.select(*TASK_KEY, "block", F.inline("spans"))
    return _by_block(each.select(*TASK_KEY, "block", F.explode(F.sequence("lo", "hi")).alias("number")))


def retry_counts(retries: DataFrame) -> DataFrame:
    """Distinct retries per task."""
    in_block = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"] + 1)
    return retries.groupBy(*TASK_KEY).agg(F.sum(in_block).alias("retries"))


def apply_moves(tasks: DataFrame, moves: DataFrame, retries: DataFrame) -> DataFrame:
    """Tasks with what their transitions say.

    A transition decides status and updated_at if it is later than the last event
    of the task, where the task says which that was (last_seq).  Retries add to
    the count of the task; an error stays until the next failure.  Transitions of
    unknown tasks change nothing.
    """
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in tasks.columns else F.lit(None).cast(kind)

    later = F.col("moved.seq") > F.col("last_seq") if "last_seq" in tasks.columns else F.col("moved").isNotNull()
    later = F.coalesce(later, F.col("moved").isNotNull())
    out = tasks.join(moves, list(TASK_KEY), "left").join(retry_counts(retries), list(TASK_KEY), "left")
    return out.withColumns({
        "status": F.when(later, F.col("moved.status")).otherwise(F.col("status")),
        "updated_at": F.when(later, F.col("moved.ts")).otherwise(F.col("updated_at")),
        "retry_count": (F.col("retry_count") + F.coalesce("retries", F.lit(0))).cast("int"),
        "started_at": F.coalesce("started.ts", column("started_at", "timestamp_ntz")),
        "finished_at": F.coalesce("finished.ts", column("finished_at", "timestamp_ntz")),
        "error_code": F.when(F.col("failed").isNotNull(), F.col("failed.error_code")).otherwise(column("error_code", "string")),
        "error_message": F.when(F.col("failed").isNotNull(), F.col("failed.error_message")).otherwise(
            column("error_message", "string")),
    }).drop(*FACTS, "retries")
