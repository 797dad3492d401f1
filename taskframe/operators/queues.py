"""Claiming, counting, re-sending and burying queued messages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import (
    as_text, field, is_null, is_object, is_string, strict_json, with_strict_json,
)
from taskframe.operators.normalize import integer
from taskframe.operators.ranking import top_per_group
from taskframe.schemas import (
    MAX_BODY_BYTES, MAX_DEDUP_ID, MAX_DELAY_SECONDS, MAX_RECEIVES, RECEIVE_BATCH,
)


class Outbox(NamedTuple):
    sent: DataFrame
    refused: DataFrame


def _visibility(delay: Column, invisible: Column) -> Column:
    return F.when(delay > 0, "delayed").when(invisible > 0, "inflight").otherwise("visible")


def claim_batch(queue_rows: DataFrame, max_messages: int = 1) -> DataFrame:
    """The oldest visible messages of every queue, one to ten each."""
    n = max(1, min(int(max_messages), RECEIVE_BATCH))
    visible = queue_rows.filter(
        _visibility(F.col("delay_left_sec"), F.col("invisible_left_sec")) == "visible")
    order = [F.asc("sent_ts"), F.asc("message_id")]
    return top_per_group(visible, ["queue"], order, n, ["message_id"])


def queue_stats(queue_rows: DataFrame) -> DataFrame:
    state = _visibility(F.col("delay_left_sec"), F.col("invisible_left_sec"))
    return queue_rows.groupBy("queue").agg(
        F.count_if(state == "visible").alias("visible"),
        F.count_if(state == "inflight").alias("inflight"),
        F.count_if(state == "delayed").alias("delayed"))


def is_poison(receive_count: Column, max_receives: int = MAX_RECEIVES) -> Column:
    return receive_count >= max_receives


def poison_messages(messages: DataFrame, max_receives: int = MAX_RECEIVES) -> DataFrame:
    return messages.filter(is_poison(F.col("receive_count"), max_receives))


def dlq_records(bodies: DataFrame) -> DataFrame:
    """Dead letters of rows with message_id, body and reason.

    The letter carries the payload, taken out of its envelope, and the payload's
    retry count, 0 if it has none.  Bodies whose payload is no JSON object are
    kept as JSON strings.
    """
    c = F.col
    df = with_strict_json(bodies, "_body", "body")
    df = df.withColumn("_inner", field(c("_body"), "Message")).withColumn(
        "_doc", F.when(c("_inner").isNull(), c("_body"))
        .when(is_string(c("_inner")), strict_json(as_text(c("_inner"))))
        .otherwise(c("_inner")))
    df = df.withColumns({
        "_object": F.coalesce(is_object(c("_doc")), F.lit(False)),
        "_retries": field(c("_doc"), "retry_count")})
    retries = F.when(is_null(c("_retries")), F.lit(0)).otherwise(
        F.coalesce(integer(c("_retries")), F.lit(0)))
    record = F.struct(
        F.coalesce("reason", F.lit("poison-pill")).alias("reason"),
        retries.alias("retry_count"),
        F.when(c("_object"), c("_doc")).otherwise(c("body").cast("variant")).alias("original"))
    return df.select("message_id", F.to_json(record).alias("body"))


def clamp_delay(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.least(seconds, F.lit(MAX_DELAY_SECONDS)))


def requeue(messages: DataFrame, now: Column) -> DataFrame:
    """Messages sent again with one more retry, visible after their delay."""
    delay = clamp_delay(F.coalesce("delay_seconds", F.lit(0)))
    return messages.withColumns({
        "retry_count": F.coalesce("retry_count", F.lit(0)) + 1,
        "delay_seconds": delay,
        "visible_at": now + F.make_dt_interval(secs=delay)})


def is_fifo(queue: Column) -> Column:
    return F.lower(queue).endswith(".fifo")


def checked_outbox(messages: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Rows with queue, body, delay, group, deduplication id and `problem` (null when they can be sent).

    Needs queue and body; delay_seconds, group_id, dedup_id and task_id are
    optional.  A FIFO queue needs a group and falls back to the task id for
    deduplication.  Bodies over the limit are refused, not cut.
    """
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in messages.columns else F.lit(None).cast(kind)

    group = F.nullif(column("group_id", "string"), F.lit(""))
    fifo = F.coalesce(is_fifo(F.col("queue")), F.lit(False))
    dedup = dedup_key(column("dedup_id", "string"), F.when(fifo, column("task_id", "string")))
    problem = (
        F.when(F.col("body").isNull(), "empty_body")
        .when(fifo & group.isNull(), "fifo_without_group")
        .when(F.octet_length("body") > max_bytes, "body_too_large"))
    return messages.withColumns({
        "delay_seconds": clamp_delay(F.coalesce(column("delay_seconds", "int"), F.lit(0))),
        "group_id": group, "dedup_id": dedup, "problem": problem})


def outbox(messages: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> Outbox:
    """Rows ready to publish, and those that are refused."""
    rows = checked_outbox(messages, max_bytes)
    return Outbox(
        sent=rows.filter("problem is null").drop("problem"),
        refused=rows.filter("problem is not null"))


def dedup_key(own_id: Column, task_id: Column) -> Column:
    """The deduplication id a message was given, else its task id, cut to size."""
    return F.coalesce(F.nullif(own_id, F.lit("")), F.substring(task_id, 1, MAX_DEDUP_ID))


def with_dedup_id(messages: DataFrame) -> DataFrame:
    own = F.col("dedup_id") if "dedup_id" in messages.columns else F.lit(None).cast("string")
    return messages.withColumn("dedup_id", dedup_key(own, F.col("task_id")))


def dedup_messages(messages: DataFrame, group: list[str]) -> DataFrame:
    """The first message, by seq, of every (group, deduplication id)."""
    keyed = with_dedup_id(messages)
    rest = [c for c in keyed.columns if c not in (*group, "dedup_id")]
    return (
        keyed.groupBy(*group, "dedup_id")
        .agg(F.min_by(F.struct(*rest), "seq").alias("_first"))
        .select(*group, "dedup_id", "_first.*"))
