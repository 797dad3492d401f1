"""Continuous validation and deduplication of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taskframe.operators.queues import with_dedup_id
from taskframe.operators.validate import MESSAGE_COLUMNS, check_messages

VERDICT = "verdict"


def stream_validate(raw: DataFrame, dag, buckets: Sequence[str], out: str, checkpoint: str,
                    once: bool = True) -> StreamingQuery:
    """Validate a stream of raw messages into one table, split by verdict.

    Each row is parsed once.  The file sink commits whole batches and the
    checkpoint keeps the batch ids, so a restarted query neither loses nor
    repeats rows; read one verdict and only its files are opened.
    """
    checked = check_messages(raw, dag, buckets)
    verdict = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    rows = checked.select(
        *MESSAGE_COLUMNS, "reason", "detail",
        F.when(F.col("reason").isNotNull(), F.col("body")).alias("body"),
        verdict.alias(VERDICT))
    writer = (
        rows.writeStream.format("parquet").partitionBy(VERDICT)
        .option("path", out).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_accepted(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).filter(F.col(VERDICT) == "accepted").select(*MESSAGE_COLUMNS)


def read_rejected(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).filter(F.col(VERDICT) == "rejected").select(
        "message_id", "sent_ts", "receive_count", "reason", "detail", "body")


def dedup_stream(messages: DataFrame, group: Sequence[str], time: str,
                 within: str) -> DataFrame:
    """Drop repeats of a (group, deduplication id) within an interval.

    State is one key per live id and is dropped when the watermark passes.
    """
    return (
        with_dedup_id(messages)
        .withWatermark(time, within)
        .dropDuplicatesWithinWatermark([*group, "dedup_id"]))
