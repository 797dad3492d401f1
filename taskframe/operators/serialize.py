"""Messages back to JSON bodies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import computed_once, json_or_text
from taskframe.functions.text import strip


class Serialized(NamedTuple):
    bodies: DataFrame
    refused: DataFrame


def serialize_work_messages(normalized: DataFrame) -> DataFrame:
    """`body` of each normalised message; a null parent is left out."""
    body = F.to_json(F.struct(
        "job_id", "task_id", "user_id", "schema", "step", "input_uri", "output_prefix",
        json_or_text(F.col("params")).alias("params"), "retry_count", "parent_task_id"))
    return normalized.select("message_id", body.alias("body"))


def serialize_task_messages(messages: DataFrame) -> Serialized:
    """`body` of each task message; empty required fields refuse the row.

    An `extra` column, a JSON object, adds its members where they do not
    collide with a member of the message.
    """
    c = F.col
    problem = F.coalesce(*[
        F.when(F.coalesce(c(n), F.lit("")) == "", F.lit(n))
        for n in ("job_id", "task_id", "step", "input_uri", "output_prefix")])
    base = F.to_json(F.struct(
        "job_id", "task_id", "user_id",
        F.coalesce("schema", F.lit("v1")).alias("schema"),
        strip(F.upper("step")).alias("step"), "input_uri", "output_prefix",
        json_or_text(F.coalesce("params", F.lit("{}"))).alias("params"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        "trace_id", "parent_task_id"))
    df = computed_once(messages, _problem=problem, _base=base)
    if "extra" in messages.columns:
        members = "map<string,variant>"
        known = F.try_variant_get(F.try_parse_json("_base"), "$", members)
        extra = F.try_variant_get(F.try_parse_json("extra"), "$", members)
        added = F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys("_known"), k))
        df = computed_once(df, _known=known)
        df = df.withColumn("_base", F.when(
            extra.isNull(), c("_base")).otherwise(F.to_json(F.map_concat("_known", added))))
    return Serialized(
        bodies=df.filter("_problem is null").select("message_id", c("_base").alias("body")),
        refused=df.filter("_problem is not null").select(
            "message_id", c("_problem").alias("missing")))
