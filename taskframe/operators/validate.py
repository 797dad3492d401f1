"""Task message contract: every row is accepted or gets its first failure."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import (
    depth_at_most, is_null, is_object_text, is_string, kind, may_be_no_string, members,
    sealed, size_at_most, strict_json,
)
from taskframe.functions.paths import has_extension, task_prefix
from taskframe.functions.text import contains_any, is_id, is_trace_id
from taskframe.operators.envelopes import payload_problem, read_payloads
from taskframe.schemas import (
    MAX_JOB_ID, MAX_PARAMS_BYTES, MAX_PARAMS_DEPTH, MAX_TASK_ID, MAX_TRACE_ID,
    MAX_USER_ID, REQUIRED_FIELDS, SCHEMA_VERSIONS,
)
from taskframe.sources.dag import Dag

MESSAGE_COLUMNS = (
    "message_id", "sent_ts", "receive_count", "job_id", "task_id", "user_id", "schema",
    "step", "input_uri", "output_prefix", "params", "retry_count", "trace_id",
    "parent_task_id",
)
_TEXT_FIELDS = ("job_id", "task_id", "user_id", "schema", "step", "input_uri",
                "output_prefix")
_OPTIONAL_TEXT = ("trace_id", "parent_task_id")


class Validated(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def input_uri_ok(uri: Column, buckets: Sequence[str]) -> Column:
    bucket = F.substring_index(F.substring(uri, 6, 1 << 30), "/", 1)
    good = (
        (uri.startswith("s3://") | uri.startswith("r2://"))
        & ~contains_any(uri, ("..", "\x00", ";", "|", "&", "$(", "`"))
        & has_extension(uri))
    if buckets:
        good = good & bucket.isin(*buckets)
    return (uri == "") | good


def output_prefix_ok(prefix: Column, user: Column, job: Column, step: Column,
                     task: Column) -> Column:
    # The bucket is whatever the prefix names.
    bucket = F.regexp_extract(prefix, r"(?s)\A.*?://([^/]*)", 1)
    with_task = task_prefix(bucket, user, job, step, task)
    step_only = F.concat(
        F.lit("s3://"), F.concat_ws("/", bucket, user, job, step), F.lit("/"))
    return ~prefix.contains("..") & ((prefix == step_only) | (prefix == with_task))


def params_ok(params: Column) -> Column:
    return size_at_most(params, MAX_PARAMS_BYTES) & depth_at_most(params, MAX_PARAMS_DEPTH)


def check_messages(raw: DataFrame, dag: Dag, buckets: Sequence[str]) -> DataFrame:
    """All rows with the message fields, `reason` and `detail`.

    `reason` is null for an accepted row.  The rules apply in a fixed order and
    only the first failure counts.  No shuffle, no Python.
    """
    c = F.col
    texts = (*_TEXT_FIELDS, *_OPTIONAL_TEXT)
    ddl = ", ".join(f"{n} string" for n in texts) + ", params variant, retry_count variant"
    df = read_payloads(raw, ddl)
    df = df.withColumns({
        **{n: c(f"_r.{n}") for n in texts},
        "_params": c("_r.params"), "_retry": c("_r.retry_count"),
        "params": F.to_json("_r.params")})

    # Most rows show by their texts alone that every member is there and a
    # string.  Only the others are looked at member by member.
    doubtful = c("_params").isNull()
    for n in texts:
        doubtful = doubtful | F.coalesce(may_be_no_string(c(n)), F.lit(n in _TEXT_FIELDS))
    df = df.withColumn("_doubtful", c("_r").isNotNull() & doubtful)
    df = df.withColumns({
        "_m": F.when(c("_doubtful"), members(strict_json(c("_text")), texts)),
        "_retry_kind": kind(c("_retry"))})
    m = {n: c(f"_m.{n}") for n in texts}

    missing = F.concat_ws(
        ", ", *[F.when((m[n] if n in m else c(f"_{n}")).isNull(), F.lit(n))
                for n in REQUIRED_FIELDS])
    no_object = F.when(~is_object_text(c("params")), F.lit("params"))
    # A whole number beyond 64 bits is a decimal without places.
    beyond = F.coalesce(c("_retry_kind").rlike(r"\ADECIMAL\([0-9]+,0\)\z"), F.lit(False))
    no_count = F.when(
        c("_retry").isNotNull() & ~c("_retry_kind").isin("BIGINT", "BOOLEAN") & ~beyond,
        F.lit("retry_count"))
    wrong_type = F.when(c("_doubtful"), F.coalesce(
        *[F.when(~is_string(m[n]), F.lit(n)) for n in _TEXT_FIELDS], no_object, no_count,
        *[F.when(~is_null(m[n]) & ~is_string(m[n]), F.lit(n)) for n in _OPTIONAL_TEXT],
    )).otherwise(F.coalesce(no_object, no_count))
    retries = F.when(
        c("_retry_kind").isin("BIGINT", "BOOLEAN"), F.try_variant_get(c("_retry"), "$", "bigint"))
    df = df.withColumns({
        "retry_count": F.coalesce(retries, F.lit(0)),
        "_missing": F.when(c("_doubtful"), missing).otherwise(""), "_wrong_type": wrong_type,
        "_beyond": beyond})

    checks = [
        ("parse", c("_r").isNotNull(), payload_problem()),
        ("missing", c("_missing") == "", c("_missing")),
        ("type", c("_wrong_type").isNull(), c("_wrong_type")),
        ("retry_range", ~c("_beyond"), F.lit("retry_count")),
        ("user_id", is_id(c("user_id"), MAX_USER_ID), c("user_id")),
        ("job_id", is_id(c("job_id"), MAX_JOB_ID), c("job_id")),
        ("task_id", is_id(c("task_id"), MAX_TASK_ID), c("task_id")),
        ("schema", c("schema").isin(*SCHEMA_VERSIONS), c("schema")),
        ("step", c("step").isin(*dag.names), c("step")),
        ("input_uri", input_uri_ok(c("input_uri"), buckets), c("input_uri")),
        ("output_prefix",
         output_prefix_ok(c("output_prefix"), c("user_id"), c("job_id"), c("step"),
                          c("task_id")), c("output_prefix")),
        ("params", params_ok(c("params")), F.lit("too large or too deep")),
        ("parent", c("parent_task_id").isNull() | is_id(c("parent_task_id"), MAX_TASK_ID),
         c("parent_task_id")),
        ("trace", c("trace_id").isNull() | is_trace_id(c("trace_id"), MAX_TRACE_ID),
         c("trace_id")),
    ]
    verdict = F.coalesce(*[
        F.when(~F.coalesce(ok, F.lit(False)),
               F.struct(F.lit(name).alias("reason"), detail.alias("detail")))
        for name, ok, detail in checks])
    raw_columns = ["message_id", "sent_ts", "receive_count", "body"]
    parsed = [n for n in MESSAGE_COLUMNS if n not in raw_columns]
    return sealed(df.withColumn("_verdict", verdict), raw_columns, [
        *parsed, c("_verdict.reason").alias("reason"), c("_verdict.detail").alias("detail"),
    ]).select(*MESSAGE_COLUMNS, "body", "reason", "detail")


def validate_messages(raw: DataFrame, dag: Dag, buckets: Sequence[str]) -> Validated:
    checked = check_messages(raw, dag, buckets)
    return Validated(
        accepted=checked.filter("reason is null").select(*MESSAGE_COLUMNS),
        rejected=checked.filter("reason is not null").select(
            "message_id", "sent_ts", "receive_count", "reason", "detail", "body"))


def reject_report(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def is_child(parent_task_id: Column) -> Column:
    return parent_task_id.isNotNull()


def fanout_share(accepted: DataFrame) -> DataFrame:
    """Root and child messages per step."""
    child = is_child(F.col("parent_task_id"))
    return accepted.groupBy("step").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(child).alias("children"),
        F.count_if(~child).alias("roots"))
