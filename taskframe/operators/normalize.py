"""Work-queue message contract: normalised rows or a reason for refusal."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import (
    as_text, computed_once, is_null, is_object_text, is_string, kind, members, sealed,
    strict_json, with_strict_struct,
)
from taskframe.functions.text import (
    has_control_char, is_blank, is_bucket_name, strip,
)
from taskframe.schemas import DEFAULT_TASK_ID

REQUIRED_KEYS = (
    "input_uri", "job_id", "output_prefix", "params", "retry_count", "schema", "step",
    "task_id", "user_id",
)
WORK_COLUMNS = (
    "message_id", "job_id", "task_id", "user_id", "schema", "step", "input_uri",
    "output_prefix", "params", "retry_count", "parent_task_id",
)

# Published names of the rules.
RULES = (
    "json_root_object",
    "required_keys_match_dataclass_minus_parent_task_id",
    "params_object_retry_count_int_non_negative",
    "user_id_step_non_empty_step_uppercase",
    "task_id_default_S0",
    "job_id_hex_8_or_32_lowercased",
    "s3_uri_bucket_matches_expected_bucket",
    "s3_bucket_name_pattern",
    "output_prefix_directory_ends_with_slash",
    "s3_key_no_control_chars",
    "s3_hex_segments_lower",
)


class Normalized(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def plain_text(value: Column) -> Column:
    """Members of any scalar type as text."""
    return (
        F.when(F.is_variant_null(value), "None")
        .when(kind(value) == "BOOLEAN", F.initcap(as_text(value)))
        .otherwise(as_text(value)))


def integer(value: Column) -> Column:
    """Integers, truncated decimals, booleans and digit strings; null counts as 0."""
    digits = as_text(value)
    # Digits before the point, so nothing is rounded; exponents go through doubles.
    whole = F.regexp_extract(digits, r"\A([+-]?[0-9]+)(?:\.[0-9]*)?\z", 1)
    from_text = F.when(
        digits.rlike(r"(?U)\A\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"),
        F.replace(strip(digits), F.lit("_"), F.lit("")).try_cast("bigint"))
    return (
        F.when(F.is_variant_null(value), F.lit(0).cast("bigint"))
        .when(is_string(value), from_text)
        .when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "int").cast("bigint"))
        .when(whole != "", whole.try_cast("bigint"))
        .otherwise(F.try_variant_get(value, "$", "double").try_cast("bigint")))


def normal_job_id(job_id: Column) -> Column:
    """Trimmed; eight or thirty-two hex digits in lower case."""
    j = strip(job_id)
    return F.when(j.rlike(r"\A(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32})\z"), F.lower(j)).otherwise(j)


def lower_hex_segments(key: Column) -> Column:
    """Path segments that decode to eight or thirty-two hex digits, decoded and lowered."""
    def segment(seg: Column) -> Column:
        plain = F.when(
            seg.contains("%"),
            F.coalesce(F.try_url_decode(F.replace(seg, F.lit("+"), F.lit("%2B"))), seg),
        ).otherwise(seg)
        return F.when(
            plain.rlike(r"\A(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32})\n?\z"), F.lower(plain),
        ).otherwise(seg)

    # Without an escape or a hex segment in capitals there is nothing to do.
    touched = key.rlike(
        r"%|(?:\A|/)(?=[0-9a-f]*[A-F])(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32})(?:/|\z)")
    return F.when(
        touched, F.array_join(F.transform(F.split(key, "/"), segment), "/")).otherwise(key)


def s3_problem(uri: Column, role: str, expected_bucket: str) -> Column:
    """First rule a trimmed URI breaks; `role` prefixes the name of the rule."""
    path = F.substring(uri, 6, 1 << 30)
    bucket = F.substring_index(path, "/", 1)
    return (
        F.when(uri == "", f"{role}_empty")
        .when(~uri.startswith("s3://"), f"{role}_scheme")
        .when(~path.contains("/") | path.rlike(r"\A(?:/|[^/]*/\z)"), f"{role}_shape")
        .when(~is_bucket_name(bucket), f"{role}_bucket_name")
        .when(bucket != expected_bucket, f"{role}_bucket")
        .when(has_control_char(F.substring(path, F.length(bucket) + 2, F.lit(1 << 30))),
              f"{role}_control"))


def normal_uri(uri: Column, directory: bool) -> Column:
    path = F.substring(uri, 6, 1 << 30)
    bucket = F.substring_index(path, "/", 1)
    key = lower_hex_segments(F.substring(path, F.length(bucket) + 2, F.lit(1 << 30)))
    if directory:
        key = F.when(key.endswith("/"), key).otherwise(F.concat(key, F.lit("/")))
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), key)


def check_work_messages(raw: DataFrame, expected_bucket: str) -> DataFrame:
    """All rows with the normalised fields and `reason` (null when accepted)."""
    c = F.col
    texts = ("job_id", "task_id", "user_id", "schema", "step", "input_uri", "output_prefix")
    ddl = ", ".join(f"{n} string" for n in texts) + (
        ", params variant, retry_count variant, parent_task_id variant")
    df = with_strict_struct(raw, "_r", "body", ddl)
    # Absent, null and boolean members look alike as text; rows with one of
    # them are looked at member by member.
    doubtful = c("_r.params").isNull() | c("_r.retry_count").isNull()
    for n in texts:
        doubtful = doubtful | c(f"_r.{n}").isNull() | c(f"_r.{n}").isin("true", "false")
    df = df.withColumn("_doubtful", c("_r").isNotNull() & doubtful)
    df = df.withColumn("_m", F.when(
        c("_doubtful"), members(strict_json(c("body")), REQUIRED_KEYS)))
    missing = F.lit(False)
    for name in REQUIRED_KEYS:
        missing = missing | c(f"_m.{name}").isNull()
    df = df.withColumns({
        **{f"_t_{n}": strip(F.when(c("_doubtful"), plain_text(c(f"_m.{n}")))
                            .otherwise(c(f"_r.{n}"))) for n in texts},
        "params": F.to_json("_r.params"),
        "retry_count": integer(c("_r.retry_count")),
        "_parent": c("_r.parent_task_id"),
        "parent_task_id": as_text(c("_r.parent_task_id")),
        "_missing": c("_doubtful") & missing})
    reason = F.coalesce(
        F.when(c("_r").isNull(), F.when(
            strict_json(c("body")).isNull(), "parse").otherwise("root")),
        F.when(c("_missing"), "missing"),
        F.when(~is_object_text(c("params")), "params"),
        F.when(c("retry_count").isNull(), "retry"),
        F.when(~is_null(c("_parent")) & ~is_string(c("_parent")), "parent"),
        F.when(c("_t_job_id") == "", "job_id"),
        s3_problem(c("_t_input_uri"), "input", expected_bucket),
        s3_problem(c("_t_output_prefix"), "prefix", expected_bucket),
        F.when(c("_t_user_id") == "", "user_id"),
        F.when(c("_t_step") == "", "step"),
        F.when(c("retry_count") < 0, "retry"))
    df = df.withColumn("reason", reason)
    good = c("reason").isNull()
    fields = {
        "job_id": normal_job_id(c("_t_job_id")),
        "task_id": F.when(c("_t_task_id") == "", DEFAULT_TASK_ID).otherwise(c("_t_task_id")),
        "user_id": c("_t_user_id"),
        "schema": F.when(c("_t_schema") == "", "v1").otherwise(c("_t_schema")),
        "step": F.upper(c("_t_step")),
        "input_uri": normal_uri(c("_t_input_uri"), directory=False),
        "output_prefix": normal_uri(c("_t_output_prefix"), directory=True),
    }
    return sealed(df, ["message_id", "body"], [
        *[F.when(good, v).alias(n) for n, v in fields.items()],
        "params", "retry_count", "parent_task_id", "reason"])


def normalize_messages(raw: DataFrame, expected_bucket: str) -> Normalized:
    checked = check_work_messages(raw, expected_bucket)
    return Normalized(
        accepted=checked.filter("reason is null").select(*WORK_COLUMNS),
        rejected=checked.filter("reason is not null").select("message_id", "reason", "body"))


def prepare_uris(df: DataFrame, expected_bucket: str) -> DataFrame:
    """Normalise job_id, input_uri and output_prefix of a table of tasks.

    `problem` names the first rule broken; the three columns are null then.
    """
    c = F.col
    trimmed = computed_once(
        df.withColumnsRenamed({"job_id": "_j", "input_uri": "_i", "output_prefix": "_o"}),
        _tj=strip(c("_j")), _ti=strip(c("_i")), _to=strip(c("_o")))
    problem = F.coalesce(
        F.when(is_blank(c("_tj")), "job_id"),
        s3_problem(F.coalesce("_ti", F.lit("")), "input", expected_bucket),
        s3_problem(F.coalesce("_to", F.lit("")), "prefix", expected_bucket))
    checked = computed_once(trimmed, problem=problem)
    good = c("problem").isNull()
    return checked.select(
        *[n for n in df.columns if n not in ("job_id", "input_uri", "output_prefix")],
        F.when(good, normal_job_id(c("_tj"))).alias("job_id"),
        F.when(good, normal_uri(c("_ti"), directory=False)).alias("input_uri"),
        F.when(good, normal_uri(c("_to"), directory=True)).alias("output_prefix"),
        "problem")
