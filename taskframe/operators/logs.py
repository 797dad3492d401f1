"""Structured log records: reading, filtering, context, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import strict_json
from taskframe.functions.paths import literal_map
from taskframe.operators.percentiles import grouped_percentile

# Log levels in order.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40}
UNKNOWN_LEVEL = 100
CORE_FIELDS = ("timestamp", "level", "logger", "msg")


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Core columns and `extras` of JSON log lines; bad lines have null columns."""
    doc = strict_json(F.col("value"))
    df = lines.select("value", F.try_variant_get(doc, "$", "map<string,string>").alias("_m"))
    core = [F.try_element_at(F.col("_m"), F.lit(n)).alias(n) for n in CORE_FIELDS]
    extras = F.map_filter("_m", lambda k, _: ~k.isin(*CORE_FIELDS))
    return df.select(*core, extras.alias("extras"), F.col("_m").isNotNull().alias("parsed"))


def level_rank(level: Column) -> Column:
    """Unknown levels rank above all others and always pass a threshold."""
    return F.coalesce(F.element_at(literal_map(LEVELS), level), F.lit(UNKNOWN_LEVEL))


def log_filter(records: DataFrame, threshold: str = "INFO") -> DataFrame:
    lowest = LEVELS.get(threshold.upper(), LEVELS["INFO"])
    return records.filter(level_rank(F.col("level")) >= lowest)


def with_context(records: DataFrame, context: DataFrame, on: list[str]) -> DataFrame:
    """Bound context under each record's own extras.

    `context` has one row per key with a MAP column `context`; `records` a MAP
    column `extras`.  Extras win over context, core fields over both.
    """
    bound = records.join(context, on, "left")
    blank = F.create_map().cast("map<string,string>")
    extras = F.coalesce("extras", blank)
    below = F.map_filter(
        F.coalesce("context", blank),
        lambda k, _: ~k.isin(*CORE_FIELDS) & ~F.map_contains_key(extras, k))
    own = F.map_filter(extras, lambda k, _: ~k.isin(*CORE_FIELDS))
    return bound.withColumn("extras", F.map_concat(below, own)).drop("context")


def log_latency(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records, errors, warnings and p95 latency in milliseconds, unrounded."""
    return grouped_percentile(records, keys, "latency_ms", 0.95, "p95_ms", [
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings")])
