"""Where the artifacts of finished tasks go, and what is reported about them.

Result items are rows: task key, `shape`, `list_pos` and `list_size` for list
results, `file_pos`, `file_name`, `kind` (`bytes` or `json`) and `size_bytes`.
Shapes: `single`, `files` (named files), `aux` (step level), `metrics`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import computed_once, json_or_text
from taskframe.functions.paths import (
    clean_file_name, content_type, file_name_problem, has_extension, slot_folder,
    slot_index,
)
from taskframe.functions.text import strip
from taskframe.operators.ranking import positions
from taskframe.schemas import MAX_WRITE_BYTES, TASK_KEY


class Layout(NamedTuple):
    written: DataFrame
    refused: DataFrame


def lay_out(items: DataFrame, dag, max_bytes: int = MAX_WRITE_BYTES) -> DataFrame:
    """Add folder, name, URI, content type and `problem` (null when writable).

    Lists of two or more items go to slots 0..n-1 under fixed names.  Any other
    result goes to the slot of its task: named files under their cleaned names,
    the rest under the step's main artifact name.  Auxiliary files and metrics
    stay at step level; auxiliary values that are no file are passed over.
    """
    c = F.col
    step_level = c("shape").isin("aux", "metrics")
    is_list = F.coalesce(c("list_size") > 1, F.lit(False)) & ~step_level
    json_kind = c("kind") == "json"
    folder = F.when(step_level, c("step_prefix")).when(
        is_list, slot_folder(c("step_prefix"), c("list_pos")),
    ).otherwise(slot_folder(c("step_prefix"), slot_index(c("task_id"))))
    name = (
        F.when(c("shape") == "metrics", "metrics.json")
        .when(c("shape") == "aux", c("file_name"))
        .when(c("shape") == "files", clean_file_name(c("file_name")))
        .when(is_list, F.when(json_kind, "result.json").otherwise("result.png"))
        .otherwise(dag.primary_name(c("step"))))
    df = computed_once(items, folder=folder, name=name)
    known_kind = F.coalesce(c("kind").isin("bytes", "json"), F.lit(False))
    bad_aux = file_name_problem(c("step_prefix"), c("name")).isNotNull()
    problem = (
        F.when(c("name").isNull() | ((c("shape") == "aux") & bad_aux), "file_name")
        .when(~known_kind & (c("shape") == "aux"), "passed_over")
        .when(~known_kind, "type")
        .when(c("list_size") == 0, "empty_list")
        .when(c("size_bytes") > max_bytes, "size")
        .when(~has_extension(c("name")), "extension"))
    mime = F.when(json_kind, "application/json; charset=utf-8").otherwise(
        content_type(c("name")))
    df = computed_once(df, problem=problem)
    good = c("problem").isNull()
    return df.withColumns({
        "uri": F.when(good, F.concat("folder", "name")), "mime": F.when(good, mime)})


def result_layout(items: DataFrame, dag, max_bytes: int = MAX_WRITE_BYTES) -> Layout:
    laid = lay_out(items, dag, max_bytes)
    return Layout(
        written=laid.filter("problem is null").drop("problem"),
        refused=laid.filter("problem is not null").drop("uri", "mime"))


def starts_with_result(name: Column) -> Column:
    return F.lower(name).startswith("result")


def result_uris(laid: DataFrame) -> DataFrame:
    """The result URI of each task, or of each item of a list of several.

    Among named files it is the first one named result*, else the first; if
    that one could not be written, the first that was, without a size.
    """
    c = F.col
    results = laid.filter(~c("shape").isin("aux", "metrics")).withColumn(
        "list_pos", F.when(c("list_size") > 1, c("list_pos")))
    choice = F.struct(
        (~F.coalesce(starts_with_result(c("file_name")), F.lit(True))).alias("later"),
        F.coalesce("file_pos", F.lit(0)).alias("file_pos"))
    good = c("problem").isNull()
    picked = results.groupBy(*TASK_KEY, "list_pos").agg(
        F.min(choice).alias("_wanted"),
        F.min(F.when(good, F.struct(
            choice.alias("choice"), "uri", "mime", "size_bytes"))).alias("_best"),
        F.min(F.when(good, F.struct("file_pos", "uri", "mime"))).alias("_first"))
    met = c("_best.choice") == c("_wanted")
    return picked.filter(c("_best").isNotNull()).select(
        *TASK_KEY, "list_pos",
        F.when(met, c("_best.uri")).otherwise(c("_first.uri")).alias("result_uri"),
        F.when(met, c("_best.mime")).otherwise(c("_first.mime")).alias("result_mime"),
        F.when(met, c("_best.size_bytes")).alias("result_size"))


def primary_result(laid: DataFrame) -> DataFrame:
    """URI, content type and size of each task's main artifact; none for lists."""
    return result_uris(laid).filter("list_pos is null").select(
        *TASK_KEY, F.col("result_uri").alias("primary_result_uri"),
        F.col("result_mime").alias("primary_mime"),
        F.col("result_size").alias("primary_size_bytes"))


def child_uris(laid: DataFrame) -> DataFrame:
    """The result URIs children can start from, numbered from 0 within a task."""
    found = result_uris(laid).select(
        *TASK_KEY, F.coalesce("list_pos", F.lit(0)).cast("bigint").alias("_pos"),
        F.col("result_uri").alias("uri"))
    keyed = found.withColumns({
        "_task": F.concat_ws("/", *TASK_KEY), "_block": F.floor(F.col("_pos") / 100_000)})
    return positions(keyed, "_task", ["_block", "_pos"], "uri_pos").select(
        *TASK_KEY, F.col("uri_pos").cast("int").alias("uri_pos"), "uri")


def write_info(laid: DataFrame) -> DataFrame:
    """One row per task: primary artifact, first child URI and metrics URI."""
    c = F.col
    results = result_uris(laid).groupBy(*TASK_KEY).agg(
        F.min_by("result_uri", F.coalesce("list_pos", F.lit(0))).alias("first_child_uri"),
        F.max(F.when(c("list_pos").isNull(), F.struct(
            "result_uri", "result_mime", "result_size"))).alias("_p"))
    metrics = laid.filter("shape = 'metrics' and problem is null").groupBy(*TASK_KEY).agg(
        F.max("uri").alias("metrics_uri"))
    return results.join(metrics, list(TASK_KEY), "full").select(
        *TASK_KEY, c("_p.result_uri").alias("primary_result_uri"),
        c("_p.result_mime").alias("primary_mime"),
        c("_p.result_size").alias("primary_size_bytes"), "metrics_uri", "first_child_uri")


def extra_uris(laid: DataFrame) -> DataFrame:
    """Entries of each task's `extra`: item_<n> of lists, and auxiliary files."""
    items = result_uris(laid).filter("list_pos is not null").select(
        *TASK_KEY, F.concat(F.lit("item_"), F.col("list_pos").cast("string")).alias("entry"),
        F.col("result_uri").alias("uri"))
    aux = laid.filter("shape = 'aux' and problem is null").select(
        *TASK_KEY, F.col("name").alias("entry"), "uri")
    return items.unionByName(aux)


def step_metrics(rows: DataFrame) -> DataFrame:
    """The metrics kept at step level: the last write of a step prefix."""
    return (
        rows.groupBy("step_prefix")
        .agg(F.max_by(F.struct("metrics", "task_id"), "seq").alias("_last"))
        .select("step_prefix", F.concat("step_prefix", F.lit("metrics.json")).alias("metrics_uri"),
                "_last.*"))


def completions(tasks: DataFrame) -> DataFrame:
    """One completion body per finished task.

    `tasks` carries the message fields, write information and
    `first_child_uri`, the stand-in for a missing primary URI.
    """
    c = F.col
    primary = F.coalesce(
        F.nullif(c("primary_result_uri"), F.lit("")), c("first_child_uri")).cast("variant")
    record = F.struct(
        "schema", "job_id", "task_id", "user_id",
        strip(F.upper("step")).alias("step"),
        F.coalesce("input_uri", F.lit("")).alias("input_uri"), "output_prefix",
        json_or_text(F.coalesce("params", F.lit("{}"))).alias("params"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        # Named even when there is none.
        F.coalesce(primary, F.parse_json(F.lit("null"))).alias("primary_result_uri"),
        F.nullif(c("metrics_uri"), F.lit("")).alias("metrics_uri"),
        F.nullif(c("primary_mime"), F.lit("")).alias("primary_mime"),
        "primary_size_bytes", "trace_id", "parent_task_id")
    return tasks.select(*TASK_KEY, F.to_json(record).alias("body"))
