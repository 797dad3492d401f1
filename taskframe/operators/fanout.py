"""Child messages of finished tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import is_object_text, json_or_text, strict_json
from taskframe.functions.paths import slot_folder, slot_index, step_level, task_prefix
from taskframe.schemas import SEND_BATCH

PARENT_KEY = ["job_id", "step", "task_id"]
# URIs of a parent that are kept in one row.
FIRST_URIS = 1000


def explode_children(parents: DataFrame) -> DataFrame:
    """Rows of (parent fields, child_pos, child_params, explicit_idx, siblings).

    `parents.children` is an array of JSON texts.  Members that are no object
    become {"data": ..., "index": ...}; an object may name its own `idx`.
    """
    return child_fields(parents.select(
        *[c for c in parents.columns if c != "children"],
        F.size("children").alias("siblings"),
        F.posexplode("children").alias("child_pos", "_child")))


def child_fields(df: DataFrame) -> DataFrame:
    """Replace the JSON text `_child` at `child_pos` by child_params and explicit_idx."""
    doc = strict_json(F.col("_child"))
    wrapped = F.to_json(F.struct(
        F.coalesce(doc, F.col("_child").cast("variant")).alias("data"),
        F.col("child_pos").alias("index")))
    is_object = is_object_text(F.to_json(doc))
    return df.withColumns({
        "child_params": F.when(is_object, F.to_json(doc)).otherwise(wrapped),
        "explicit_idx": F.when(is_object, F.try_variant_get(doc, "$.idx", "string")),
    }).drop("_child")


def with_siblings(children: DataFrame) -> DataFrame:
    """Add the number of children of the same parent."""
    counts = children.groupBy(*PARENT_KEY).agg(F.count(F.lit(1)).alias("siblings"))
    # Every child of a known parent has a count, so an outer join gives the same rows,
    # and who does not use the counts does not pay for them.
    return children.dropna(subset=PARENT_KEY).join(counts, PARENT_KEY, "left")


def with_input_uris(children: DataFrame, uris: DataFrame) -> DataFrame:
    """Add `written_uri`: the URI at the child's position, or the last one.

    Null for a parent that wrote none.  `uris` holds one row per written URI:
    parent key, uri_pos from 0 without gaps, uri.
    """
    pos = F.col("child_pos")
    # The first URIs of a parent stand in its one row, so most children need only the
    # join on the parent.  The few beyond them meet one URI each; their join on
    # the parent can be skewed, and there the split side is the one adaptive
    # execution can cut.
    early = F.when(F.col("uri_pos") < FIRST_URIS, F.struct(F.col("uri_pos").alias("pos"), F.col("uri").alias("uri")))
    written = uris.groupBy(*PARENT_KEY).agg(
        F.max_by("uri", "uri_pos").alias("_last_uri"), F.array_sort(F.collect_list(early)).alias("_first"))
    own = F.get("_first", pos)
    near = children.filter(F.coalesce(pos < FIRST_URIS, F.lit(True))).join(written, PARENT_KEY, "left").withColumn(
        "written_uri", F.coalesce(F.when(own["pos"] == pos, own["uri"]), "_last_uri"))

    last = uris.groupBy(*PARENT_KEY).agg(F.max_by("uri", "uri_pos").alias("_last_uri"))
    exact = uris.filter(F.col("uri_pos") >= FIRST_URIS).select(
        *PARENT_KEY, F.col("uri_pos").alias("child_pos"), F.col("uri").alias("_own_uri"))
    far = (
        children.filter(pos >= FIRST_URIS).join(last, PARENT_KEY, "left")
        .join(exact, [*PARENT_KEY, "child_pos"], "left")
        .withColumn("written_uri", F.coalesce("_own_uri", "_last_uri")))
    columns = [*children.columns, "written_uri"]
    return near.select(columns).unionByName(far.select(columns))


def fanout_children(children: DataFrame, dag, bucket: str) -> DataFrame:
    """One message per child and next step of its parent's step.

    `children` carries the parent fields, child_pos, child_params,
    explicit_idx, siblings and written_uri.  A lone child without an index of
    its own keeps its parent's slot.  Terminal steps emit nothing.  A child whose
    parent wrote nothing reads from the parent's own step prefix: that of its
    output_prefix if given, else the one of `bucket`.
    """
    c = F.col
    index = F.coalesce(
        c("explicit_idx").cast("string"),
        F.when(c("siblings") == 1, slot_index(c("task_id")).cast("string")),
        c("child_pos").cast("string"))
    step_folder = F.concat(
        F.lit(f"s3://{bucket}/"), F.concat_ws("/", "user_id", "job_id", "step"), F.lit("/"))
    if "output_prefix" in children.columns:
        step_folder = F.coalesce(step_level(c("output_prefix")), step_folder)
    computed = F.concat(slot_folder(step_folder, index), dag.primary_name(c("step")))
    df = children.withColumns({"_id": F.concat(F.lit("S"), index), "_computed": computed})
    df = df.select("*", F.explode(dag.next_steps(c("step"))).alias("next_step"))
    trace = c("trace_id") if "trace_id" in children.columns else F.lit(None).cast("string")
    return df.select(
        "job_id", c("_id").alias("task_id"), "user_id", "schema",
        c("next_step").alias("step"),
        F.coalesce("written_uri", "_computed").alias("input_uri"),
        task_prefix(F.lit(bucket), c("user_id"), c("job_id"), c("next_step"), c("_id"))
        .alias("output_prefix"),
        c("child_params").alias("params"), c("task_id").alias("parent_task_id"),
        trace.alias("trace_id"), F.lit(0).alias("retry_count"),
        c("step").alias("parent_step"), "child_pos", dag.queue(c("next_step")).alias("queue"))


def message_body() -> Column:
    """JSON body of a child message."""
    return F.to_json(F.struct(
        "job_id", "task_id", "user_id", "schema", "step", "input_uri", "output_prefix",
        json_or_text(F.col("params")).alias("params"), "parent_task_id", "trace_id", "retry_count"))


def batches(messages: DataFrame) -> DataFrame:
    """Number the sends: ten consecutive children of a parent per batch and step.

    Child positions have no gaps, so they give the batch without any window.
    """
    return messages.withColumns({
        "batch_no": F.floor(F.col("child_pos") / SEND_BATCH).cast("int"),
        "entry_id": F.concat(F.lit("m"), (F.col("child_pos") % SEND_BATCH).cast("string"))})
