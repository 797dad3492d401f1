"""Messages through user code to results, outgoing messages and task outcomes, in one commit.

The hook runs once over a run's messages, and its rows, contents among them, are
written once.  Everything after that reads the narrow columns of that table:
which artifacts may be kept decides the outcome of a task, and outcomes
decide what becomes visible, which children are sent and what is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskframe.functions.paths import step_level
from taskframe.operators import fanout, hooks, layout, queues
from taskframe.operators.routing import split_done
from taskframe.schemas import MAX_BODY_BYTES, MAX_WRITE_BYTES, TASK_KEY
from taskframe.sources import commits

RESULTS_QUEUE = "results"
PLACE = ("message_id", "position")
SENT = ("kind", "queue", "body", "delay_seconds", "group_id", "dedup_id")
SENT_SCHEMA = "kind string, body string, delay_seconds int, group_id string, dedup_id string, queue string"


def one_per_task(messages: DataFrame) -> DataFrame:
    """The message of each task with the smallest id; repeated deliveries do no work twice."""
    first = F.min_by(F.struct(*[c for c in messages.columns if c not in TASK_KEY]), "message_id")
    # User code takes far longer than its rows are large, so parts are not joined by their size.
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return messages.repartition(parts, *TASK_KEY).groupBy(*TASK_KEY).agg(first.alias("_m")).select(*TASK_KEY, "_m.*")


def _outcomes(laid: DataFrame, closing: DataFrame) -> DataFrame:
    """Closing rows, with those FAILED that have an artifact which had to be kept and was refused.

    Named files that are refused are left out, and auxiliary values that are no
    file passed over; any other refused artifact fails its task.
    """
    c = F.col
    fatal = (c("shape") != "files") & (c("problem") != "passed_over")
    refused = laid.filter("problem is not null").groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_refused"),
        F.min(F.when(fatal, F.struct("position", "problem"))).alias("_refused"))
    lost = (c("status") == "SUCCEEDED") & c("_refused").isNotNull()
    return closing.join(refused, "message_id", "left").withColumns({
        "status": F.when(lost, "FAILED").otherwise(c("status")),
        "error_code": F.when(lost, hooks.ERROR_CODE).otherwise(c("error_code")),
        "error_message": F.when(lost, F.concat(
            F.lit("artifact "), c("_refused.position").cast("string"), F.lit(" refused: "), c("_refused.problem"),
        )).otherwise(c("error_message")),
        "n_refused": F.coalesce("n_refused", F.lit(0)).cast("bigint")}).drop("_refused")


def _children(rows: DataFrame, laid: DataFrame, done: DataFrame, dag, bucket: str) -> DataFrame:
    """Child messages that start from what their parents really wrote."""
    parents = done.select("message_id", *[n for n, _ in hooks.CARRIED if n != "params"],
                          F.col("n_children").alias("siblings"))
    children = rows.filter(F.col("part") == hooks.CHILD).select(
        *hooks.KEYS, F.col("position").cast("int").alias("child_pos"), F.col("child").alias("_child"))
    children = fanout.child_fields(children.join(parents, "message_id"))
    with_uris = fanout.with_input_uris(children, layout.child_uris(laid))
    made = fanout.fanout_children(with_uris, dag, bucket)
    return made.select(F.lit("child").alias("kind"), "queue", "task_id", F.col("job_id").alias("group_id"),
                       fanout.message_body().alias("body"))


def _completions(done: DataFrame, info: DataFrame, queue: str) -> DataFrame:
    bodies = layout.completions(done.join(info, list(TASK_KEY), "left"))
    return bodies.select(F.lit("completion").alias("kind"), F.lit(queue).alias("queue"), "task_id",
                         F.col("job_id").alias("group_id"), "body")


def run_messages(messages: DataFrame, hook: hooks.Hook, dag, bucket: str, base: str, id: str, config: dict | None = None,
                 listing: DataFrame | None = None, results_queue: str = RESULTS_QUEUE,
                 flush_bytes: int = hooks.FLUSH_BYTES, max_bytes: int = MAX_WRITE_BYTES,
                 max_body: int = MAX_BODY_BYTES) -> None:
    """Work off accepted messages and commit everything they lead to under an id.

    Tasks that a listing of stored objects shows as finished are skipped.  A run
    that stops earlier shows nothing and is repeated as a whole; a run whose id is
    committed does nothing.  FAILED tasks keep no artifact and send nothing.
    `base` belongs to such runs alone.
    """
    spark = messages.sparkSession
    commits.create(spark, base)
    if commits.has(spark, base, id):
        return
    number = commits.next_number(spark, base)
    folders = {n: commits.new_folder(base, n) for n in ("rows", "outcomes", "manifest", "messages")}
    work = one_per_task(messages).withColumn("step_prefix", step_level(F.col("output_prefix")))
    if listing is not None:
        work = split_done(work, listing).pending
    emitted = hooks.stream_hook(work, hook, config, flush_bytes, max_bytes)
    whole = layout.lay_out(emitted, dag, max_bytes).withColumns({
        "sha256": F.sha2("content", 256), "run": F.lit(id)})
    whole.write.partitionBy("part").parquet(folders["rows"])

    # The hook does not run again: from here on all is read from its rows.
    rows = spark.read.schema(whole.schema).parquet(folders["rows"])
    artifacts = rows.filter(F.col("part") == hooks.ARTIFACT).drop("content")
    closing = rows.filter(F.col("part") == hooks.CLOSING).select(
        *hooks.KEYS, "status", "error_code", "error_message", "metrics", "n_artifacts", "n_children",
        *[n for n, _ in hooks.CARRIED])
    _outcomes(artifacts, closing).write.parquet(folders["outcomes"])

    done = spark.read.parquet(folders["outcomes"]).filter("status = 'SUCCEEDED'")
    laid = artifacts.join(done.select("message_id"), "message_id", "left_semi")
    # Of several writes of one URI in a run, the one of the largest message and place counts.
    kept = ("step", "job_id", "task_id", "mime", "shape", "list_pos", "list_size", "file_pos", "kind", "size_bytes", "sha256")
    last = F.max_by(F.struct(*PLACE, *kept), F.struct(*PLACE))
    manifest = laid.filter("problem is null").groupBy("uri").agg(last.alias("_row")).select(
        "uri", "_row.*", F.lit(number).cast("bigint").alias("commit"), F.lit(id).alias("run"))
    manifest.write.parquet(folders["manifest"])

    checked = queues.checked_outbox(_children(rows, laid, done, dag, bucket).unionByName(
        _completions(done, layout.write_info(laid), results_queue)), max_body)
    # A body that cannot be sent stops the run before its commit: nothing may get lost.
    refusal = F.raise_error(F.concat(F.lit("message of task "), "task_id", F.lit(": "), "problem")).cast("string")
    sent = checked.withColumn("body", F.when(F.col("problem").isNull(), F.col("body")).otherwise(refusal))
    sent.select(*SENT).write.partitionBy("queue").parquet(folders["messages"])
    commits.commit(spark, base, id, folders, number=number)


def read_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """One row per message worked off, with its final status."""
    return commits.read(spark, base, "outcomes")


def read_messages(spark: SparkSession, base: str, queue: str | None = None) -> DataFrame:
    """Messages to send, of one queue or of all."""
    rows = commits.read(spark, base, "messages", T._parse_datatype_string(SENT_SCHEMA))
    return (rows if queue is None else rows.where(F.col("queue") == queue)).select(*SENT)


def read_artifacts(spark: SparkSession, base: str) -> DataFrame:
    """The last write of every URI with its content, through the manifest."""
    manifest = commits.read(spark, base, "manifest")
    last = F.max_by(F.struct(*[c for c in manifest.columns if c != "uri"]), F.struct("commit", *PLACE))
    known = manifest.groupBy("uri").agg(last.alias("_row")).select("uri", "_row.*")
    stored = commits.read(spark, base, "rows", T._parse_datatype_string(
        hooks.PART_SCHEMA + ", uri string, run string")).filter(F.col("part") == hooks.ARTIFACT)
    return stored.select("uri", "run", *PLACE, "content").join(known, ["uri", "run", *PLACE])
