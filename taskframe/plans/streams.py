"""The streaming jobs, run over the tables as they would land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.operators import transitions
from taskframe.plans.messages import ACCEPTED, BUCKET, CHECKED, RAW
from taskframe.plans.registry import Jobs
from taskframe.plans.state import TASK_STATE, first_states
from taskframe.schemas import TASK_KEY
from taskframe.session import scratch_dir
from taskframe.sources import commits
from taskframe.sources.dag import Dag
from taskframe.sources.tables import derived, source, table
from taskframe.streaming import barrier
from taskframe.streaming import messages as message_streams
from taskframe.streaming import state as state_streams

JOBS = Jobs()


def landed(spark: SparkSession, rows: DataFrame, records_per_file: int = 20_000,
           files_per_trigger: int = 64, batches: int = 1) -> DataFrame:
    """A table written as it is partitioned, in files of bounded size, and read
    back as a stream, in so many batches at least where there are as many files."""
    folder = scratch_dir(spark, "landing")
    rows.write.option("maxRecordsPerFile", records_per_file).parquet(folder)
    if batches > 1:
        files = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
        files_per_trigger = max(1, min(files_per_trigger, files // batches))
    return (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def validated(spark: SparkSession, sf_dir: str) -> str:
    events = landed(spark, source(spark, sf_dir, "events"))
    out = scratch_dir(spark, "validated")
    message_streams.stream_validate(
        derived(spark, "raw_messages", events=events), Dag.default(), [BUCKET], out,
        scratch_dir(spark, "progress")).awaitTermination()
    return out


@JOBS.add("stream_validate", RAW, ACCEPTED + "select * from accepted")
def _stream_validate(spark, sf_dir):
    return message_streams.read_accepted(spark, validated(spark, sf_dir))


@JOBS.add("stream_rejects", RAW, CHECKED + """
select reason, count(*) as messages from checked where reason is not null group by reason""")
def _stream_rejects(spark, sf_dir):
    return message_streams.read_rejected(spark, validated(spark, sf_dir)).groupBy(
        "reason").agg(F.count(F.lit(1)).alias("messages"))


@JOBS.add("stream_transitions", ("task_events",), TASK_STATE)
def _stream_transitions(spark, sf_dir):
    """Transitions out of order and some of them twice, in several micro-batches."""
    events = table(spark, sf_dir, "task_events")
    moves = events.filter("status <> 'QUEUED'").select(*TASK_KEY, "seq", "ts", "status", "error_code")
    twice = moves.withColumn("copy", F.lit(0)).unionByName(moves.where("seq % 7 = 0").withColumn("copy", F.lit(1)))
    parts = max(4, spark.sparkContext.defaultParallelism)
    mixed = twice.repartition(parts, F.xxhash64("seq", "copy")).drop("copy")
    base = scratch_dir(spark, "state")
    state_streams.stream_transitions(
        landed(spark, mixed, batches=4), base, scratch_dir(spark, "progress")).awaitTermination()
    moved = transitions.apply_moves(
        first_states(events), state_streams.read_state(spark, base, "moves"), state_streams.read_state(spark, base, "retries"))
    return moved.select(*TASK_KEY, "user_id", "status", "retry_count", "updated_at", "started_at", "finished_at", "error_code")


@JOBS.add("stream_barrier", ("task_events",), """
select job_id, 'STITCH' as step, 'S0' as task_id, step as joined_step, count(distinct task_id) as siblings
from task_events where step = 'VIDEO_GENERATION' group by job_id, step
having count(distinct task_id) = count(distinct task_id) filter (status = 'SUCCEEDED')""")
def _stream_barrier(spark, sf_dir):
    """Events out of order and some of them twice, in several micro-batches, with a compaction and a restart between."""
    events = table(spark, sf_dir, "task_events").select(*TASK_KEY, "seq", "ts", "status")
    expected = events.groupBy("job_id", "step").agg(F.count_distinct("task_id").alias("siblings"))
    base, progress, landing = (scratch_dir(spark, p) for p in ("barrier", "progress", "landing"))

    def arrive(parts):
        parts.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 2).parquet(landing)
        barrier.stream_barrier(stream, expected, Dag.default(), base, progress).awaitTermination()

    arrive(events.where("seq % 3 <> 0").repartition(4, F.xxhash64("seq")))
    state_streams.compact(spark, base)
    arrive(events.where("seq % 3 = 0 or seq % 7 = 0").repartition(2, F.xxhash64("seq")))
    return barrier.read_released(spark, base)


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "completion_rows").withColumns({
        "schema": F.lit("v1"), "trace_id": F.lit(None).cast("string")})


STORED = """
select job_id, step, task_id, min_by(user_id, seq) as user_id, max_by(status, seq) as status, max_by(retry_count, seq) as retry_count,
  max_by(params, seq) as params, arg_max_null(error_code, seq) as error_code, min_by(ts, seq) as created_at, max_by(ts, seq) as updated_at,
  min(seq) as first_seq, max(seq) as last_seq
from completion_rows {} group by job_id, step, task_id"""


@JOBS.add("state_after_compaction", ("completion_rows",), STORED.format(""))
def _state_after_compaction(spark, sf_dir):
    """A base, a batch committed after it, and one of another writer that is half written."""
    rows, base = completed(spark, sf_dir), scratch_dir(spark, "state")
    commits.create(spark, base)
    for n in range(2):
        state_streams.write_state(spark, base, f"batch-{n}", state_streams.fold_batch(rows.where(F.col("seq") % 3 == n)))
    state_streams.compact(spark, base)
    state_streams.write_state(spark, base, "batch-2", state_streams.fold_batch(rows.where("seq % 3 = 2")))
    state_streams.fold_batch(rows.withColumn("seq", F.col("seq") + 10**9))["tasks"].write.parquet(
        commits.new_folder(base, "tasks"))
    return state_streams.read_state(spark, base, "tasks")


@JOBS.add("purge_stored_state", ("completion_rows",), STORED.format(
    "where seq % 3 = 2 or job_id not in (select job_id from completion_rows where seq % 120 = 7)"))
def _purge_stored_state(spark, sf_dir):
    """Purged jobs are gone from the stored state, but for what came after the purge."""
    rows, base = completed(spark, sf_dir), scratch_dir(spark, "state")
    commits.create(spark, base)
    state_streams.write_state(spark, base, "before", state_streams.fold_batch(rows.where("seq % 3 <> 2")))
    state_streams.purge(spark, base, "purge", rows.where("seq % 120 = 7"))
    state_streams.write_state(spark, base, "after", state_streams.fold_batch(rows.where("seq % 3 = 2")))
    return state_streams.read_state(spark, base, "tasks")


def upserted(spark: SparkSession, sf_dir: str) -> str:
    base = scratch_dir(spark, "state")
    state_streams.stream_upsert(
        landed(spark, completed(spark, sf_dir)), base, scratch_dir(spark, "progress")).awaitTermination()
    return base


@JOBS.add("stream_upsert", ("completion_rows",), STORED.format(""))
def _stream_upsert(spark, sf_dir):
    return state_streams.read_state(spark, upserted(spark, sf_dir), "tasks")


@JOBS.add("stream_upsert_results", ("completion_rows",), """
select job_id, step, task_id, max_by(primary_result_uri, seq) as primary_result_uri, max_by(extra, seq) as extra, max(seq) as last_seq
from completion_rows
where status = 'SUCCEEDED' and (primary_result_uri <> '' or metrics_uri <> '' or primary_mime is not null or primary_size_bytes is not null)
group by job_id, step, task_id""")
def _stream_upsert_results(spark, sf_dir):
    results = state_streams.read_state(spark, upserted(spark, sf_dir), "results")
    return results.select(
        "job_id", "step", "task_id", "primary_result_uri", "extra", "last_seq")


@JOBS.add("stream_dedup", ("send_rows",), """
select distinct job_id, coalesce(dedup_id, task_id) as dedup_id from send_rows""")
def _stream_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "send_rows").select("job_id", "task_id", "dedup_id", "ts", "seq")
    kept = message_streams.dedup_stream(
        landed(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")),
        ["job_id"], "ts", "60 days")
    out = scratch_dir(spark, "deduplicated")
    query = (
        kept.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_dir(spark, "progress"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out).select("job_id", "dedup_id")
