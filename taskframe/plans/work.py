"""Jobs over queues, routing, finished work, logs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskframe.operators import audit, logs, queues, routing
from taskframe.plans.fanout import CHILD_TABLES, CHILDREN, child_messages
from taskframe.plans.messages import (
    ACCEPTED, BUCKET, CHECKED, RAW, accepted_messages,
)
from taskframe.operators.validate import check_messages
from taskframe.plans.registry import Jobs
from taskframe.plans.state import TASKS, tasks_of
from taskframe.schemas import TASK_KEY
from taskframe.sources.dag import Dag
from taskframe.sources.objects import hourly_objects, list_objects, read_json_objects, read_objects
from taskframe.sources.tables import table
from taskframe.sources.messages import read_log_lines, write_log_lines

JOBS = Jobs()

# --- sources ----------------------------------------------------------------


@JOBS.add("step_edges", ("task_events", "step_def", "step_edge"), """
select e.step, e.pos, e.next_step, s.queue, n.filetype, n.join_to, count(*) as events
from task_events t join step_edge e using (step) join step_def s using (step) join step_def n on n.step = e.next_step
group by all""")
def _step_edges(spark, sf_dir):
    """Events per edge of the step graph that leaves their step."""
    dag = Dag.default()
    per_step = table(spark, sf_dir, "task_events").groupBy("step").agg(
        F.count(F.lit(1)).alias("events"))
    edges = dag.edge_table(spark)
    return F.broadcast(edges).join(per_step, "step").select(
        "step", "pos", "next_step", dag.queue(F.col("step")).alias("queue"),
        dag.filetype(F.col("next_step")).alias("filetype"),
        dag.join_step(F.col("next_step")).alias("join_to"), "events")


@JOBS.add("object_listing", (), """
select count(*) as objects, count(*) filter (n > 0) as filled from (select 1 as n from (select distinct date_trunc('hour', ts) from events))""")
def _object_listing(spark, sf_dir):
    folder = hourly_objects(spark, table(spark, sf_dir, "events"))
    return list_objects(spark, folder).agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("size") > 0).alias("filled"))


@JOBS.add("scan_objects", (), """
select content_type, count(*) as objects, cast(sum(size) as bigint) as bytes from (
  select 'application/json; charset=utf-8' as content_type,
    length(concat('{"hour":"', strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00.000'), '","events":', count(*), ',"users":', count(distinct user_id), '}')) + 1 as size
  from events group by date_trunc('hour', ts)) group by content_type""")
def _scan_objects(spark, sf_dir):
    folder = hourly_objects(spark, table(spark, sf_dir, "events"))
    return read_objects(spark, folder).read.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


@JOBS.add("scan_json_objects", (), """
select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00.000') as hour, count(*) as events, count(distinct user_id) as users
from events group by date_trunc('hour', ts)""")
def _scan_json_objects(spark, sf_dir):
    folder = hourly_objects(spark, table(spark, sf_dir, "events"))
    parsed = read_json_objects(spark, folder).parsed
    return parsed.select(
        F.try_variant_get("doc", "$.hour", "string").alias("hour"),
        F.try_variant_get("doc", "$.events", "bigint").alias("events"),
        F.try_variant_get("doc", "$.users", "bigint").alias("users"))


@JOBS.add("refused_objects", (), """
select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00.000') as hour, 'too_large' as reason, size
from (select ts, length(concat('{"hour":"', strftime(ts, '%Y-%m-%dT%H:00:00.000'), '","events":', n, ',"users":', users, '}')) + 1 as size
  from (select date_trunc('hour', ts) as ts, count(*) as n, count(distinct user_id) as users from events group by all))
where size > 59""")
def _refused_objects(spark, sf_dir):
    """Objects over a limit that is low enough to bite, with their sizes."""
    folder = hourly_objects(spark, table(spark, sf_dir, "events"))
    refused = read_objects(spark, folder, max_bytes=59).refused
    everything = read_json_objects(spark, folder).parsed
    return everything.join(refused, "path").select(
        F.try_variant_get("doc", "$.hour", "string").alias("hour"), "reason", "size")


@JOBS.add("log_scan", ("log_records",), """
select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, level, logger, msg, job_id, cast(seq as varchar) as seq from log_records""")
def _log_scan(spark, sf_dir):
    folder = write_log_lines(spark, table(spark, sf_dir, "log_records"))
    parsed = logs.parse_log_lines(read_log_lines(spark, folder))
    return parsed.select(
        "timestamp", "level", "logger", "msg",
        F.col("extras")["job_id"].alias("job_id"), F.col("extras")["seq"].alias("seq"))


# --- queues -----------------------------------------------------------------

@JOBS.add("claim_batch", ("queue_rows",), """
select * from queue_rows where delay_left_sec <= 0 and invisible_left_sec <= 0
qualify row_number() over (partition by queue order by sent_ts, message_id) <= 10""")
def _claim_batch(spark, sf_dir):
    return queues.claim_batch(table(spark, sf_dir, "queue_rows"), 10)


@JOBS.add("queue_stats", ("queue_rows",), """
select queue, count(*) filter (delay_left_sec <= 0 and invisible_left_sec <= 0) as visible,
  count(*) filter (delay_left_sec <= 0 and invisible_left_sec > 0) as inflight,
  count(*) filter (delay_left_sec > 0) as delayed from queue_rows group by queue""")
def _queue_stats(spark, sf_dir):
    return queues.queue_stats(table(spark, sf_dir, "queue_rows"))


@JOBS.add("poison_messages", ("raw_messages",), """
select message_id, receive_count from raw_messages where receive_count >= 5""")
def _poison(spark, sf_dir):
    return queues.poison_messages(table(spark, sf_dir, "raw_messages")).select(
        "message_id", "receive_count")


@JOBS.add("dlq_records", RAW, CHECKED + """
, dead as (select message_id, body, p, reason from checked where receive_count >= 5 or reason is not null)
select message_id, coalesce(reason, 'poison-pill') as reason,
  coalesce(try_cast(p->>'$.retry_count' as bigint), 0) as retry_count,
  coalesce(json_type(p) = 'OBJECT', false) as is_object,
  case when not coalesce(json_type(p) = 'OBJECT', false) then body end as raw_body from dead""")
def _dlq_records(spark, sf_dir):
    """Rejected messages with their reason, poison ones without."""
    checked = check_messages(table(spark, sf_dir, "raw_messages"), Dag.default(), [BUCKET])
    dead = checked.filter(
        F.col("reason").isNotNull() | queues.is_poison(F.col("receive_count")))
    letters = queues.dlq_records(dead.select("message_id", "reason", "body"))
    members = "struct<reason:string,retry_count:bigint,original:variant>"
    letter = F.from_json("body", members)
    original = F.col("l.original")
    is_object = F.schema_of_variant(original) != "STRING"
    return letters.select("message_id", letter.alias("l")).select(
        "message_id", "l.reason", "l.retry_count", is_object.alias("is_object"),
        F.when(~is_object, F.variant_get(original, "$", "string")).alias("raw_body"))


@JOBS.add("requeue", ("send_rows",), """
select seq, job_id, step, task_id, cast(retry_count + 1 as int) as retry_count,
  greatest(0, least(delay_seconds, 900)) as delay_seconds, ts + to_seconds(greatest(0, least(delay_seconds, 900))) as visible_at
from send_rows""")
def _requeue(spark, sf_dir):
    rows = table(spark, sf_dir, "send_rows").select(
        "seq", "ts", *TASK_KEY, "retry_count", "delay_seconds")
    return queues.requeue(rows, F.col("ts")).drop("ts")


@JOBS.add("dedup_messages", ("send_rows",), """
select job_id, coalesce(dedup_id, task_id) as dedup_id, min(seq) as seq, min_by(step, seq) as step, min_by(params, seq) as params
from send_rows group by job_id, coalesce(dedup_id, task_id)""")
def _dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "send_rows").select(
        "job_id", "task_id", "dedup_id", "seq", "step", "params")
    return queues.dedup_messages(rows, ["job_id"]).drop("task_id")


# --- routing and finished work ----------------------------------------------

@JOBS.add("route_by_step", RAW, ACCEPTED + """
select a.message_id, a.step, d.queue, a.step = 'AVATAR' as mine from accepted a join step_def d using (step)""")
def _route(spark, sf_dir):
    routed = routing.route_by_step(accepted_messages(spark, sf_dir), Dag.default())
    mine, released = routing.split_for_worker(routed, "AVATAR")
    columns = ["message_id", "step", "queue"]
    return mine.select(*columns, F.lit(True).alias("mine")).unionByName(
        released.select(*columns, F.lit(False).alias("mine")))


DONE = """
, done as (
  select distinct case when regexp_full_match(task_id, 'S[0-9]+') then 'slot' else 'step' end as kind, p.*
  from task_probe p where
    case when regexp_full_match(task_id, 'S[0-9]+') then
      concat(step_prefix, task_id, '/result.json') in (select path from object_listing)
      or concat(step_prefix, task_id, '/result.png') in (select path from object_listing)
      or concat(step_prefix, task_id, '/result.mp4') in (select path from object_listing)
    else concat(step_prefix, 'metrics.json') in (select path from object_listing)
      or concat(step_prefix, 'result.json') in (select path from object_listing)
      or concat(step_prefix, 'result.png') in (select path from object_listing)
      or concat(step_prefix, 'result.mp4') in (select path from object_listing)
      or concat(step_prefix, 'S0/result.json') in (select path from object_listing)
      or concat(step_prefix, 'S0/result.png') in (select path from object_listing)
      or concat(step_prefix, 'S0/result.mp4') in (select path from object_listing) end)
"""


def _split_done(spark, sf_dir, **options):
    return routing.split_done(
        table(spark, sf_dir, "task_probe"), table(spark, sf_dir, "object_listing"), **options)


@JOBS.add("pending_tasks", ("task_probe", "object_listing"), DONE + """
select p.* from task_probe p anti join done d using (job_id, step, task_id)""")
def _pending(spark, sf_dir):
    return _split_done(spark, sf_dir).pending


@JOBS.add("skipped_tasks", ("task_probe", "object_listing"), DONE + """
select job_id, user_id, step, task_id, step_prefix from done""")
def _skipped(spark, sf_dir):
    return _split_done(spark, sf_dir).skipped


@JOBS.add("skipped_tasks_all_types", ("task_probe", "object_listing"), DONE + """
select job_id, user_id, step, task_id, step_prefix from done
union select p.* from task_probe p where (regexp_full_match(task_id, 'S[0-9]+') and concat(step_prefix, task_id, '/result.mp3') in (select path from object_listing))
  or (task_id = 'root' and concat(step_prefix, 'S0/result.mp3') in (select path from object_listing))""")
def _skipped_all(spark, sf_dir):
    return _split_done(spark, sf_dir, all_types=True).skipped


# --- logs -------------------------------------------------------------------

@JOBS.add("log_filter", ("log_records",), "select * from log_records where level in ('WARNING', 'ERROR')")
def _log_filter(spark, sf_dir):
    return logs.log_filter(table(spark, sf_dir, "log_records"), "WARNING")


@JOBS.add("log_with_context", ("log_records", "job_updates"), """
, ctx as (select job_id, min_by(user_id, seq) as user_id from job_updates where status <> 'FAILED' group by job_id)
select l.seq, c.user_id, cast(l.latency_ms as varchar) as latency, cast(null as varchar) as msg_extra
from log_records l left join ctx c using (job_id)""")
def _log_with_context(spark, sf_dir):
    jobs = table(spark, sf_dir, "job_updates").filter("status <> 'FAILED'").groupBy(
        "job_id").agg(F.min_by("user_id", "seq").alias("user_id"))
    context = jobs.select("job_id", F.create_map(
        F.lit("user_id"), "user_id", F.lit("latency"), F.lit("unset"),
        F.lit("msg"), F.lit("hidden")).alias("context"))
    records = table(spark, sf_dir, "log_records").withColumn(
        "extras", F.create_map(F.lit("latency"), F.col("latency_ms").cast("string")))
    bound = logs.with_context(records, context, ["job_id"])
    return bound.select("seq", *[
        F.try_element_at("extras", F.lit(k)).alias(n)
        for k, n in (("user_id", "user_id"), ("latency", "latency"), ("msg", "msg_extra"))])


@JOBS.add("log_latency", ("log_records",), """
select logger, count(*) as records, count(*) filter (level = 'ERROR') as errors, count(*) filter (level = 'WARNING') as warnings,
  round(quantile_cont(latency_ms, 0.95), 6) as p95_ms from log_records group by logger""")
def _log_latency(spark, sf_dir):
    return logs.log_latency(table(spark, sf_dir, "log_records"), ["logger"]).withColumn(
        "p95_ms", F.round("p95_ms", 6))


# --- audits -----------------------------------------------------------------

@JOBS.add("contract_audit", ("task_events", "object_listing", *CHILD_TABLES), CHILDREN + TASKS + """
, done as (select *, concat('s3://work/u0/', job_id, '/', step, '/') as step_prefix from tasks where status = 'SUCCEEDED'),
 roll as (select job_id, count(*) filter (status in ('FAILED', 'DLQ')) > 0 or count(*) filter (status = 'SUCCEEDED') = count(*) as finished from tasks group by job_id)
select 'result_present' as check_name, count(*) as checked, count(*) filter (
    concat(step_prefix, task_id, '/result.png') not in (select path from object_listing)) as failed from done
union all select 'metrics_present', count(*), count(*) filter (concat(step_prefix, 'metrics.json') not in (select path from object_listing))
  from (select distinct step_prefix from done)
union all select 'no_repeated_work', count(*), count(*) filter (n > 1) from (select count(*) as n from task_events where status = 'SUCCEEDED' group by job_id, step, task_id)
union all select 'child_ids_unique', count(*), count(*) filter (n > 1) from (select count(distinct (input_uri, params)) as n from messages group by job_id, step, task_id)
union all select 'job_finished', count(*), count(*) filter (not finished) from roll""")
def _contract_audit(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir).withColumn(
        "step_prefix",
        F.concat(F.lit("s3://work/u0/"), F.concat_ws("/", "job_id", "step"), F.lit("/")))
    return audit.contract_audit(
        tasks, table(spark, sf_dir, "task_events"), table(spark, sf_dir, "object_listing"),
        child_messages(spark, sf_dir))


@JOBS.add("drain_audit", ("queue_rows", "raw_messages", "task_events"), TASKS + """
, q as (select cast(count(*) filter (delay_left_sec <= 0 and invisible_left_sec <= 0) as bigint) as visible,
  count(*) filter (delay_left_sec <= 0 and invisible_left_sec > 0) as inflight, count(*) filter (delay_left_sec > 0) as delayed from queue_rows),
 m as (select count(*) filter (receive_count >= 5) as dead from raw_messages),
 t as (select count(*) filter (status not in ('SUCCEEDED', 'FAILED', 'CANCELLED', 'DLQ')) as open_tasks, count(*) filter (status = 'SUCCEEDED') as succeeded_tasks from tasks)
select *, visible + inflight + delayed = 0 and dead = 0 and open_tasks = 0 as drained from q, m, t""")
def _drain_audit(spark, sf_dir):
    return audit.drain_audit(
        table(spark, sf_dir, "queue_rows"), table(spark, sf_dir, "raw_messages"),
        table(spark, sf_dir, "task_events"))
