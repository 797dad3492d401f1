"""Jobs over task outputs: layout, completions, fan-out, outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskframe.operators import fanout, layout, queues, results
from taskframe.plans.registry import Jobs
from taskframe.plans.state import RESULTS, TASKS, results_of, tasks_of
from taskframe.schemas import TASK_KEY
from taskframe.session import scratch_dir
from taskframe.sources import commits
from taskframe.sources.dag import Dag
from taskframe.sources.tables import table

JOBS = Jobs()
BUCKET = "work"

# --- SQL shared by the oracles ---------------------------------------------

LAID = """
, placed as (
  select i.*, d.filetype,
    case when shape in ('aux', 'metrics') then step_prefix
      when list_size > 1 then concat(step_prefix, 'S', list_pos, '/')
      else concat(step_prefix, task_id, '/') end as folder,
    case when shape = 'metrics' then 'metrics.json' when shape = 'aux' then file_name
      when shape = 'files' then case when contains(file_name, ';') then null else replace(file_name, '/', '') end
      when list_size > 1 then case when kind = 'json' then 'result.json' else 'result.png' end
      else concat('result.', d.filetype) end as name
  from layout_items i join step_def d using (step)),
judged as (
  select *, case when name is null or (shape = 'aux' and contains(name, '/')) then 'file_name'
    when kind = 'number' then 'passed_over' when not regexp_matches(lower(name), '[.](json|png|mp4|mp3|txt)$') then 'extension' end as problem
  from placed),
laid as (
  select *, case when problem is null then concat(folder, name) end as uri,
    case when problem is not null then null when kind = 'json' or ends_with(name, '.json') then 'application/json; charset=utf-8'
      when ends_with(name, '.txt') then 'text/plain; charset=utf-8' when ends_with(lower(name), '.png') then 'image/png' end as mime
  from judged),
ranked as (
  select *, case when list_size > 1 then list_pos end as item,
    row_number() over (partition by job_id, case when list_size > 1 then list_pos end
      order by case when file_name is null or starts_with(lower(file_name), 'result') then 0 else 1 end, file_pos) as choice
  from laid where shape not in ('aux', 'metrics')),
uris as (
  select job_id, step, task_id, item,
    coalesce(max(uri) filter (choice = 1), arg_min(uri, file_pos) filter (problem is null)) as result_uri,
    coalesce(max(mime) filter (choice = 1), arg_min(mime, file_pos) filter (problem is null)) as result_mime,
    max(size_bytes) filter (choice = 1 and problem is null) as result_size
  from ranked group by all having count(*) filter (problem is null) > 0)
"""
LAID_TABLES = ("layout_items", "step_def")


def laid_out(spark, sf_dir):
    return layout.lay_out(table(spark, sf_dir, "layout_items"), Dag.default())


@JOBS.add("result_layout", LAID_TABLES, LAID + """
select job_id, step, task_id, child_pos, folder, name, uri, mime, size_bytes from laid where problem is null""")
def _result_layout(spark, sf_dir):
    out = layout.result_layout(table(spark, sf_dir, "layout_items"), Dag.default())
    return out.written.select(
        *TASK_KEY, "child_pos", "folder", "name", "uri", "mime", "size_bytes")


@JOBS.add("refused_artifacts", LAID_TABLES, LAID + """
select step, shape, problem, count(*) as artifacts from laid where problem is not null group by all""")
def _refused_artifacts(spark, sf_dir):
    out = layout.result_layout(table(spark, sf_dir, "layout_items"), Dag.default())
    return out.refused.groupBy("step", "shape", "problem").agg(
        F.count(F.lit(1)).alias("artifacts"))


@JOBS.add("primary_result", LAID_TABLES, LAID + """
select job_id, step, task_id, result_uri as primary_result_uri, result_mime as primary_mime, result_size as primary_size_bytes
from uris where item is null""")
def _primary_result(spark, sf_dir):
    return layout.primary_result(laid_out(spark, sf_dir))


@JOBS.add("primary_file_names", ("result_items",), """
, r as (select job_id, file_name, item_pos, row_number() over (partition by job_id
    order by case when starts_with(lower(file_name), 'result') then 0 else 1 end, item_pos) as choice from result_items)
select file_name, count(*) as tasks from r where choice = 1 group by file_name""")
def _primary_file_names(spark, sf_dir):
    items = table(spark, sf_dir, "result_items").select(
        *TASK_KEY, F.lit("s3://work/u/j/s/").alias("step_prefix"), F.lit("files").alias("shape"),
        F.lit(None).cast("int").alias("list_pos"), F.lit(None).cast("int").alias("list_size"),
        F.col("item_pos").alias("file_pos"), "file_name", F.lit("bytes").alias("kind"),
        "size_bytes")
    primary = layout.primary_result(layout.lay_out(items, Dag.default()))
    name = F.substring_index("primary_result_uri", "/", -1)
    return primary.groupBy(name.alias("file_name")).agg(F.count(F.lit(1)).alias("tasks"))


@JOBS.add("child_uris", LAID_TABLES, LAID + """
select job_id, step, task_id, cast(row_number() over (partition by job_id order by coalesce(item, 0)) - 1 as int) as uri_pos, result_uri as uri
from uris""")
def _child_uris(spark, sf_dir):
    return layout.child_uris(laid_out(spark, sf_dir))


@JOBS.add("extra_uris", LAID_TABLES, LAID + """
select job_id, step, task_id, concat('item_', item) as entry, result_uri as uri from uris where item is not null
union all select job_id, step, task_id, name, uri from laid where shape = 'aux' and problem is null""")
def _extra_uris(spark, sf_dir):
    return layout.extra_uris(laid_out(spark, sf_dir))


@JOBS.add("step_metrics", ("task_events",), """
select concat('s3://work/', job_id, '/', step, '/') as step_prefix, concat('s3://work/', job_id, '/', step, '/metrics.json') as metrics_uri,
  max_by(params, seq) as metrics, max_by(task_id, seq) as task_id
from task_events where status = 'SUCCEEDED' group by job_id, step""")
def _step_metrics(spark, sf_dir):
    done = table(spark, sf_dir, "task_events").filter("status = 'SUCCEEDED'")
    return layout.step_metrics(done.select(
        F.concat(F.lit("s3://work/"), F.concat_ws("/", "job_id", "step"), F.lit("/"))
        .alias("step_prefix"), F.col("params").alias("metrics"), "task_id", "seq"))


@JOBS.add("write_info", LAID_TABLES, LAID + """
, w as (select job_id, step, task_id, max(result_uri) filter (item is null) as primary_result_uri,
    max(result_mime) filter (item is null) as primary_mime, max(result_size) filter (item is null) as primary_size_bytes,
    arg_min(result_uri, coalesce(item, 0)) as first_child_uri from uris group by all),
 m as (select job_id, step, task_id, max(uri) as metrics_uri from laid where shape = 'metrics' group by all)
select * from w full join m using (job_id, step, task_id)""")
def _write_info(spark, sf_dir):
    return layout.write_info(laid_out(spark, sf_dir))


@JOBS.add("completions", ("task_events", "completion_rows"), TASKS + RESULTS + """
select t.job_id, t.step, t.task_id, concat('{"schema":"v1","job_id":"', t.job_id, '","task_id":"', t.task_id, '","user_id":"', t.user_id,
  '","step":"', t.step, '","input_uri":"","output_prefix":"s3://work/', t.job_id, '/","params":', replace(t.params, ': ', ':'), ',"retry_count":', t.retry_count,
  ',"primary_result_uri":', case when nullif(r.primary_result_uri, '') is null then 'null' else concat('"', r.primary_result_uri, '"') end,
  case when r.primary_mime is null then '' else concat(',"primary_mime":"', r.primary_mime, '"') end,
  case when r.primary_size_bytes is null then '' else concat(',"primary_size_bytes":', r.primary_size_bytes) end, '}') as body
from tasks t join results r using (job_id, step, task_id) where t.status = 'SUCCEEDED'""")
def _completions(spark, sf_dir):
    done = tasks_of(spark, sf_dir).filter("status = 'SUCCEEDED'").select(
        *TASK_KEY, "user_id", "params", "retry_count")
    results = results_of(spark, sf_dir).drop(
        "created_at", "updated_at", "first_seq", "last_seq", "extra")
    nothing = F.lit(None).cast("string")
    return layout.completions(done.join(results, list(TASK_KEY)).withColumns({
        "schema": F.lit("v1"), "input_uri": nothing,
        "output_prefix": F.concat(F.lit("s3://work/"), "job_id", F.lit("/")),
        "first_child_uri": nothing, "trace_id": nothing, "parent_task_id": nothing}))


# --- fan-out ----------------------------------------------------------------

CHILDREN = """
, n as (select job_id, count(*) as siblings from hook_children group by job_id),
u as (select job_id, max(uri_pos) as last_pos from child_uris group by job_id),
c as (select h.*, e.next_step, s.queue, p.filetype,
    concat('S', coalesce(h.explicit_idx, case when n.siblings = 1 then cast(substr(h.task_id, 2) as int) end, h.child_pos)) as child_id,
    least(h.child_pos, u.last_pos) as at_pos
  from hook_children h join n using (job_id) join step_edge e using (step)
  join step_def s on s.step = e.next_step join step_def p on p.step = h.step left join u using (job_id)),
messages as (select c.job_id, child_id as task_id, c.user_id, c.schema, c.next_step as step,
    coalesce(x.uri, concat(case when ends_with(c.job_id, '0') then 's3://other/' else 's3://work/' end, c.user_id, '/', c.job_id, '/', c.step, '/', child_id, '/result.', filetype)) as input_uri,
    concat('s3://work/', c.user_id, '/', c.job_id, '/', c.next_step, '/', child_id, '/') as output_prefix,
    c.child_params as params, c.task_id as parent_task_id, cast(null as varchar) as trace_id, 0 as retry_count,
    c.step as parent_step, c.child_pos, c.queue
  from c left join child_uris x on x.job_id = c.job_id and x.uri_pos = at_pos)
"""
CHILD_TABLES = ("hook_children", "step_edge", "step_def", "child_uris")


def child_messages(spark, sf_dir):
    children = fanout.with_siblings(table(spark, sf_dir, "hook_children"))
    with_uris = fanout.with_input_uris(children, table(spark, sf_dir, "child_uris"))
    # Some parents wrote to another bucket than the one children go to.
    bucket = F.when(F.col("job_id").endswith("0"), "s3://other").otherwise(f"s3://{BUCKET}")
    with_uris = with_uris.withColumn("output_prefix", F.concat(
        F.concat_ws("/", bucket, "user_id", "job_id", "step", "task_id"), F.lit("/")))
    return fanout.fanout_children(with_uris, Dag.default(), BUCKET)


@JOBS.add("fanout_children", CHILD_TABLES, CHILDREN + "select * from messages")
def _fanout_children(spark, sf_dir):
    return child_messages(spark, sf_dir)


@JOBS.add("fanout_edges", CHILD_TABLES, CHILDREN + """
select parent_step, step, count(*) as children from messages group by all""")
def _fanout_edges(spark, sf_dir):
    return child_messages(spark, sf_dir).groupBy("parent_step", "step").agg(
        F.count(F.lit(1)).alias("children"))


BODY = """concat('{"job_id":"', job_id, '","task_id":"', task_id, '","user_id":"', user_id, '","schema":"', schema,
  '","step":"', step, '","input_uri":"', input_uri, '","output_prefix":"', output_prefix, '","params":', replace(params, ': ', ':'),
  ',"parent_task_id":"', parent_task_id, '","retry_count":0}')"""


OUTBOX = CHILDREN + f"""
select queue, {BODY} as body, 0 as delay_seconds, job_id as group_id, cast(null as varchar) as dedup_id from messages"""


def outgoing(spark, sf_dir):
    bodies = child_messages(spark, sf_dir).select(
        "queue", "task_id", F.col("job_id").alias("group_id"),
        fanout.message_body().alias("body"))
    return queues.outbox(bodies).sent.select(
        "queue", "body", "delay_seconds", "group_id", "dedup_id")


@JOBS.add("outbox", CHILD_TABLES, OUTBOX)
def _outbox(spark, sf_dir):
    return outgoing(spark, sf_dir)


@JOBS.add("written_outbox", CHILD_TABLES, OUTBOX)
def _written_outbox(spark, sf_dir):
    """Messages as they are read back by queue; a second attempt of the run adds none."""
    base = scratch_dir(spark, "outbox")
    sent = outgoing(spark, sf_dir)
    for _ in range(2):
        results.write_messages(sent, base, "run-1")
    return results.read_messages(spark, base).select(*sent.columns)


# Whole texts as artifacts: some refused by name, some written again with another text.
ARTIFACTS = """
with a as (select lpad(lower(hex(doc_id)), 8, '0') as job_id, concat('u', cast(doc_id % 7 as string)) as user_id,
    case cast(doc_id % 3 as int) when 0 then 'ENHANCEMENT' when 1 then 'ANALYSIS' else 'SCRIPT_GENERATION' end as step,
    concat('S', cast(doc_id % 4 as string)) as task_id, doc_id, text from documents)
select concat('s3://work/', user_id, '/', job_id, '/', step, '/', task_id, '/result.txt') as uri, step, 'text/plain; charset=utf-8' as mime,
  cast(strlen(t) as bigint) as size_bytes, sha256(t) as sha256
from (select *, case when doc_id % 10 = 4 then concat(text, ' again') else text end as t from a where doc_id % 13 <> 5)"""


def artifacts(documents):
    doc = F.col("doc_id")
    job, step = F.lpad(F.lower(F.hex(doc)), 8, "0"), (
        F.when(doc % 3 == 0, "ENHANCEMENT").when(doc % 3 == 1, "ANALYSIS").otherwise("SCRIPT_GENERATION"))
    user = F.concat(F.lit("u"), (doc % 7).cast("string"))
    return documents.select(
        "doc_id", job.alias("job_id"), step.alias("step"), F.concat(F.lit("S"), (doc % 4).cast("string")).alias("task_id"),
        F.concat(F.lit("s3://work/"), user, F.lit("/"), job, F.lit("/"), step, F.lit("/")).alias("step_prefix"),
        F.lit("files").alias("shape"), F.lit(None).cast("int").alias("list_pos"), F.lit(None).cast("int").alias("list_size"),
        F.lit(0).alias("file_pos"), F.when(doc % 13 == 5, "bad;name.txt").otherwise("result.txt").alias("file_name"),
        F.lit("bytes").alias("kind"), F.col("text").cast("binary").alias("content"))


@JOBS.add("written_results", ("documents",), ARTIFACTS)
def _written_results(spark, sf_dir):
    """Texts written in two runs and read back; a third run never came to its commit."""
    base, dag = scratch_dir(spark, "results"), Dag.default()
    items = artifacts(table(spark, sf_dir, "documents"))
    results.write_results(items.drop("doc_id"), dag, base, "run-1")
    again = items.where("doc_id % 10 = 4").withColumn("content", F.concat("content", F.lit(" again").cast("binary")))
    results.write_results(again.drop("doc_id"), dag, base, "run-2")
    lost = commits.new_folder(base, "results")
    spark.read.parquet(commits.live(spark, base, "results")[0].folder).write.partitionBy("step").parquet(lost)
    stored = results.read_results(spark, base)
    return stored.select("uri", "step", "mime", F.octet_length("content").cast("bigint").alias("size_bytes"),
                         F.sha2("content", 256).alias("sha256"))


@JOBS.add("outbox_guard", ("send_rows",), """
, b as (select *, concat('{"seq":', seq, ',"params":', replace(params, ': ', ':'), '}') as body from send_rows)
select seq, queue, greatest(0, least(delay_seconds, 900)) as delay_seconds, group_id,
  coalesce(dedup_id, case when ends_with(queue, '.fifo') then task_id end) as dedup_id,
  case when ends_with(queue, '.fifo') and group_id is null then 'fifo_without_group' when octet_length(encode(body)) > 30 then 'body_too_large' end as problem
from b""")
def _outbox_guard(spark, sf_dir):
    """FIFO rules, delay clamp and body limit (a low one, so that it bites)."""
    body = F.to_json(F.struct("seq", F.parse_json("params").alias("params")))
    out = queues.outbox(
        table(spark, sf_dir, "send_rows").withColumn("body", body), max_bytes=30)
    columns = ["seq", "queue", "delay_seconds", "group_id", "dedup_id"]
    return out.sent.select(*columns).unionByName(
        out.refused.select(*columns, "problem"), allowMissingColumns=True)


@JOBS.add("outbox_batches", CHILD_TABLES, CHILDREN + """
select job_id, parent_step, parent_task_id, step, queue, cast(floor(child_pos / 10) as int) as batch_no,
  count(*) as entries, min(concat('m', child_pos % 10)) as first_entry
from messages group by job_id, parent_step, parent_task_id, step, queue, cast(floor(child_pos / 10) as int)""")
def _outbox_batches(spark, sf_dir):
    sends = fanout.batches(child_messages(spark, sf_dir))
    return sends.groupBy(
        "job_id", "parent_step", "parent_task_id", "step", "queue", "batch_no").agg(
            F.count(F.lit(1)).alias("entries"), F.min("entry_id").alias("first_entry"))
