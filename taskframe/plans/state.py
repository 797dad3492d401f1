"""Jobs over job, task and result state."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskframe import schemas
from taskframe.operators import graphs, lineage, reads, state
from taskframe.plans.registry import Jobs
from taskframe.schemas import JOB_STATUSES, TASK_KEY, TASK_STATUSES
from taskframe.sources.dag import Dag
from taskframe.sources.tables import table

JOBS = Jobs()

# --- SQL shared by the oracles ---------------------------------------------

TASKS = """
, tasks as (
  select job_id, step, task_id, min_by(user_id, seq) as user_id,
    max_by(status, seq) as status, max_by(retry_count, seq) as retry_count, max_by(params, seq) as params,
    arg_max_null(error_code, seq) as error_code, min_by(ts, seq) as created_at, max_by(ts, seq) as updated_at,
    min(seq) as first_seq, max(seq) as last_seq
  from task_events group by all)
"""
JOB_TABLE = """
, jobs as (
  select job_id, min_by(user_id, seq) as user_id, min_by(schema, seq) as schema, min_by(status, seq) as status,
    arg_min_null(trace_id, seq) as trace_id, min_by(attrs, seq) as attrs,
    min_by(ts, seq) as created_at, max_by(ts, seq) as updated_at, min(seq) as first_seq, max(seq) as last_seq
  from job_updates group by job_id)
"""
RESULTS = """
, results as (
  select job_id, step, task_id, max_by(primary_result_uri, seq) as primary_result_uri,
    arg_max_null(metrics_uri, seq) as metrics_uri, arg_max_null(primary_mime, seq) as primary_mime,
    arg_max_null(primary_size_bytes, seq) as primary_size_bytes, max_by(extra, seq) as extra,
    min_by(ts, seq) as created_at, max_by(ts, seq) as updated_at, min(seq) as first_seq, max(seq) as last_seq
  from completion_rows
  where status = 'SUCCEEDED' and (primary_result_uri <> '' or metrics_uri <> ''
    or primary_mime is not null or primary_size_bytes is not null)
  group by job_id, step, task_id)
"""


def tasks_of(spark, sf_dir):
    return state.upsert_tasks(table(spark, sf_dir, "task_events"))


def jobs_of(spark, sf_dir):
    return state.upsert_jobs(table(spark, sf_dir, "job_updates"))


def results_of(spark, sf_dir):
    return state.apply_completions(table(spark, sf_dir, "completion_rows")).results


# --- upserts ----------------------------------------------------------------

@JOBS.add("upsert_jobs", ("job_updates",), JOB_TABLE + "select * from jobs")
def _upsert_jobs(spark, sf_dir):
    return jobs_of(spark, sf_dir)


@JOBS.add("upsert_tasks", ("task_events",), TASKS + "select * from tasks")
def _upsert_tasks(spark, sf_dir):
    return tasks_of(spark, sf_dir)


@JOBS.add("upsert_tasks_incremental", ("task_events",), TASKS + "select * from tasks")
def _upsert_tasks_incremental(spark, sf_dir):
    """Old state folded with new events gives what all events give at once."""
    events = table(spark, sf_dir, "task_events")
    odd = (F.col("seq") % 2) == 1
    return state.upsert_tasks(
        events.filter(~odd), state=state.upsert_tasks(events.filter(odd)))


@JOBS.add("upsert_results", ("completion_rows",), """
, saves as (select * from completion_rows where status = 'SUCCEEDED')
select job_id, step, task_id, max_by(primary_result_uri, seq) as primary_result_uri,
  arg_max_null(metrics_uri, seq) as metrics_uri, arg_max_null(primary_mime, seq) as primary_mime,
  arg_max_null(primary_size_bytes, seq) as primary_size_bytes, max_by(extra, seq) as extra,
  min_by(ts, seq) as created_at, max_by(ts, seq) as updated_at, min(seq) as first_seq, max(seq) as last_seq
from saves group by job_id, step, task_id""")
def _upsert_results(spark, sf_dir):
    saves = table(spark, sf_dir, "completion_rows").filter("status = 'SUCCEEDED'")
    return state.upsert_results(saves)


@JOBS.add("apply_completions", ("completion_rows",), RESULTS + "select * from results")
def _apply_completions(spark, sf_dir):
    return results_of(spark, sf_dir)


TASK_STATE = """
, base as (select job_id, step, task_id, min_by(user_id, seq) as user_id, min_by(status, seq) as status,
    min_by(retry_count, seq) as retry_count, min_by(ts, seq) as updated_at from task_events group by all),
 moves as (select job_id, step, task_id, max_by(status, seq) as m_status, max_by(ts, seq) as m_ts,
    max(case when status = 'STARTED' then seq end) as s_seq, max(case when status in ('SUCCEEDED', 'FAILED') then seq end) as f_seq,
    max(case when status = 'FAILED' then seq end) as e_seq, count(*) filter (status = 'RETRIED') as retries
  from task_events where status <> 'QUEUED' group by all)
select b.job_id, b.step, b.task_id, b.user_id, coalesce(m_status, b.status) as status,
  cast(b.retry_count + coalesce(retries, 0) as int) as retry_count, coalesce(m_ts, b.updated_at) as updated_at,
  s.ts as started_at, f.ts as finished_at, e.error_code
from base b left join moves m using (job_id, step, task_id)
left join task_events s on s.seq = s_seq left join task_events f on f.seq = f_seq left join task_events e on e.seq = e_seq"""


def first_states(events):
    """Tasks as their first events say."""
    first = F.struct("user_id", "status", "retry_count", F.col("ts").alias("updated_at"))
    return events.groupBy(*TASK_KEY).agg(F.min_by(first, "seq").alias("f")).select(*TASK_KEY, "f.*")


@JOBS.add("task_state", ("task_events",), TASK_STATE)
def _task_state(spark, sf_dir):
    events = table(spark, sf_dir, "task_events")
    moved = state.task_state(first_states(events), events.filter("status <> 'QUEUED'"))
    return moved.select(
        *TASK_KEY, "user_id", "status", "retry_count", "updated_at", "started_at",
        "finished_at", "error_code")


@JOBS.add("job_state", ("job_updates",), JOB_TABLE + """
, u as (select job_id, max_by(status, seq) as status, max_by(ts, seq) as ts from job_updates group by job_id)
select j.job_id, j.user_id, j.schema, u.status, j.trace_id, j.attrs, j.created_at, u.ts as updated_at, j.first_seq, j.last_seq
from jobs j join u using (job_id)""")
def _job_state(spark, sf_dir):
    return state.job_state(jobs_of(spark, sf_dir), table(spark, sf_dir, "job_updates"))


@JOBS.add("job_rollup", ("task_events",), TASKS + """
, n as (select job_id, count(*) as tasks, count(*) filter (status = 'SUCCEEDED') as succeeded,
    count(*) filter (status in ('FAILED', 'DLQ')) as failed, count(*) filter (status = 'QUEUED') as queued,
    count(*) filter (status = 'CANCELLED') as cancelled,
    count(*) filter (status not in ('SUCCEEDED', 'FAILED', 'CANCELLED', 'DLQ')) as open from tasks group by job_id)
select *, case when failed > 0 then 'FAILED' when succeeded = tasks then 'SUCCEEDED' when queued = tasks then 'QUEUED'
  when cancelled > 0 and open = 0 then 'CANCELLED' else 'RUNNING' end as status from n""")
def _job_rollup(spark, sf_dir):
    return state.job_rollup(tasks_of(spark, sf_dir))


BARRIER = TASKS + """
, ready as (select job_id, 'STITCH' as step, 'S0' as task_id, count(*) as siblings, max(last_seq) as ready_seq
  from tasks where step = 'VIDEO_GENERATION' group by job_id having count(*) filter (status <> 'SUCCEEDED') = 0)
"""


@JOBS.add("join_barrier", ("task_events",), BARRIER + "select * from ready")
def _join_barrier(spark, sf_dir):
    return state.join_barrier(tasks_of(spark, sf_dir), Dag.default())


@JOBS.add("join_barrier_again", ("task_events",), BARRIER + """
select * from ready where job_id not in (select job_id from task_events where seq % 120 = 7)""")
def _join_barrier_again(spark, sf_dir):
    """Jobs released before are left out."""
    released = table(spark, sf_dir, "task_events").filter("seq % 120 = 7").select(
        "job_id", F.lit("STITCH").alias("step"))
    return state.join_barrier(tasks_of(spark, sf_dir), Dag.default(), released)


# --- reads ------------------------------------------------------------------

@JOBS.add("jobs_by_id", ("job_updates", "log_records"), JOB_TABLE + """
select * from jobs where job_id in (select job_id from log_records where level = 'ERROR' and latency_ms > 100)""")
def _jobs_by_id(spark, sf_dir):
    slow = table(spark, sf_dir, "log_records").filter("level = 'ERROR' and latency_ms > 100")
    return reads.by_key(jobs_of(spark, sf_dir), slow, ["job_id"])


@JOBS.add("tasks_by_key", ("task_events", "task_probe"), TASKS + """
select t.* from tasks t semi join task_probe p using (job_id, step, task_id)""")
def _tasks_by_key(spark, sf_dir):
    return reads.by_key(
        tasks_of(spark, sf_dir), table(spark, sf_dir, "task_probe"), list(TASK_KEY))


@JOBS.add("list_jobs", ("job_updates",), JOB_TABLE + """
select * from jobs qualify row_number() over (partition by user_id order by created_at desc, job_id) <= 100""")
def _list_jobs(spark, sf_dir):
    return reads.list_jobs(jobs_of(spark, sf_dir))


@JOBS.add("list_tasks", ("task_events",), TASKS + """
select * from tasks qualify row_number() over (partition by job_id order by created_at desc, step, task_id) <= 200""")
def _list_tasks(spark, sf_dir):
    return reads.list_tasks(tasks_of(spark, sf_dir))


@JOBS.add("list_open_tasks", ("task_events",), TASKS + """
select * from tasks where status = 'STARTED'
qualify row_number() over (partition by job_id order by created_at desc, step, task_id) <= 2""")
def _list_open_tasks(spark, sf_dir):
    return reads.list_tasks(tasks_of(spark, sf_dir), status="STARTED", limit=2)


@JOBS.add("children_of", ("task_events",), TASKS + """
, linked as (select *, case when task_id <> 'S0' then 'S0' end as parent_task_id,
    case when step = 'VIDEO_GENERATION' then 'SEGMENTATION' else step end as parent_step from tasks)
select c.* from linked c where exists (select 1 from tasks p
  where p.job_id = c.job_id and p.task_id = c.parent_task_id and p.step = c.parent_step and p.status = 'SUCCEEDED')""")
def _children_of(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir)
    linked = tasks.withColumns({
        "parent_task_id": F.when(F.col("task_id") != "S0", F.lit("S0")),
        "parent_step": F.when(F.col("step") == "VIDEO_GENERATION", "SEGMENTATION").otherwise(
            F.col("step"))})
    return reads.children_of(linked, tasks.filter("status = 'SUCCEEDED'"))


@JOBS.add("task_lineage", ("task_links",), """
, up(job_id, step, task_id, at_step, at_task, depth) as (
    select job_id, step, task_id, step, task_id, cast(0 as bigint) from task_links
    union all
    select u.job_id, u.step, u.task_id, p.step, p.task_id, u.depth + 1
    from up u join task_links l on l.job_id = u.job_id and l.step = u.at_step and l.task_id = u.at_task
      join task_links p on p.job_id = u.job_id and p.step = l.parent_step and p.task_id = l.parent_task_id)
, roots as (select job_id, step, task_id, arg_max(at_step, depth) as root_step, arg_max(at_task, depth) as root_task_id,
    max(depth) as depth from up group by all)
, sizes as (select job_id, at_step as step, at_task as task_id, count(*) as subtree from up group by all)
select * from roots join sizes using (job_id, step, task_id)""", recursive=True)
def _task_lineage(spark, sf_dir):
    return lineage.lineage(table(spark, sf_dir, "task_links"))


WALK = """
, pairs(graph, step, reached, distance) as (
    select graph, step, next_step, 1 from graph_edges
    union
    select p.graph, p.step, e.next_step, p.distance + 1 from pairs p
    join graph_edges e on e.graph = p.graph and e.step = p.reached where p.distance < 13)
, reach as (select graph, step, reached, cast(min(distance) as bigint) as distance from pairs group by all)
"""


@JOBS.add("step_reachability", ("graph_edges",), WALK + "select * from reach", recursive=True)
def _step_reachability(spark, sf_dir):
    return graphs.reachability(table(spark, sf_dir, "graph_edges"))


@JOBS.add("refused_graphs", ("graph_edges", "graph_steps"), WALK + """
select distinct graph, step, 'cycle' as reason from reach where step = reached
union select e.graph, e.step, 'unknown_next' from graph_edges e anti join graph_steps s on s.graph = e.graph and s.step = e.next_step
union select j.graph, j.step, 'unknown_join' from graph_steps j anti join graph_steps s on s.graph = j.graph and s.step = j.join_to where j.join_to is not null
union select graph, step, 'no_queue' from graph_steps where queue is null
union select graph, step, 'repeated_step' from graph_steps group by graph, step having count(*) > 1""", recursive=True)
def _refused_graphs(spark, sf_dir):
    edges = table(spark, sf_dir, "graph_edges")
    return graphs.refused_graphs(table(spark, sf_dir, "graph_steps"), edges, graphs.reachability(edges))


@JOBS.add("step_levels", ("graph_edges", "graph_steps"), WALK + """
, cyclic as (select distinct graph from reach where step = reached)
select s.graph, s.step, cast(coalesce(max(p.distance), 0) as bigint) as level
from (select distinct graph, step from graph_steps) s left join pairs p on p.graph = s.graph and p.reached = s.step
where s.graph not in (select graph from cyclic) group by s.graph, s.step""", recursive=True)
def _step_levels(spark, sf_dir):
    edges = table(spark, sf_dir, "graph_edges")
    return graphs.step_levels(table(spark, sf_dir, "graph_steps"), edges, graphs.reachability(edges))


@JOBS.add("task_with_result", ("task_events", "completion_rows"), TASKS + RESULTS + """
select t.job_id, t.step, t.task_id, t.status, r.primary_result_uri, r.metrics_uri, r.primary_mime, r.primary_size_bytes, r.extra
from tasks t left join results r using (job_id, step, task_id)""")
def _task_with_result(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir).select(*TASK_KEY, "status")
    return reads.task_with_result(tasks, results_of(spark, sf_dir))


@JOBS.add("orphan_rows", ("task_events", "job_updates", "completion_rows"), TASKS + """
, kept as (select distinct job_id from job_updates where status <> 'FAILED'),
 results as (select distinct job_id, step, task_id from completion_rows where status = 'SUCCEEDED'),
 open as (select * from tasks where status <> 'SUCCEEDED')
select 'tasks' as child, job_id, step, task_id from tasks anti join kept using (job_id)
union all select 'results', job_id, step, task_id from results anti join open using (job_id, step, task_id)""")
def _orphans(spark, sf_dir):
    """Tasks of jobs that were never without failure, results of finished tasks."""
    tasks = tasks_of(spark, sf_dir)
    jobs = table(spark, sf_dir, "job_updates").filter("status <> 'FAILED'")
    results = table(spark, sf_dir, "completion_rows").filter("status = 'SUCCEEDED'")
    lost_tasks = reads.orphans(tasks, jobs, ["job_id"])
    lost_results = reads.orphans(
        results.select(*TASK_KEY).distinct(), tasks.filter("status <> 'SUCCEEDED'"),
        list(TASK_KEY))
    return lost_tasks.select(F.lit("tasks").alias("child"), *TASK_KEY).unionByName(
        lost_results.select(F.lit("results").alias("child"), *TASK_KEY))


@JOBS.add("purge_jobs", ("task_events", "job_updates", "completion_rows"), TASKS + JOB_TABLE + RESULTS + """
, purge as (select job_id from tasks where status = 'FAILED')
select 'jobs' as state_table, job_id, cast(null as varchar) as step, cast(null as varchar) as task_id from jobs anti join purge using (job_id)
union all select 'tasks', job_id, step, task_id from tasks anti join purge using (job_id)
union all select 'results', job_id, step, task_id from results anti join purge using (job_id)""")
def _purge_jobs(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir)
    before = reads.StateTables(jobs_of(spark, sf_dir), tasks, results_of(spark, sf_dir))
    kept = reads.purge_jobs(before, tasks.filter("status = 'FAILED'"))
    blank = F.lit(None).cast("string")
    return reads.union_all([
        kept.jobs.select(F.lit("jobs").alias("state_table"), "job_id",
                         blank.alias("step"), blank.alias("task_id")),
        kept.tasks.select(F.lit("tasks").alias("state_table"), *TASK_KEY),
        kept.results.select(F.lit("results").alias("state_table"), *TASK_KEY)])


@JOBS.add("state_constraints", ("task_events", "job_updates"), """
, t as (select *, ts as created_at, ts as updated_at from task_events)
select 'tasks' as state_table, 'unique_key' as rule, count(*) as violations from (select 1 from task_events group by job_id, step, task_id having count(*) > 1)
union all select 'tasks', 'status', count(*) filter (status not in ('QUEUED', 'STARTED', 'RETRIED', 'SUCCEEDED', 'FAILED', 'CANCELLED', 'DLQ')) from t
union all select 'tasks', 'not_null:job_id', count(*) filter (job_id is null) from t
union all select 'tasks', 'not_null:step', count(*) filter (step is null) from t
union all select 'tasks', 'not_null:task_id', count(*) filter (task_id is null) from t
union all select 'tasks', 'not_null:user_id', count(*) filter (user_id is null) from t
union all select 'tasks', 'not_null:status', count(*) filter (status is null) from t
union all select 'tasks', 'not_null:retry_count', count(*) filter (retry_count is null) from t
union all select 'tasks', 'not_null:params', count(*) filter (params is null) from t
union all select 'jobs', 'unique_key', count(*) from (select 1 from job_updates group by job_id having count(*) > 1)
union all select 'jobs', 'status', count(*) filter (status not in ('QUEUED', 'RUNNING', 'SUCCEEDED', 'FAILED', 'CANCELLED', 'DLQ')) from job_updates
union all select 'jobs', 'not_null:job_id', count(*) filter (job_id is null) from job_updates
union all select 'jobs', 'not_null:user_id', count(*) filter (user_id is null) from job_updates
union all select 'jobs', 'not_null:schema', count(*) filter (schema is null) from job_updates
union all select 'jobs', 'not_null:status', count(*) filter (status is null) from job_updates
union all select 'jobs', 'not_null:attrs', count(*) filter (attrs is null) from job_updates""")
def _state_constraints(spark, sf_dir):
    tasks = reads.audit_constraints(
        table(spark, sf_dir, "task_events"), schemas.tasks(), TASK_KEY, TASK_STATUSES)
    jobs = reads.audit_constraints(
        table(spark, sf_dir, "job_updates"), schemas.jobs(), schemas.JOB_KEY, JOB_STATUSES)
    return tasks.withColumn("state_table", F.lit("tasks")).unionByName(
        jobs.withColumn("state_table", F.lit("jobs")))
