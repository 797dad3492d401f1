"""Jobs that run user code or deal with a generative model."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskframe.operators import fanout, hooks, layout, model_calls, runs
from taskframe.operators.sample_hook import CountingHook, ReportingHook
from taskframe.functions.paths import step_level
from taskframe.plans.messages import ACCEPTED, BUCKET, RAW, accepted_messages
from taskframe.plans.registry import Jobs
from taskframe.session import scratch_dir
from taskframe.sources.dag import Dag
from taskframe.sources.tables import table

JOBS = Jobs()

# --- user hook --------------------------------------------------------------

HOOKED = ACCEPTED + """
, hooked as (select *, cast(params->>'$.k' as int) as k from accepted)
"""


def processed(spark, sf_dir):
    return hooks.run_hook(accepted_messages(spark, sf_dir), CountingHook(), {"refuse": 10})


@JOBS.add("apply_hook", RAW, HOOKED + """
select message_id, job_id, step, task_id, case when k % 10 = 0 then 'FAILED' else 'SUCCEEDED' end as status,
  case when k % 10 = 0 then 'PROCESS_ERROR' end as error_code, case when k % 10 = 0 then concat('k is ', k) end as error_message,
  case when k % 10 <> 0 then concat('{"k": ', k, '}') end as metrics, cast(case when k % 10 <> 0 then k % 4 end as int) as n_children
from hooked""")
def _apply_hook(spark, sf_dir):
    size = F.when(F.col("children").isNotNull(), F.size("children"))
    return processed(spark, sf_dir).select(
        *hooks.KEYS, "status", "error_code", "error_message", "metrics",
        size.alias("n_children"))


@JOBS.add("hook_artifacts", RAW, HOOKED + """
, i as (select message_id, job_id, task_id, step, k, filetype, array_to_string(string_split(output_prefix, '/')[1:6], '/') as prefix
  from hooked join step_def using (step) where k % 10 <> 0)
select message_id, concat(prefix, '/', task_id, '/result.', filetype) as uri, 'application/json; charset=utf-8' as mime from i
union all select message_id, concat(prefix, '/metrics.json'), 'application/json; charset=utf-8' from i
union all select message_id, concat(prefix, '/note.txt'), 'text/plain; charset=utf-8' from i""")
def _hook_artifacts(spark, sf_dir):
    messages = accepted_messages(spark, sf_dir).withColumn(
        "step_prefix", step_level(F.col("output_prefix")))
    done = hooks.apply_hook(messages, CountingHook(), {"refuse": 10}).succeeded
    items = hooks.output_items(done, messages)
    return layout.result_layout(items, Dag.default()).written.select("message_id", "uri", "mime")


@JOBS.add("hook_children", RAW + ("step_edge",), HOOKED + """
, c as (select h.*, e.next_step, unnest(range(k % 4)) as pos, k % 4 as n from hooked h join step_edge e using (step) where k % 10 <> 0)
select job_id, concat('S', case when n = 1 then cast(substr(task_id, 2) as bigint) else pos end) as task_id, next_step as step,
  concat('{"part":', pos, '}') as params, task_id as parent_task_id, cast(pos as int) as child_pos
from c""")
def _hook_children(spark, sf_dir):
    messages = accepted_messages(spark, sf_dir).select(
        "message_id", "user_id", "schema", "trace_id")
    done = processed(spark, sf_dir).filter("status = 'SUCCEEDED'").select(
        *hooks.KEYS, "children").join(messages, "message_id")
    children = fanout.explode_children(done).withColumn(
        "written_uri", F.lit(None).cast("string"))
    return fanout.fanout_children(children, Dag.default(), BUCKET).select(
        "job_id", "task_id", "step", "params", "parent_task_id", "child_pos")


# --- runs from raw messages to the outbox -------------------------------------

RUN = HOOKED + """
, w as (select *, array_to_string(string_split(output_prefix, '/')[1:6], '/') as prefix, k % 10 <> 0 and k % 7 <> 3 as good from hooked)
, files as (select message_id, prefix, task_id, good, k, unnest(range(k % 5 + 1)) as i from w)
, a as (select message_id, concat(prefix, '/', task_id, '/part_', i, '.txt') as uri, 'text/plain; charset=utf-8' as mime, repeat(concat(task_id, ' ', i, ' '), k) as t from files where good
  union all select message_id, concat(prefix, '/metrics.json'), 'application/json; charset=utf-8', concat('{', chr(10), '  "k": ', k, ',', chr(10), '  "task": "', task_id, '"', chr(10), '}') from w where good)
, child as (select w.*, e.next_step, d.queue, unnest(range(k % 4)) as pos from w join step_edge e using (step) join step_def d on d.step = e.next_step where good)
, named as (select *, concat('S', case when k % 4 = 1 then cast(substr(task_id, 2) as bigint) else pos end) as child_id from child)
"""
RUN_TABLES = RAW + ("step_edge",)


def worked_off(spark, sf_dir) -> str:
    """Folder of a run over all accepted messages, in small flushes, attempted twice."""
    base = scratch_dir(spark, "run")
    for _ in range(2):
        runs.run_messages(accepted_messages(spark, sf_dir), ReportingHook(), Dag.default(), BUCKET, base, "run-1", flush_bytes=4096)
    return base


@JOBS.add("message_outcomes", RUN_TABLES, RUN + """
select message_id, job_id, step, task_id, case when good then 'SUCCEEDED' else 'FAILED' end as status, case when not good then 'PROCESS_ERROR' end as error_code,
  case when k % 10 = 0 then concat('k is ', k) when k % 7 = 3 then concat('artifact ', k % 5 + 2, ' refused: extension') end as error_message,
  case when k % 10 <> 0 then concat('{"k": ', k, ', "task": "', task_id, '"}') end as metrics,
  cast(k % 5 + 1 + case when k % 10 = 0 then 0 when k % 7 in (3, 5) then 2 else 1 end as bigint) as n_artifacts,
  cast(case when k % 10 = 0 then 0 else k % 4 end as bigint) as n_children, cast(case when k % 10 <> 0 and k % 7 in (3, 5) then 1 else 0 end as bigint) as n_refused
from w""")
def _message_outcomes(spark, sf_dir):
    return runs.read_outcomes(spark, worked_off(spark, sf_dir)).select(
        *hooks.KEYS, "status", "error_code", "error_message", "metrics", "n_artifacts", "n_children", "n_refused")


@JOBS.add("message_artifacts", RUN_TABLES, RUN + """
select uri, max(mime) as mime, cast(strlen(max_by(t, message_id)) as bigint) as size_bytes, sha256(max_by(t, message_id)) as sha256 from a group by uri""")
def _message_artifacts(spark, sf_dir):
    return runs.read_artifacts(spark, worked_off(spark, sf_dir)).select(
        "uri", "mime", F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


@JOBS.add("message_pipeline", RUN_TABLES, RUN + """
select 'child' as kind, queue, 0 as delay_seconds, job_id as group_id, cast(null as varchar) as dedup_id,
  concat('{"job_id":"', job_id, '","task_id":"', child_id, '","user_id":"', user_id, '","schema":"', schema, '","step":"', next_step,
    '","input_uri":"', prefix, '/', task_id, '/part_0.txt","output_prefix":"s3://work/', user_id, '/', job_id, '/', next_step, '/', child_id,
    '/","params":{"part":', pos, '},"parent_task_id":"', task_id, '"', case when trace_id is null then '' else concat(',"trace_id":"', trace_id, '"') end, ',"retry_count":0}') as body
from named
union all select 'completion', 'results', 0, job_id, null,
  concat('{"schema":"', schema, '","job_id":"', job_id, '","task_id":"', task_id, '","user_id":"', user_id, '","step":"', step, '","input_uri":"', input_uri,
    '","output_prefix":"', output_prefix, '","params":', replace(params, ': ', ':'), ',"retry_count":', retry_count,
    ',"primary_result_uri":"', prefix, '/', task_id, '/part_0.txt","metrics_uri":"', prefix, '/metrics.json","primary_mime":"text/plain; charset=utf-8","primary_size_bytes":',
    strlen(task_id) * k + 3 * k, case when trace_id is null then '' else concat(',"trace_id":"', trace_id, '"') end,
    case when parent_task_id is null then '' else concat(',"parent_task_id":"', parent_task_id, '"') end, '}')
from w where good""")
def _message_pipeline(spark, sf_dir):
    """Raw messages to outgoing ones: children of finished tasks, and a completion of each."""
    return runs.read_messages(spark, worked_off(spark, sf_dir))


# --- model requests and responses -------------------------------------------

def prompts(spark, sf_dir):
    """Prompts; every third one carries a named and an unnamed image."""
    name = F.concat(F.lit("in."), F.element_at(
        F.array(*map(F.lit, ("PNG", "webp", "tiff"))), (F.col("call_id") % 3 + 1).cast("int")))
    content = F.encode(F.col("prompt"), "utf-8")
    image = F.array(
        F.struct(name.alias("name"), content.alias("content")),
        F.struct(F.lit(None).cast("string").alias("name"), content.alias("content")))
    return table(spark, sf_dir, "model_prompts").withColumn(
        "images", F.when(F.col("call_id") % 5 < 2, image))


PROMPTS = """
, p as (select *, kind = 'image' and aspect_ratio = '2:1' as refused, base64(encode(prompt)) as b64 from model_prompts)
"""


@JOBS.add("model_requests", ("model_prompts",), PROMPTS + """
select call_id, kind,
  case when kind = 'image' then case aspect_ratio when '1:1' then 1024 when '16:9' then 1344 when '3:4' then 864 when '21:9' then 1536 end end as width,
  case when kind = 'image' then case aspect_ratio when '1:1' then 1024 when '16:9' then 768 when '3:4' then 1184 when '21:9' then 672 end end as height,
  concat('{"contents":[{"role":"user","parts":[{"text":', to_json(prompt), '}',
    case when call_id % 5 < 2 then concat(',{"inline_data":{"mime_type":"', case call_id % 3 when 0 then 'image/png' when 1 then 'image/webp' else 'image/jpeg' end,
      '","data":"', b64, '"}},{"inline_data":{"mime_type":"image/png","data":"', b64, '"}}') else '' end,
    ']}],"generationConfig":{', case when kind = 'image' then concat('"responseModalities":["IMAGE"],"imageConfig":{"aspectRatio":"', aspect_ratio, '"},') else '' end,
    '"temperature":', cast(temperature as varchar), '}}') as body
from p where not refused""")
def _model_requests(spark, sf_dir):
    return model_calls.model_requests(prompts(spark, sf_dir)).accepted


@JOBS.add("refused_requests", ("model_prompts",), PROMPTS + """
select aspect_ratio, count(*) as requests from p where refused group by aspect_ratio""")
def _refused_requests(spark, sf_dir):
    return model_calls.model_requests(prompts(spark, sf_dir)).refused.groupBy(
        "aspect_ratio").agg(F.count(F.lit(1)).alias("requests"))


READ = """
, r as (select *, case when json_valid(body) then body::json end as d from model_responses),
parsed as (
  select call_id, kind, prompt_chars, status_code, elapsed_sec,
    coalesce(json_array_length(d, '$.candidates'), 0) as candidates,
    coalesce(d->>'$.candidates[0].finishReason', d->>'$.candidates[0].finish_reason') as finish_reason,
    case when status_code <> 200 then 'http_status' when d is null then 'not_json'
      when coalesce(json_array_length(d, '$.candidates'), 0) = 0 then 'no_candidates' end as problem,
    trim(concat(d->>'$.candidates[0].content.parts[0].text', d->>'$.candidates[0].content.parts[1].text'), concat(' ', chr(10))) as joined,
    from_base64(d->>'$.candidates[0].content.parts[0].inlineData.data') as image
  from r)
"""


@JOBS.add("parse_responses", ("model_responses",), READ + """
select call_id, status_code, candidates, finish_reason, problem, nullif(joined, '') as text, decode(image) as image_text from parsed""")
def _parse_responses(spark, sf_dir):
    parsed = model_calls.parse_text_responses(table(spark, sf_dir, "model_responses"))
    return parsed.select(
        "call_id", "status_code", "candidates", "finish_reason", "problem", "text",
        F.decode("image", "utf-8").alias("image_text"))


@JOBS.add("parse_image_responses", ("model_responses",), READ + """
select call_id, coalesce(problem, case when image is null then 'no_image' end) as problem, decode(image) as image_text from parsed""")
def _parse_image_responses(spark, sf_dir):
    parsed = model_calls.parse_image_responses(table(spark, sf_dir, "model_responses"))
    return parsed.select(
        "call_id", "problem", F.decode("image", "utf-8").alias("image_text"))


@JOBS.add("extract_answers", ("model_responses",), READ + """
, t as (select call_id, joined as text, case when contains(joined, '```json') then 'fence' when contains(joined, '{') then 'braces' else 'text' end as place,
    case when contains(joined, '{') then regexp_extract(joined, '(?s)[{].*[}]') else joined end as found from parsed where joined <> ''),
 u as (select *, regexp_replace(found, '(\\n\\s*)([a-zA-Z_][a-zA-Z0-9_]*)\\s*:', '\\1"\\2":', 'g') as fixed from t)
select call_id, place as "where", json_valid(found) or json_valid(fixed) as is_json, not json_valid(found) and json_valid(fixed) as repaired,
  case when json_valid(found) then cast(json(found) as varchar) when json_valid(fixed) then cast(json(fixed) as varchar)
    else concat('{"meta":{"note":"Raw response (not JSON)"},"raw_response":', to_json(text), '}') end as answer
from u""")
def _extract_answers(spark, sf_dir):
    parsed = model_calls.parse_text_responses(table(spark, sf_dir, "model_responses"))
    texts = parsed.filter("text is not null").select("call_id", "text")
    return model_calls.extract_answers(texts).drop("text")


@JOBS.add("call_metrics", ("model_responses",), READ + """
select kind, status_code, finish_reason, count(*) as calls, count(problem) as problems, cast(sum(candidates) as bigint) as candidates,
  cast(sum(prompt_chars) as bigint) as prompt_chars, cast(sum(length(nullif(joined, ''))) as bigint) as response_chars,
  cast(sum(octet_length(image)) as bigint) as response_bytes, cast(sum(round(elapsed_sec * 1000)) as bigint) as elapsed_ms,
  quantile_cont(cast(round(elapsed_sec * 1000) as bigint), 0.95) as p95_ms
from parsed group by kind, status_code, finish_reason""")
def _call_metrics(spark, sf_dir):
    return model_calls.call_metrics(
        model_calls.parse_text_responses(table(spark, sf_dir, "model_responses")))
