"""Jobs over raw messages: parse, validate, normalise, serialise, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskframe.functions import paths
from taskframe.operators import normalize, serialize, validate
from taskframe.operators.envelopes import parse_envelopes, read_payloads
from taskframe.functions.json_values import as_text, computed_once, field
from taskframe.plans.registry import Jobs
from taskframe.sources.dag import Dag
from taskframe.sources.tables import table

JOBS = Jobs()
BUCKET = "work"

# --- SQL shared by the oracles ---------------------------------------------

PARSED = """
, doc as (
  select *, case when json_valid(body) then body::json end as d from raw_messages),
opened as (
  select message_id, sent_ts, coalesce(receive_count, 1) as receive_count, body, d,
    case when json_type(d) = 'OBJECT' and json_exists(d, '$.Message') then
      case when json_type(d, '$.Message') = 'VARCHAR' then
        case when json_valid(d->>'$.Message') then (d->>'$.Message')::json end
      else d->'$.Message' end
    else d end as p
  from doc)
"""

_ID = "'[a-zA-Z0-9_-]+'"
CHECKED = PARSED + f"""
, fields as (
  select *, p->>'$.job_id' as job_id, p->>'$.task_id' as task_id, p->>'$.user_id' as user_id,
    p->>'$.schema' as schema, p->>'$.step' as step, p->>'$.input_uri' as input_uri,
    p->>'$.output_prefix' as output_prefix, cast(p->'$.params' as varchar) as params,
    regexp_matches(body, '"retry_count": [0-9]{{20}}') as beyond, p->>'$.trace_id' as trace_id, p->>'$.parent_task_id' as parent_task_id,
    array_to_string(list_filter(
      ['job_id', 'task_id', 'user_id', 'schema', 'step', 'input_uri', 'output_prefix', 'params'],
      lambda k: not list_contains(json_keys(p), k)), ', ') as missing,
    case when json_type(p, '$.job_id') <> 'VARCHAR' then 'job_id'
      when json_type(p, '$.task_id') <> 'VARCHAR' then 'task_id'
      when json_type(p, '$.user_id') <> 'VARCHAR' then 'user_id'
      when json_type(p, '$.schema') <> 'VARCHAR' then 'schema'
      when json_type(p, '$.step') <> 'VARCHAR' then 'step'
      when json_type(p, '$.input_uri') <> 'VARCHAR' then 'input_uri'
      when json_type(p, '$.output_prefix') <> 'VARCHAR' then 'output_prefix'
      when json_type(p, '$.params') <> 'OBJECT' then 'params'
      when coalesce(json_type(p, '$.retry_count'), 'UBIGINT') not in ('UBIGINT', 'BIGINT', 'BOOLEAN') and not beyond then 'retry_count'
      when coalesce(json_type(p, '$.trace_id'), 'NULL') not in ('NULL', 'VARCHAR') then 'trace_id'
      when coalesce(json_type(p, '$.parent_task_id'), 'NULL') not in ('NULL', 'VARCHAR') then 'parent_task_id'
    end as wrong_type
  from opened),
checked as (
  select *, coalesce(try_cast(p->>'$.retry_count' as bigint), 0) as retry_count,
    case when p is null or json_type(p) <> 'OBJECT' then 'parse'
      when missing <> '' then 'missing'
      when wrong_type is not null then 'type'
      when beyond then 'retry_range'
      when not (regexp_full_match(user_id, {_ID}) and length(user_id) <= 128) then 'user_id'
      when not (regexp_full_match(job_id, {_ID}) and length(job_id) <= 128) then 'job_id'
      when not (regexp_full_match(task_id, {_ID}) and length(task_id) <= 256) then 'task_id'
      when schema <> 'v1' then 'schema'
      when step not in (select step from step_def) then 'step'
      when input_uri <> '' and not (
        (starts_with(input_uri, 's3://') or starts_with(input_uri, 'r2://'))
        and not contains(input_uri, '..') and not regexp_matches(input_uri, '[;|&`]')
        and not contains(input_uri, '$(') and split_part(input_uri, '/', 3) = 'work'
        and regexp_matches(lower(input_uri), '[.](json|png|jpg|jpeg|mp4|mp3|wav|txt)$')) then 'input_uri'
      when contains(output_prefix, '..') or output_prefix not in (
        concat('s3://', split_part(output_prefix, '/', 3), '/', user_id, '/', job_id, '/', step, '/'),
        concat('s3://', split_part(output_prefix, '/', 3), '/', user_id, '/', job_id, '/', step, '/', task_id, '/'))
        then 'output_prefix'
      when length(params) > 65536 then 'params'
      when not (parent_task_id is null or (regexp_full_match(parent_task_id, {_ID}) and length(parent_task_id) <= 256)) then 'parent'
      when not (trace_id is null or trace_id = '' or (regexp_full_match(trace_id, '[a-fA-F0-9_-]+') and length(trace_id) <= 128)) then 'trace'
    end as reason
  from fields)
"""
_MESSAGE = """message_id, sent_ts, receive_count, job_id, task_id, user_id, schema, step, input_uri,
  output_prefix, params, retry_count, trace_id, parent_task_id"""
ACCEPTED = CHECKED + f", accepted as (select {_MESSAGE} from checked where reason is null)"
RAW = ("raw_messages", "step_def")


def accepted_messages(spark, sf_dir):
    return validate.validate_messages(
        table(spark, sf_dir, "raw_messages"), Dag.default(), [BUCKET]).accepted


# --- parse and validate -----------------------------------------------------

@JOBS.add("parse_envelopes", ("raw_messages",), PARSED + """
select message_id, receive_count,
  case when d is null then 'not_json' when p is null then 'envelope_not_json'
    when json_type(p) <> 'OBJECT' then 'not_an_object' end as parse_problem,
  p->>'$.job_id' as job_id, p->>'$.task_id' as task_id
from opened""")
def _parse(spark, sf_dir):
    parsed = parse_envelopes(table(spark, sf_dir, "raw_messages"))
    return parsed.select(
        "message_id", "receive_count", "parse_problem",
        as_text(field(F.col("payload"), "job_id")).alias("job_id"),
        as_text(field(F.col("payload"), "task_id")).alias("task_id"))


@JOBS.add("validate_messages", RAW, ACCEPTED + "select * from accepted")
def _validate(spark, sf_dir):
    return accepted_messages(spark, sf_dir)


@JOBS.add("rejected_messages", RAW, CHECKED + """
select message_id, sent_ts, receive_count, reason,
  case reason when 'parse' then case when d is null then 'not_json' when p is null then 'envelope_not_json' else 'not_an_object' end
    when 'missing' then missing when 'type' then wrong_type when 'retry_range' then 'retry_count' when 'user_id' then user_id when 'job_id' then job_id
    when 'task_id' then task_id when 'schema' then schema when 'step' then step when 'input_uri' then input_uri
    when 'output_prefix' then output_prefix when 'params' then 'too large or too deep'
    when 'parent' then parent_task_id else trace_id end as detail, body
from checked where reason is not null""")
def _rejected(spark, sf_dir):
    return validate.validate_messages(
        table(spark, sf_dir, "raw_messages"), Dag.default(), [BUCKET]).rejected


@JOBS.add("reject_report", RAW, CHECKED + """
select reason, count(*) as messages from checked where reason is not null group by reason""")
def _reject_report(spark, sf_dir):
    return validate.reject_report(_rejected(spark, sf_dir))


@JOBS.add("fanout_share", RAW, ACCEPTED + """
select step, count(*) as messages, count(parent_task_id) as children,
  count(*) - count(parent_task_id) as roots from accepted group by step""")
def _fanout_share(spark, sf_dir):
    return validate.fanout_share(accepted_messages(spark, sf_dir))


# --- normalise and serialise ------------------------------------------------

NORMALIZED = """
, doc as (
  select *, case when json_valid(body) then body::json end as d from raw_messages),
fields as (
  select *, trim(d->>'$.job_id') as j, trim(d->>'$.task_id') as t, trim(d->>'$.user_id') as u,
    trim(d->>'$.schema') as s, trim(d->>'$.step') as st, trim(d->>'$.input_uri') as i,
    trim(d->>'$.output_prefix') as o, try_cast(trim(d->>'$.retry_count') as bigint) as rc
  from doc),
checked as (
  select *,
    case when d is null then 'parse' when json_type(d) <> 'OBJECT' then 'root'
      when not list_has_all(json_keys(d), ['job_id', 'task_id', 'user_id', 'schema', 'step',
        'input_uri', 'output_prefix', 'params', 'retry_count']) then 'missing'
      when json_type(d, '$.params') <> 'OBJECT' then 'params'
      when rc is null then 'retry'
      when coalesce(json_type(d, '$.parent_task_id'), 'NULL') not in ('NULL', 'VARCHAR') then 'parent'
      when j = '' then 'job_id'
      when i = '' then 'input_empty' when not starts_with(i, 's3://') then 'input_scheme'
      when not regexp_full_match(substr(i, 6), '[^/]+/.+') then 'input_shape'
      when not regexp_full_match(split_part(i, '/', 3), '[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]') then 'input_bucket_name'
      when split_part(i, '/', 3) <> 'work' then 'input_bucket'
      when o = '' then 'prefix_empty' when not starts_with(o, 's3://') then 'prefix_scheme'
      when not regexp_full_match(substr(o, 6), '[^/]+/.+') then 'prefix_shape'
      when not regexp_full_match(split_part(o, '/', 3), '[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]') then 'prefix_bucket_name'
      when split_part(o, '/', 3) <> 'work' then 'prefix_bucket'
      when u = '' then 'user_id' when st = '' then 'step' when rc < 0 then 'retry' end as reason
  from fields),
lowered as (
  select *, array_to_string(list_transform(string_split(i, '/'), lambda x:
      case when regexp_full_match(x, '[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32}') then lower(x) else x end), '/') as i2,
    array_to_string(list_transform(string_split(o, '/'), lambda x:
      case when regexp_full_match(x, '[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32}') then lower(x) else x end), '/') as o2
  from checked),
normalized as (
  select message_id,
    case when regexp_full_match(j, '[0-9A-Fa-f]{8}|[0-9A-Fa-f]{32}') then lower(j) else j end as job_id,
    case when t = '' then 'S0' else t end as task_id, u as user_id,
    case when s = '' then 'v1' else s end as schema, upper(st) as step, i2 as input_uri,
    case when ends_with(o2, '/') then o2 else concat(o2, '/') end as output_prefix,
    cast(d->'$.params' as varchar) as params, rc as retry_count,
    d->>'$.parent_task_id' as parent_task_id
  from lowered where reason is null)
"""


@JOBS.add("normalize_messages", ("raw_messages",), NORMALIZED + "select * from normalized")
def _normalize(spark, sf_dir):
    return normalize.normalize_messages(table(spark, sf_dir, "raw_messages"), BUCKET).accepted


@JOBS.add("unnormalized_report", ("raw_messages",), NORMALIZED + """
select reason, count(*) as messages from checked where reason is not null group by reason""")
def _unnormalized(spark, sf_dir):
    refused = normalize.normalize_messages(
        table(spark, sf_dir, "raw_messages"), BUCKET).rejected
    return validate.reject_report(refused)


@JOBS.add("serialize_work_messages", ("raw_messages",), NORMALIZED + """
select message_id, concat('{"job_id":"', job_id, '","task_id":"', task_id, '","user_id":"', user_id,
  '","schema":"', schema, '","step":"', step, '","input_uri":"', input_uri, '","output_prefix":"', output_prefix,
  '","params":', params, ',"retry_count":', retry_count,
  case when parent_task_id is null then '' else concat(',"parent_task_id":"', parent_task_id, '"') end, '}') as body
from normalized""")
def _serialize_work(spark, sf_dir):
    return serialize.serialize_work_messages(_normalize(spark, sf_dir))


@JOBS.add("serialize_messages", RAW, ACCEPTED + """
select message_id, case when input_uri = '' then 'input_uri' end as missing,
  case when input_uri <> '' then concat('{"job_id":"', job_id, '","task_id":"', task_id, '","user_id":"', user_id,
  '","schema":"', schema, '","step":"', step, '","input_uri":"', input_uri, '","output_prefix":"', output_prefix,
  '","params":', params, ',"retry_count":', retry_count,
  case when trace_id is null then '' else concat(',"trace_id":"', trace_id, '"') end,
  case when parent_task_id is null then '' else concat(',"parent_task_id":"', parent_task_id, '"') end,
  '}') end as body
from accepted""")
def _serialize(spark, sf_dir):
    out = serialize.serialize_task_messages(accepted_messages(spark, sf_dir))
    return out.bodies.unionByName(out.refused, allowMissingColumns=True)


@JOBS.add("serialize_with_extras", RAW, ACCEPTED + """
select message_id, message_id as origin, step, trace_id
from accepted where input_uri <> ''""")
def _serialize_extras(spark, sf_dir):
    extra = F.to_json(F.struct(
        F.col("message_id").alias("origin"), F.lit("ignored").alias("step")))
    out = serialize.serialize_task_messages(
        accepted_messages(spark, sf_dir).withColumn("extra", extra))
    body = F.from_json("body", "origin string, step string, trace_id string")
    return out.bodies.select("message_id", body.alias("b")).select("message_id", "b.*")


# --- paths, names, types ----------------------------------------------------

@JOBS.add("uri_parts", ("raw_messages",), PARSED + """
, uris as (select message_id, p->>'$.input_uri' as input_uri, p->>'$.output_prefix' as output_prefix
  from opened where json_type(p) = 'OBJECT')
select message_id, input_uri, output_prefix,
  case when input_uri = '' then 'empty' when not starts_with(input_uri, 's3://') then 'scheme' end as problem,
  case when starts_with(input_uri, 's3://') then split_part(input_uri, '/', 3) end as bucket,
  case when starts_with(input_uri, 's3://') then substr(input_uri, 7 + length(split_part(input_uri, '/', 3))) end as object_key,
  nullif(regexp_extract(output_prefix, '^s3://[a-z0-9.-]+/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)/[^/]+(/[^/]+)?/?$', 1), '') as user_id,
  nullif(regexp_extract(output_prefix, '^s3://[a-z0-9.-]+/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)/[^/]+(/[^/]+)?/?$', 2), '') as job_id,
  concat(array_to_string(string_split(output_prefix, '/')[1:6], '/'), '/') as step_prefix
from uris""")
def _uri_parts(spark, sf_dir):
    payloads = read_payloads(
        table(spark, sf_dir, "raw_messages"), "input_uri string, output_prefix string")
    uris = computed_once(
        payloads, known=F.col("_r").isNotNull(), input_uri=F.col("_r.input_uri"),
        output_prefix=F.col("_r.output_prefix")).filter("known")
    return uris.select(
        "message_id", "input_uri", "output_prefix",
        paths.uri_problem(F.col("input_uri")).alias("problem"),
        paths.uri_bucket(F.col("input_uri")).alias("bucket"),
        paths.uri_key(F.col("input_uri")).alias("object_key"),
        paths.prefix_user_id(F.col("output_prefix")).alias("user_id"),
        paths.prefix_job_id(F.col("output_prefix")).alias("job_id"),
        paths.step_level(F.col("output_prefix")).alias("step_prefix"))


@JOBS.add("build_prefixes", ("prefix_parts", "step_def"), """
, t as (select *, trim(trim(bucket), '/') as b, trim(trim(user_id), '/') as u, trim(trim(job_id), '/') as j,
    upper(trim(trim(step), '/')) as s, trim(trim(task_id), '/') as k from prefix_parts),
 g as (select *, bucket <> '' and user_id <> '' and regexp_full_match(b, '[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]')
    and regexp_full_match(u, '[a-zA-Z0-9_-]{1,128}') and s in (select step from step_def) as ok from t)
select seq, case when ok and regexp_full_match(k, '[a-zA-Z0-9_-]{1,256}') then concat('s3://', b, '/', u, '/', j, '/', s, '/', k, '/') end as output_prefix,
  case when ok then concat('s3://', b, '/', u, '/', j, '/', s, '/') end as step_prefix,
  case when trim(bucket) <> '' and trim(user_id) <> '' then concat('s3://', trim(bucket), '/', trim(user_id), '/', trim(job_id), '/', upper(trim(step)), '/',
    case when trim(task_id) = '' then 'S0' else trim(task_id) end) end as base_prefix,
  case when trim(bucket) <> '' and trim(user_id) <> '' then concat('s3://', trim(bucket), '/', trim(user_id), '/', trim(job_id), '/MODEL_PROFILE/',
    case when trim(task_id) = '' then 'S0' else trim(task_id) end, '/request.json') end as request_uri
from g""")
def _build_prefixes(spark, sf_dir):
    c = F.col
    steps = Dag.default().names
    parts = (c("bucket"), c("user_id"), c("job_id"))
    profile = paths.base_prefix(*parts, F.lit("MODEL_PROFILE"), c("task_id"))
    return table(spark, sf_dir, "prefix_parts").select(
        "seq",
        paths.checked_prefix(*parts, c("step"), steps, c("task_id")).alias("output_prefix"),
        paths.checked_prefix(*parts, c("step"), steps).alias("step_prefix"),
        paths.base_prefix(*parts, c("step"), c("task_id")).alias("base_prefix"),
        F.concat(profile, F.lit("/request.json")).alias("request_uri"))


@JOBS.add("prepare_uris", ("prefix_parts",), """
, p as (select seq, upper(replace(job_id, '/', '')) as j, concat(' s3://work/', upper(replace(job_id, '/', '')), '/%66', case when seq % 2 = 0 then 'eedbee1' else 'xx' end, '/in.json') as i,
    concat(case when seq % 5 = 0 then 's3:/' else 's3://' end, 'work/u/', upper(replace(job_id, '/', ''))) as o from prefix_parts)
select seq, case when seq % 5 = 0 then 'prefix_scheme' end as problem,
  case when seq % 5 <> 0 then lower(j) end as job_id,
  case when seq % 5 <> 0 then concat('s3://work/', lower(j), case when seq % 2 = 0 then '/feedbee1' else '/%66xx' end, '/in.json') end as input_uri,
  case when seq % 5 <> 0 then concat('s3://work/u/', lower(j), '/') end as output_prefix
from p""")
def _prepare_uris(spark, sf_dir):
    j = F.upper(F.replace("job_id", F.lit("/"), F.lit("")))
    even = F.col("seq") % 2 == 0
    rows = table(spark, sf_dir, "prefix_parts").select(
        "seq", j.alias("job_id"),
        F.concat(F.lit(" s3://work/"), j, F.lit("/%66"),
                 F.when(even, "eedbee1").otherwise("xx"), F.lit("/in.json")).alias("input_uri"),
        F.concat(F.when(F.col("seq") % 5 == 0, "s3:/").otherwise("s3://"),
                 F.lit("work/u/"), j).alias("output_prefix"))
    return normalize.prepare_uris(rows, BUCKET)


@JOBS.add("safe_names", ("name_rows",), """
, t as (select *, trim(file_name) as n, translate(file_name, concat('/', chr(92)), '') as s from name_rows)
select job_id, step, task_id, item_pos, file_name,
  case when contains(s, '..') or regexp_matches(s, '[;|&$`]') or s in ('', '.') then null else s end as clean_name,
  case when n = '' then 'empty' when starts_with(n, '/') or contains(n, '..') then 'traversal'
    when contains(n, '/') or contains(n, chr(92)) then 'slash'
    when contains(n, chr(9)) or contains(n, ';') or contains(n, '|') then 'character' end as problem,
  case when n = '' or contains(n, '..') or contains(n, '/') or contains(n, chr(92)) or contains(n, chr(9))
    or contains(n, ';') or contains(n, '|') then null else concat(prefix, '/', n) end as uri
from t""")
def _safe_names(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "name_rows").select(
        "job_id", "step", "task_id", "item_pos", "file_name",
        paths.clean_file_name(c("file_name")).alias("clean_name"),
        paths.file_name_problem(c("prefix"), c("file_name")).alias("problem"),
        paths.file_uri(c("prefix"), c("file_name")).alias("uri"))


@JOBS.add("mime_types", ("name_rows",), """
, t as (select *, lower(regexp_extract(split_part(split_part(regexp_extract(file_name, '([^/]*)$', 1), '?', 1), '#', 1), '[^.].*?([.][^.]*)$', 1)) as ext from name_rows)
select job_id, step, task_id, item_pos, file_name, ext,
  case ext when '.json' then 'application/json; charset=utf-8' when '.png' then 'image/png' when '.mp4' then 'video/mp4'
    when '.txt' then 'text/plain; charset=utf-8' else 'application/octet-stream' end as mime,
  regexp_matches(lower(file_name), '[.](json|png|jpg|jpeg|mp4|mp3|wav|txt)$') as allowed
from t""")
def _mime_types(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "name_rows").select(
        "job_id", "step", "task_id", "item_pos", "file_name",
        paths.extension(c("file_name")).alias("ext"),
        paths.content_type(c("file_name")).alias("mime"),
        paths.has_extension(c("file_name")).alias("allowed"))
