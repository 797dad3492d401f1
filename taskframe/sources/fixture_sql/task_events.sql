with d as (select event_id, ts, value, props, event_type,
  lpad(lower(hex(cast(floor(event_id / 40) as bigint))), 8, '0') as job_id,
  concat('u', cast(user_id as string)) as user_id,
  case cast(event_id % 8 as int) when 0 then 'SEGMENTATION' when 1 then 'ANALYSIS' when 2 then 'ENHANCEMENT'
       else 'VIDEO_GENERATION' end as step,
  concat('S', cast(event_id % 4 as string)) as task_id
 from events),
 s as (select *, case when event_type = 'purchase' then 'SUCCEEDED'
       when step = 'VIDEO_GENERATION' and event_type in ('view', 'click') then 'SUCCEEDED'
       when event_type = 'signup' then 'QUEUED' when event_type = 'view' then 'STARTED'
       when event_type = 'click' then 'RETRIED' else 'FAILED' end as status from d)
select event_id as seq, ts, job_id, user_id, step, task_id, status, cast(event_id % 3 as int) as retry_count, props as params,
  case when status = 'FAILED' then 'PROCESS_ERROR' end as error_code,
  case when status = 'SUCCEEDED' then concat('s3://work/', user_id, '/', job_id, '/', step, '/', task_id, '/result.png') end as primary_result_uri,
  case when status = 'SUCCEEDED' then cast(floor(value * 1000) as bigint) end as primary_size_bytes
from s
