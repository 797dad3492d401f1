select seq, ts, job_id, step, task_id, user_id, status, retry_count, params, error_code,
  case when seq % 11 = 0 then '' else primary_result_uri end as primary_result_uri,
  case when seq % 3 = 0 then '' else cast(null as string) end as metrics_uri,
  case when seq % 11 = 0 then cast(null as string) else 'image/png' end as primary_mime,
  case when seq % 11 = 0 then cast(null as bigint) else primary_size_bytes end as primary_size_bytes,
  concat('{"seq":', cast(seq as string), '}') as extra
from task_events
