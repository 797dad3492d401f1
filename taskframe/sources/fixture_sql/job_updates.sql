select seq, ts, job_id, user_id, 'v1' as schema,
  case status when 'QUEUED' then 'QUEUED' when 'STARTED' then 'RUNNING' when 'RETRIED' then 'RUNNING' else status end as status,
  case when seq % 4 = 0 then cast(null as string) else concat('ab-', cast(seq % 10 as string)) end as trace_id, params as attrs
from task_events
