select seq, ts, case when seq % 10 = 0 then concat(lower(step), '.fifo') else lower(step) end as queue,
  case when seq % 20 = 0 then cast(null as string) else job_id end as group_id,
  case when seq % 15 = 0 then concat('d', cast(seq % 30 as string)) end as dedup_id,
  cast(seq % 2000 - 500 as int) as delay_seconds, job_id, user_id, step, task_id, retry_count, params
from task_events
