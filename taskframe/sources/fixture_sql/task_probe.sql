select distinct job_id, 'u0' as user_id, step, case when step = 'ANALYSIS' then 'root' else task_id end as task_id,
  concat('s3://work/u0/', job_id, '/', step, '/') as step_prefix
from task_events
