select distinct concat('s3://work/u0/', job_id, '/', step, '/',
  case cast(seq % 7 as int) when 0 then 'metrics.json' when 1 then concat(task_id, '/result.mp3') else concat(task_id, '/result.png') end) as path
from task_events where status = 'SUCCEEDED'
