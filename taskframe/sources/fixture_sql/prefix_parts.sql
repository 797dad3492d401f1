select seq, case when seq % 19 = 0 then 'Work_Bucket' when seq % 23 = 0 then '' else ' work/' end as bucket,
  case when seq % 17 = 0 then 'u 1' when seq % 29 = 0 then '' else concat(user_id, '/ ') end as user_id,
  concat('/', job_id) as job_id,
  case when seq % 13 = 0 then 'detectoin' else lower(step) end as step,
  case when seq % 7 = 0 then '  ' when seq % 31 = 0 then 'a..b' else concat(' ', task_id) end as task_id
from task_events
