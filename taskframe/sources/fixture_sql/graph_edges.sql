with n as (select user_id as graph, cast(seq % 9 as int) as a, cast(floor(seq / 9) % 3 as int) as b, seq from task_events)
select distinct graph, concat('STEP_', cast(a as string)) as step,
  concat('STEP_', cast(case when seq % 401 = 0 then cast(floor(a / 2) as int) when seq % 307 = 0 then 11 else least(a + 1 + b, 10) end as string)) as next_step
from n
