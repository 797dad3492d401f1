with n as (select distinct user_id as graph, cast(seq % 11 as int) as a from task_events
  union select distinct user_id, 10 from task_events)
select graph, concat('STEP_', cast(a as string)) as step,
  case when a % 7 <> 6 or length(graph) % 2 = 0 then concat('queue_', cast(a as string)) end as queue,
  case when a = 3 then 'STEP_10' when a = 5 and length(graph) % 3 = 0 then 'STEP_12' end as join_to
from n
