select distinct job_id, step, task_id,
  case when step = 'SEGMENTATION' then 'ENHANCEMENT' when step = 'ANALYSIS' then 'SEGMENTATION'
       when step = 'VIDEO_GENERATION' and task_id = 'S0' then 'ANALYSIS'
       when step = 'VIDEO_GENERATION' then 'VIDEO_GENERATION' end as parent_step,
  case when step = 'SEGMENTATION' then 'S2' when step = 'ANALYSIS' then 'S0'
       when step = 'VIDEO_GENERATION' then case task_id when 'S0' then 'S1' when 'S1' then 'S0' when 'S2' then 'S1' else 'S2' end end as parent_task_id
from task_events
