select job_id, step, task_id, child_pos as uri_pos,
  concat('s3://work/', user_id, '/', job_id, '/', step, '/S', cast(child_pos as string), '/result.json') as uri
from hook_children
where (step = 'SCRIPT_GENERATION' and child_pos < 3) or (step = 'ENHANCEMENT' and child_pos = 0)
