select job_id, user_id, step, task_id, child_pos as item_pos,
  case cast(child_pos % 5 as int) when 0 then 'thumb.png' when 1 then 'Result.png' when 2 then 'a/b.json' when 3 then 'bad;name.png' else 'notes.txt' end as file_name,
  cast(length(child_params) as bigint) as size_bytes
from hook_children
