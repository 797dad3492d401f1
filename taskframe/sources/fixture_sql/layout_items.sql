select h.job_id, h.user_id, h.step, h.task_id, h.child_pos, concat('s3://work/', h.user_id, '/', h.job_id, '/', h.step, '/') as step_prefix,
  case when h.step in ('ENHANCEMENT', 'ANALYSIS') then 'files' when h.step = 'SEGMENTATION' then 'single'
    when h.step = 'MODEL_PROFILE' and h.child_pos in (1, 3, 4) then 'aux' when h.child_pos >= 1 then 'metrics' else 'single' end as shape,
  case when h.step in ('SEGMENTATION', 'ANALYSIS') then h.child_pos end as list_pos,
  case when h.step = 'SEGMENTATION' then n.items when h.step = 'ANALYSIS' then 1 end as list_size,
  h.child_pos as file_pos,
  case when h.step = 'MODEL_PROFILE' then case h.child_pos when 1 then 'notes.txt' when 3 then 'bad/name.txt' when 4 then 'odd.txt' end
    when h.step in ('ENHANCEMENT', 'ANALYSIS') then
    case cast(h.child_pos % 5 as int) when 0 then 'thumb.png' when 1 then 'Result.png' when 2 then 'a/b.json' when 3 then 'bad;name.png' else 'notes.zzz' end end as file_name,
  case when h.step = 'MODEL_PROFILE' and h.child_pos = 4 then 'number' when h.step = 'SCRIPT_GENERATION' or (h.step = 'MODEL_PROFILE' and h.child_pos = 2)
    or (h.step = 'SEGMENTATION' and h.child_pos % 2 = 1) then 'json' else 'bytes' end as kind,
  cast(length(h.child_params) as bigint) as size_bytes
from hook_children h join (select job_id, cast(count(*) as int) as items from hook_children group by job_id) n on n.job_id = h.job_id
