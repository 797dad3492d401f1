select job_id, step, task_id, item_pos, concat('s3://work/', user_id, '/', job_id, '/', step) as prefix,
  case cast(item_pos % 9 as int) when 0 then file_name when 1 then concat(' ', upper(file_name), ' ') when 2 then '../etc.json'
    when 3 then concat('a', chr(92), file_name) when 4 then '' when 5 then concat('x', chr(9), '.txt') when 6 then 'archive.zzz'
    when 7 then 'a$b|c.png' else concat('clip.', lower(step), '.MP4?v=1#t') end as file_name
from result_items
