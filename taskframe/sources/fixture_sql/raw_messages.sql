with b as (
 select event_id, ts, event_type, user_id, props, cast(event_id % 50 as int) as f,
  concat('u', cast(user_id as string)) as uid,
  lpad(lower(hex(cast(floor(event_id / 4) as bigint))), 8, '0') as jid,
  concat('S', cast(event_id % 4 as string)) as tid,
  case event_type when 'signup' then 'ENHANCEMENT' when 'view' then 'SEGMENTATION' when 'click' then 'ANALYSIS'
       when 'purchase' then 'MODEL_PROFILE' else 'AVATAR' end as stp
 from events),
 m as (
 select *,
  concat('{"job_id": "', case when f = 19 then upper(jid) else jid end, '", "task_id": "', case when f = 18 then '' else tid end, '"',
   case when f = 1 then '' else concat(', "user_id": "', case when f = 2 then 'u 1' else uid end, '"') end,
   ', "schema": "', case when f = 3 then 'v2' else 'v1' end,
   '", "step": "', case when f = 4 then 'DETECTOIN' else stp end,
   '", "input_uri": "', case when f = 5 then 's3://other/x/request.json' when f = 6 then 's3://work/a/../b.json' when f = 7 then 's3://work/a/b.exe'
        when f = 15 then '' when f = 16 then concat('r2://work/', uid, '/in.png') else concat('s3://work/', uid, '/', jid, '/request.json') end,
   '", "output_prefix": "s3://work/', uid, '/', case when f = 9 then 'zzz' when f = 19 then upper(jid) else jid end, '/', stp,
        case when f = 14 then '/' when f = 8 then concat('/', tid) else concat('/', tid, '/') end,
   '", "params": ', case when f = 10 then '[1]' else props end,
   ', "retry_count": ', case when f = 11 then '"x"' when f = 21 then '3000000000' when f = 22 then '100000000000000000000' else cast(event_id % 3 as string) end,
   case when f = 12 then ', "trace_id": "zz!"' when f = 20 then ', "trace_id": "ab12-ff"' else '' end,
   case when f = 17 then ', "parent_task_id": "bad id"' when event_id % 4 > 0 then ', "parent_task_id": "S0"' else '' end,
   '}') as payload
 from b)
select concat('m', cast(event_id as string)) as message_id, ts as sent_ts, cast(event_id % 7 + 1 as int) as receive_count,
  case when f = 0 then substr(payload, 1, length(payload) - 1)
       when f = 13 then concat('{"Type": "Notification", "Message": "', replace(payload, '"', concat(chr(92), '"')), '"}')
       else payload end as body
from m
