select event_id as seq, ts, case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' when 'view' then 'DEBUG' else 'INFO' end as level,
  case cast(event_id % 3 as int) when 0 then 'runner' when 1 then 'io_store' else 'model_call' end as logger,
  event_type as msg, lpad(lower(hex(cast(floor(event_id / 40) as bigint))), 8, '0') as job_id, value as latency_ms
from events
