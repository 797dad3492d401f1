select concat('m', cast(event_id as string)) as message_id, event_type as queue, cast(event_id % 7 + 1 as int) as receive_count,
  cast(event_id % 13 as int) - 10 as delay_left_sec, cast(event_id % 11 as int) - 8 as invisible_left_sec, ts as sent_ts
from events
