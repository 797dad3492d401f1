select doc_id as call_id, case when doc_id % 2 = 0 then 'text' else 'image' end as kind,
  concat('Describe item ', cast(doc_id as string), ' in ', lang, ':', chr(10), coalesce(text, '')) as prompt,
  case cast(doc_id % 4 as int) when 0 then '1:1' when 1 then '16:9' when 2 then '3:4' else case when doc_id % 3 = 0 then '2:1' else '21:9' end end as aspect_ratio,
  cast(doc_id % 10 as double) / 10 as temperature
from documents
