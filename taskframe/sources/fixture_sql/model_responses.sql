with d as (select doc_id, n_chars, lang, coalesce(text, '') as said, cast(doc_id % 8 as int) as f, chr(92) as bs, chr(10) as nl from documents),
 e as (select *, replace(replace(replace(replace(replace(said, bs, concat(bs, bs)), '"', concat(bs, '"')), nl, concat(bs, 'n')), chr(13), concat(bs, 'r')), chr(9), concat(bs, 't')) as esc from d),
 t as (select *, case
   when f in (0, 6) then concat('```json', nl, '{"doc": ', cast(doc_id as string), ', "lang": "', lang, '", "text": "', esc, '"}', nl, '```')
   when f = 1 then concat('Here: {"doc": ', cast(doc_id as string), ', "text": "', esc, '"} done')
   when f = 2 then concat('{', nl, '  doc: ', cast(doc_id as string), ',', nl, '  text: "', esc, '"', nl, '}')
   when f = 3 then concat('no structured answer: ', said) else '' end as txt from e),
 b as (select *, replace(replace(replace(replace(replace(txt, bs, concat(bs, bs)), '"', concat(bs, '"')), nl, concat(bs, 'n')), chr(13), concat(bs, 'r')), chr(9), concat(bs, 't')) as wire from t)
select doc_id as call_id, 'text' as kind, cast(n_chars as bigint) as prompt_chars, case when f = 7 then 503 else 200 end as status_code,
  cast(n_chars % 1000 as double) / 100 as elapsed_sec,
  case when f = 7 then 'unavailable'
       when f = 4 then '{"promptFeedback": {"blockReason": "SAFETY"}}'
       when f = 5 then '{"candidates": [{"content": {"parts": [{"inlineData": {"mimeType": "image/png", "data": "QUJD"}}]}, "finishReason": "STOP"}]}'
       when f = 6 then concat('{"candidates": [{"content": {"parts": [{"text": "', wire, '"}, {"text": " tail "}]}, "finish_reason": "MAX_TOKENS"}]}')
       else concat('{"candidates": [{"content": {"parts": [{"text": "', wire, '"}]}, "finishReason": "STOP"}]}') end as body
from b
