with c as (select l_orderkey as k, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity,
   row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount, l_returnflag, l_linestatus) - 1 as idx
  from lineitem)
select lpad(lower(hex(k)), 8, '0') as job_id, concat('u', cast(k % 97 as string)) as user_id, 'v1' as schema,
  case cast(k % 5 as int) when 0 then 'ENHANCEMENT' when 1 then 'SEGMENTATION' when 2 then 'MODEL_PROFILE'
       when 3 then 'SCRIPT_GENERATION' else 'ANALYSIS' end as step,
  concat('S', cast(k % 4 as string)) as task_id, cast(idx as int) as child_pos,
  case when l_suppkey % 5 = 0 then cast(l_linenumber as int) end as explicit_idx,
  concat('{"part": ', cast(l_partkey as string), '}') as child_params
from c
