"""The same queries in plain SQL for DuckDB, as an independent check."""

from __future__ import annotations

# Shop records over the test tables.
STARTUP = """startup_log as (
  select 'mid_' || (user_id % 20)::varchar as mid, user_id::varchar as uid,
         case when user_id % 10 < 3 then 'ios' else 'android' end as os,
         'area_' || (user_id % 10)::varchar as area, (epoch_us(ts) // 1000) as ts, ts as event_ts,
         ts::date as log_date, strftime(ts, '%H') as log_hour, event_id
  from events where event_type = 'signup')"""

EVENT = """event_log as (
  select 'mid_' || (user_id % 20)::varchar as mid, user_id::varchar as uid,
         case when user_id % 10 < 3 then 'ios' else 'android' end as os,
         'area_' || (user_id % 10)::varchar as area, (epoch_us(ts) // 1000) as ts, ts as event_ts,
         ts::date as log_date, strftime(ts, '%H') as log_hour, event_id,
         case event_type when 'purchase' then 'coupon' when 'click' then 'clickItem'
                         when 'view' then 'addCart' else 'addComment' end as evid,
         (event_id % 50)::varchar as itemid
  from events where event_type <> 'signup')"""

ORDER = """order_info as (
  select o_orderkey::varchar as id, c_nationkey::varchar as province_id,
         '138' || lpad(o_custkey::varchar, 8, '0') as consignee_tel, o_orderstatus as order_status,
         o_custkey::varchar as user_id, o_totalprice::decimal(18,2) as total_amount,
         o_orderdate + interval 1 hour * (o_orderkey % 24) as create_ts,
         (o_orderdate + interval 1 hour * (o_orderkey % 24))::date as create_date,
         strftime(o_orderdate + interval 1 hour * (o_orderkey % 24), '%H') as create_hour,
         strftime(o_orderdate + interval 1 hour * (o_orderkey % 24), '%Y-%m-%d %H:%M:%S') as create_time
  from orders join customer on o_custkey = c_custkey)"""

USER = """user_info as (
  select c_custkey::varchar as id, c_name as login_name, c_mktsegment as user_level,
         (date '1960-01-01' + ((c_custkey * 37) % 15000)::int) as birthday,
         case when c_custkey % 2 = 0 then 'F' else 'M' end as gender
  from customer where c_custkey % 10 <> 9)"""

DETAIL = """order_detail as (
  select * exclude (rn) from (
    select l_orderkey::varchar || '-' || l_linenumber::varchar as id, l_orderkey::varchar as order_id,
           l_partkey::varchar as sku_id, p_name as sku_name, l_extendedprice::decimal(18,2) as order_price,
           l_quantity as sku_num,
           row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc) as rn
    from lineitem join part on l_partkey = p_partkey) where rn = 1)"""

SALE = f"""{ORDER}, {DETAIL}, {USER}, sale as (
  select d.id as order_detail_id, o.id as order_id, o.order_status, o.create_time, o.user_id, d.sku_id,
         u.gender as user_gender,
         (date_diff('day', u.birthday, date '2024-01-01') // 365)::double as user_age, u.user_level,
         d.order_price::double as sku_price, d.sku_name, o.create_date as dt
  from order_info o join order_detail d on o.id = d.order_id left join user_info u on u.id = o.user_id),
hits as (
  select * from sale
  where list_contains(regexp_split_to_array(lower(sku_name), '[^\\p{{L}}\\p{{N}}]+'), 'small')
    and list_contains(regexp_split_to_array(lower(sku_name), '[^\\p{{L}}\\p{{N}}]+'), 'ring'))"""

FIRST = f"""{STARTUP}, first_log as (
  select * exclude (rn) from (
    select *, row_number() over (partition by log_date, mid order by ts, event_id) as rn from startup_log)
  where rn = 1)"""


def windows_sql(size: int = 300, slide: int = 10) -> str:
    """Every event placed into each of its windows."""
    per_window = size // slide
    return f"""{EVENT}, placed as (
  select *, (floor(epoch(event_ts) / {slide})::bigint + 1 + k) * {slide} as window_end_s
  from event_log, range(0, {per_window}) r(k)),
kinds as (
  select mid, window_end_s, string_agg(evid || ':' || n::varchar, ',' order by evid) as events
  from (select mid, window_end_s, evid, count(*) as n from placed group by all) group by all),
alert as (
  select * from (
  select mid, window_end_s,
         coalesce(array_to_string(list_sort(list(distinct uid) filter (evid = 'coupon')), ','), '') as uids,
         coalesce(array_to_string(list_sort(list(distinct itemid) filter (evid = 'coupon')), ','), '') as item_ids,
         array_to_string(list_sort(list(evid)), ',') as event_list,
         count(distinct uid) filter (evid = 'coupon') as n_uids
  from placed group by mid, window_end_s having bool_and(evid <> 'clickItem'))
  join kinds using (mid, window_end_s)),
last_alert as (
  select * from alert
  qualify row_number() over (partition by mid, window_end_s // 60 order by window_end_s desc) = 1)"""


ALERT_COLUMNS = "mid, window_end_s, uids, item_ids, events"

GENDER_RATIO = "(count(*) filter (user_gender = '{g}') * 1000 // nullif(count(*), 0)) / 10.0"


def _compare(metric_rows: str) -> str:
    return f"""select lpad(h::varchar, 2, '0') as hour, coalesce(max(v) filter (day = 0), 0) as today,
  coalesce(max(v) filter (day = 1), 0) as yesterday
from range(24) r(h) left join ({metric_rows}) m on m.hour = lpad(h::varchar, 2, '0') group by h"""


DAU_HOURS = """select log_hour as hour, (date '2024-01-15' - log_date)::int as day, count(*) as v
  from first_log where log_date in (date '2024-01-15', date '2024-01-14') group by 1, 2"""

ORDER_HOURS = """select create_hour as hour, (date '1998-06-15' - create_date)::int as day,
  sum(total_amount)::double as v
  from order_info where create_date in (date '1998-06-15', date '1998-06-14') group by 1, 2"""

BUCKET = """case when user_age < 20 then '<20' when user_age < 30 then '20-29'
  when user_age >= 30 then '>=30' else 'unknown' end"""

GENDER = "case when user_gender in ('F', 'M') then user_gender else 'unknown' end"


def _facet(name: str, key: str, buckets: list[str]) -> str:
    values = ", ".join(f"('{b}')" for b in buckets)
    return f"""select '{name}' as facet, b.bucket, count(h.k) as count,
  (count(h.k) * 1000 // nullif((select count(*) from hits), 0)) / 10.0 as ratio
from (values {values}) b(bucket) left join (select {key} as k from hits) h on h.k = b.bucket group by b.bucket"""


def _stream_sale(columns: str) -> str:
    return f"with {SALE} select {columns} from sale"


SALE_COLUMNS = """order_detail_id, order_id, order_status, create_time, user_id, sku_id, user_gender, user_age,
  user_level, sku_price, sku_name, dt"""

CHANGES = f"""with {ORDER}, {DETAIL}, {USER}
select 'new_order' as topic, id, null::varchar as order_id, user_id, total_amount::varchar as total_amount,
  null::varchar as order_price, null::varchar as birthday, null::varchar as gender
from order_info where id::bigint % 2 = 0
union all
select 'new_order_detail', id, order_id, null, null, order_price::varchar, null, null
from order_detail where order_id::bigint % 2 = 0
union all
select 'new_user', id, null, null, null, null, birthday::varchar, gender from user_info where id::bigint % 2 = 0"""

TILES = f"""with {FIRST}, {ORDER}
select 'dau' as id, '新增日活' as name, count(*)::double as value from first_log where log_date = date '2024-01-15'
union all
select 'new_mid', '新增设备', count(*)::double from (
  select mid from startup_log group by mid having min(log_date) = date '2024-01-15')
union all
select 'order_amount', '新增交易额', sum(total_amount)::double from order_info where create_date = date '1998-06-15'"""

_RESTARTED = f"""with {USER} select id, login_name, birthday, gender,
  case when id::bigint % 2 = 0 then 'new' else user_level end as user_level from user_info"""

ORACLE: dict[str, str] = {
    "first_startup": f"with {FIRST} select mid, uid, os, area, ts, log_date, log_hour, event_id from first_log",
    "exclude_seen": f"""with {STARTUP}, seen as (select distinct log_date, mid from startup_log where log_hour < '12')
select mid, uid, os, area, ts, log_date, log_hour, event_id from startup_log s
where not exists (select 1 from seen where seen.log_date = s.log_date and seen.mid = s.mid)""",
    "device_roster": f"with {STARTUP} select distinct log_date, mid from startup_log",
    "dau_total": f"with {FIRST} select log_date, count(*) as dau from first_log group by log_date",
    "dau_by_hour": f"with {FIRST} select log_date, log_hour, count(*) as dau from first_log group by log_date, log_hour",
    "new_devices": f"""with {STARTUP}, f as (select mid, min(log_date) as log_date from startup_log group by mid)
select log_date, count(*) as new_mid from f group by log_date""",
    "observed_startups": f"with {FIRST} select log_date, mid, event_id from first_log",
    "dau_hourly_compare": f"with {FIRST} {_compare(DAU_HOURS)}",
    "dau_hourly_document": f"""with {FIRST}, h as ({DAU_HOURS})
select '{{"today":{{' || coalesce(string_agg('"' || hour || '":' || v::varchar, ',' order by hour) filter (day = 0), '')
  || '}},"yesterday":{{' || coalesce(string_agg('"' || hour || '":' || v::varchar, ',' order by hour) filter (day = 1), '')
  || '}}}}' as document from h""",
    "order_clean": f"""with {ORDER} select id, province_id,
  substr(consignee_tel, 1, 3) || '****' || substr(consignee_tel, 8) as consignee_tel, order_status, user_id,
  total_amount::double as total_amount, create_time, create_date, create_hour from order_info""",
    "order_amount_total": f"""with {ORDER} select create_date, sum(total_amount)::double as amount
from order_info group by create_date""",
    "order_amount_by_hour": f"""with {ORDER} select create_date, create_hour, sum(total_amount)::double as amount
from order_info group by create_date, create_hour""",
    "order_amount_on_day": f"""with {ORDER} select date '1998-06-15' as create_date, sum(total_amount)::double as amount
from order_info where create_date = date '1998-06-15'""",
    "order_hourly_compare": f"with {ORDER} {_compare(ORDER_HOURS)}",
    "order_hour_map": f"""with {ORDER}, h as (
  select create_hour, (sum(total_amount) * 100)::bigint as amount from order_info group by create_hour)
select '{{' || string_agg('"' || create_hour || '":' || amount::varchar, ',' order by create_hour) || '}}' as by_hour
from h""",
    "sales_by_province": f"""with {ORDER}, p as (
  select province_id, count(*) as n_orders, sum(total_amount)::double as amount from order_info group by province_id)
select province_id, n_orders, amount, least(7, n_orders // 100 + 1)::int as band from p""",
    "kpi_tiles": TILES,
    "kpi_document": f"""select 'dau,new_mid,order_amount' as ids, max(value) filter (id = 'dau') as dau,
  max(value) filter (id = 'new_mid') as new_mid, max(value) filter (id = 'order_amount') as order_amount
from ({TILES})""",
    "sale_detail": f"""with {ORDER}, {DETAIL}
select d.id as order_detail_id, o.id as order_id, o.order_status, o.create_time, o.user_id, d.sku_id,
  d.order_price::double as sku_price, d.sku_name, o.create_date as dt
from order_info o join order_detail d on o.id = d.order_id""",
    "sale_detail_enriched": f"with {SALE} select {SALE_COLUMNS} from sale",
    "user_ages": f"""with {USER}, a as (
  select id, (date_diff('day', birthday, date '2024-01-01') // 365)::int as user_age from user_info)
select id, user_age as age, {BUCKET} as age_group from a""",
    "latest_users": """select o_custkey::varchar as id, o_orderpriority as user_level, o_orderkey as change_id
from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
    "sale_keyword_hits": f"with {SALE} select order_detail_id, sku_name, dt from hits",
    "sale_search_total": f"with {SALE} select count(*) as total from hits",
    "sale_search_page": f"with {SALE} select {SALE_COLUMNS} from hits order by order_detail_id limit 10 offset 10",
    "sale_gender_facet": f"with {SALE} {_facet('gender', GENDER, ['F', 'M', 'unknown'])}",
    "sale_age_facet": f"with {SALE} {_facet('age', BUCKET, ['<20', '20-29', '>=30', 'unknown'])}",
    "sale_gender_terms": f"""with {SALE} select user_gender, count(*) as n from sale where user_gender is not null
group by user_gender order by n desc, user_gender""",
    "sale_age_terms": f"""with {SALE} select user_age::int as user_age, count(*) as n from sale where user_age is not null
group by user_age order by n desc, user_age""",
    "sale_search_document": f"""with {SALE}, day_hits as (select * from sale where dt = date '1998-06-15'),
page as (select order_detail_id from day_hits order by order_detail_id limit 10)
select count(*) as total,
  (count(*) filter (user_age < 20) * 1000 // nullif(count(*), 0)) / 10.0 as under_20,
  (count(*) filter (user_age >= 20 and user_age < 30) * 1000 // nullif(count(*), 0)) / 10.0 as from_20_to_29,
  (count(*) filter (user_age >= 30) * 1000 // nullif(count(*), 0)) / 10.0 as over_29,
  (count(*) filter (user_age is null) * 1000 // nullif(count(*), 0)) / 10.0 as age_unknown,
  (count(*) filter (user_gender is null) * 1000 // nullif(count(*), 0)) / 10.0 as gender_unknown,
  {GENDER_RATIO.format(g="M")} as male, {GENDER_RATIO.format(g="F")} as female,
  (select coalesce(string_agg(order_detail_id, ',' order by order_detail_id), '') from page) as detail_ids
from day_hits""",
    "coupon_panes": f"""with {EVENT} select mid, floor(epoch(event_ts) / 10)::bigint as pane, evid,
  case when evid = 'coupon' then uid end as uid, case when evid = 'coupon' then itemid end as itemid, count(*) as n
from event_log group by all""",
    "coupon_alerts": f"with {windows_sql()} select {ALERT_COLUMNS} from alert",
    "coupon_alerts_per_minute": f"""with {windows_sql()}
select mid || '_' || (window_end_s // 60)::varchar as alert_id, {ALERT_COLUMNS} from last_alert""",
    "coupon_alerts_three_users": f"with {windows_sql(7200, 600)} select {ALERT_COLUMNS} from alert where n_uids >= 3",
    "alert_documents": f"""with {windows_sql()}
select mid || '_' || (window_end_s // 60)::varchar as alert_id, mid, uids, item_ids, event_list as events,
  window_end_s * 1000 as ts from last_alert""",
    "stamp_ingest": """select event_id, case when event_type = 'signup' then 'startup' else 'event' end as type,
  'mid_' || (user_id % 20)::varchar as mid, user_id::varchar as uid,
  case when user_id % 10 < 3 then 'ios' else 'android' end as os, 'area_' || (user_id % 10)::varchar as area,
  case event_type when 'purchase' then 'coupon' when 'click' then 'clickItem' when 'view' then 'addCart'
                  when 'signup' then null else 'addComment' end as evid,
  case when event_type <> 'signup' then (event_id % 50)::double end as itemid,
  (epoch_us(ts) // 1000) as ts from events""",
    "route_logs": """select case when event_type = 'signup' then 'startup_log' else 'event_log' end as topic, event_id
from events""",
    "route_cdc": CHANGES,
    "parse_startup_json": f"""with {STARTUP} select 'startup' as log_type, mid, uid, os, area, ts, log_date, log_hour
from startup_log""",
    "parse_event_json": f"with {EVENT} select mid, uid, evid, itemid, ts, log_date, log_hour from event_log",
    "parse_order_json": f"""with {ORDER} select id, province_id,
  substr(consignee_tel, 1, 3) || '****' || substr(consignee_tel, 8) as consignee_tel, order_status, user_id,
  total_amount::double as total_amount, create_time, create_date, create_hour from order_info""",
    "parse_order_detail_json": f"""with {DETAIL} select id, order_id, sku_id, sku_name,
  order_price::varchar as order_price from order_detail""",
    "parse_user_json": f"with {USER} select id, login_name, user_level, birthday, gender from user_info",
    "parse_rejects": f"""with {STARTUP}
select '{{"mid":"' || mid || '","event_id":"' || event_id::varchar || '","ts":"' || ts::varchar || '"' as value,
  'not a JSON record' as reject_reason from startup_log where event_id % 3 = 0
union all
select '{{"event_id":"' || event_id::varchar || '","ts":"' || ts::varchar || '"}}', 'missing or invalid mid'
from startup_log where event_id % 3 = 1
union all
select '{{"mid":"' || mid || '","event_id":"' || event_id::varchar || '","ts":"' || ts::varchar || '"}}{{"mid":"more"}}',
  'not a JSON record' from startup_log where event_id % 9 = 2
union all
select '{{"ts":"1","mid":"' || mid || '","event_id":"' || event_id::varchar || '","ts":"' || ts::varchar || '"}}',
  'not a JSON record' from startup_log where event_id % 9 = 5""",
    # Streaming jobs replayed to the end must give what the batch form gives.
    "stream_first_startup": f"with {FIRST} select mid, uid, os, area, ts, log_date, log_hour from first_log",
    "stream_first_seen": f"with {STARTUP} select distinct log_date, mid from startup_log",
    "stream_log_archive": """select ts::date as dt, event_id,
  case when event_type = 'signup' then 'startup' else 'event' end as type, 'mid_' || (user_id % 20)::varchar as mid,
  (epoch_us(ts) // 1000) as ts from events""",
    "stream_topics": """select case when event_type = 'signup' then 'startup_log' else 'event_log' end as topic,
  event_id, (epoch_us(ts) // 1000) as ts from events""",
    "stream_orders": f"""with {ORDER} select id, province_id,
  substr(consignee_tel, 1, 3) || '****' || substr(consignee_tel, 8) as consignee_tel, order_status, user_id,
  total_amount::double as total_amount, create_time, create_date, create_hour from order_info""",
    "stream_coupon_alerts": f"with {windows_sql()} select {ALERT_COLUMNS} from alert",
    "stream_sale_detail": _stream_sale(SALE_COLUMNS),
    "stream_changes": CHANGES,
    "stream_alerts_per_minute": f"""with {windows_sql()}
select mid || '_' || (window_end_s // 60)::varchar as alert_id, {ALERT_COLUMNS} from last_alert""",
    "stream_order_changes": f"""with {ORDER} select id, case when id::bigint % 2 = 0 then '1' else '5' end as order_status,
  create_date, create_hour from order_info""",
    "upsert_restart": _RESTARTED,
    "upsert_restart_uncompacted": _RESTARTED,
    "upsert_users": f"""with {USER} select id, login_name, birthday, gender,
  case when id::bigint % 6 = 1 then '2' when id::bigint % 2 = 1 then '1' else user_level end as user_level
from user_info""",
    "sale_late_lines": f"""with {SALE} select {SALE_COLUMNS}, false as waiting from sale where order_id::bigint % 7 <> 0
union all by name
select id as order_detail_id, order_id, sku_id, sku_name, order_price::double as sku_price, true as waiting
from order_detail where order_id::bigint % 7 = 0 or order_id not in (select id from order_info)""",
    "apply_changes": f"""with {USER} select id, login_name, gender,
  case when id::bigint % 10 = 0 then 'again' when id::bigint % 3 = 0 then 'changed' else user_level end as user_level
from user_info where id::bigint % 10 = 0 or (id::bigint % 5 <> 0 and id::bigint % 7 <> 0)""",
    "dau_hourly_from_rollup": f"with {FIRST} {_compare(DAU_HOURS)}",
    "new_devices_from_table": f"""with {STARTUP}, f as (select mid, min(log_date) as log_date from startup_log group by mid)
select log_date, count(*) as new_mid from f group by log_date""",
    "order_hourly_from_rollup": f"with {ORDER} {_compare(ORDER_HOURS)}",
}
