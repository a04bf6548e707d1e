"""DuckDB SQL for every registered query (the independent oracle).

The oracle is written the plain-SQL way (self-joins instead of range
windows, explicit spines), so it checks the Spark plans rather than
repeating them.  Shared CTEs build the adapter rows and the engineered
table; each query appends its own CTEs and final SELECT.
"""

from __future__ import annotations

from ripple import constants as K
from ripple.sources.adapter import adapter_sql


def _q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STRING_COLS = ("corridor", "priority", "requires_road_closure", "zone", "police_station",
               "event_cause", "veh_type", "status")

_SENTINEL = ",\n    ".join(
    f"case when {c} in ({_q(K.NULL_TOKENS)}) then null else {c} end as {c}" for c in STRING_COLS)

_VEH = "lower(trim(r0.veh_type))"
_CATS = " ".join(f"when veh_type in ({_q(m)}) then '{n}'" for n, m in K.VEHICLE_CATEGORIES)

INC_CTE = f"""
inc as ({adapter_sql()})"""

ENGINEERED_CTES = INC_CTE + f""",
s0 as (
  select id, start_datetime, closed_datetime,
    {_SENTINEL},
    latitude, longitude
  from inc),
r0 as (
  select *, start_datetime + interval 330 minute as start_local,
    cast(date_diff('microsecond', start_datetime, closed_datetime) as double) / 60000000.0 as resolution_minutes
  from s0),
cap as (select quantile_cont(resolution_minutes, 0.99) as p99 from r0 where resolution_minutes is not null),
modal as (
  select police_station, zone as modal_zone from (
    select police_station, zone,
      row_number() over (partition by police_station order by count(*) desc, zone) as rn
    from r0 where zone is not null and police_station is not null
    group by police_station, zone) m where rn = 1),
c0 as (
  select r0.id, r0.start_datetime, r0.closed_datetime, r0.start_local,
    coalesce(r0.corridor, 'Non-corridor') as corridor,
    coalesce(r0.zone, modal.modal_zone, 'Unknown') as zone,
    r0.police_station,
    coalesce(r0.priority, 'Low') as priority,
    coalesce(upper(trim(r0.requires_road_closure)) = 'TRUE', false) as requires_road_closure,
    lower(trim(coalesce(r0.event_cause, 'others'))) as event_cause,
    case when {_VEH} is null or {_VEH} in ({_q(K.VEHICLE_UNKNOWN_TOKENS)}) then 'unknown' else {_VEH} end as veh_type,
    r0.status, r0.latitude, r0.longitude, r0.resolution_minutes,
    case when r0.resolution_minutes is null then null
         else greatest(least(r0.resolution_minutes, cap.p99), 0.0) end as resolution_minutes_capped,
    cast(r0.resolution_minutes is null as bigint) as is_open
  from r0 left join modal on r0.police_station = modal.police_station cross join cap),
c1 as (
  select *,
    case when event_cause in ({_q(K.CIVIC_CAUSES)}) then '{K.CIVIC_GROUP}' else event_cause end as event_cause_grouped,
    cast(veh_type in ({_q(K.HEAVY_TYPES)}) as bigint) as is_heavy_vehicle,
    case {_CATS} else 'unknown' end as veh_category,
    hour(start_local) as hour_of_day,
    isodow(start_local) - 1 as day_of_week,
    dayname(start_local) as day_name,
    month(start_local) as month,
    monthname(start_local) as month_name,
    cast(start_local as date) as date,
    cast(coalesce(isodow(start_local) - 1 in (5, 6), false) as bigint) as is_weekend,
    cast(coalesce(hour(start_local) between 19 and 22 or hour(start_local) between 4 and 6, false) as bigint)
      as is_peak_hour,
    hour(start_local) + cast(minute(start_local) as double) / 60.0 as hour_fraction,
    strftime(start_local, '%Y-%m-%d') as date_str,
    strftime(start_local, '%H:%M') || ' IST' as time_label,
    strftime(start_local, '%H:%M:%S') as clock,
    case when priority = 'High' and requires_road_closure then 'high'
         when priority = 'High' or requires_road_closure then 'medium' else 'low' end as congestion_severity
  from c0 where event_cause <> '{K.NOISE_CAUSE}'),
high as (select corridor, count(*) as high_count from c1 where priority = 'High' group by corridor),
hs as (select min(high_count) as lo, max(high_count) as hi from high),
risk as (
  select corridor, high_count,
    coalesce(cast(high_count - lo as double) / nullif(cast(hi - lo as double), 0), 0.0) as corridor_risk_score
  from high cross join hs),
eng as (
  select c1.*, coalesce(risk.corridor_risk_score, 0.0) as corridor_risk_score
  from c1 left join risk on c1.corridor = risk.corridor)
"""

NAMED = f"corridor not in ({_q(K.NOT_NAMED_CORRIDORS)})"


def _follow_cte(name: str, minutes: int, min_followers: int, src: str = "eng") -> str:
    return f"""
{name}_pairs as (
  select a.id, count(*) as n from {src} a join {src} b
    on a.corridor = b.corridor and b.start_datetime > a.start_datetime
   and b.start_datetime <= a.start_datetime + interval {minutes} minute
  where a.{NAMED} group by a.id),
{name} as (
  select e.*, cast(coalesce(p.n, 0) as bigint) as secondary_count,
    coalesce(p.n, 0) >= {min_followers} as is_cascade_seed
  from {src} e left join {name}_pairs p on e.id = p.id)"""


LABELLED_CTES = ENGINEERED_CTES + "," + _follow_cte("fol", K.FOLLOW_MINUTES, K.MIN_FOLLOWERS) + f""",
lbp as (
  select a.id,
    count(*) filter (where b.start_datetime >= a.start_datetime - interval 2 hour) as e2,
    count(*) as e6,
    max(case when b.start_datetime >= a.start_datetime - interval 3 hour
              and b.event_cause_grouped in ({_q(K.SEED_CAUSES)}) then 1 else 0 end) as s3
  from eng a join eng b on a.corridor = b.corridor
   and b.start_datetime >= a.start_datetime - interval 6 hour
   and (b.start_datetime < a.start_datetime or (b.start_datetime = a.start_datetime and b.id < a.id))
  group by a.id),
ctot as (select corridor, count(*) as corridor_total from eng group by corridor),
lab as (
  select f.*,
    cast(coalesce(l.e2, 0) as bigint) as corridor_events_2h,
    cast(coalesce(l.e6, 0) as bigint) as corridor_events_6h,
    cast(coalesce(l.s3, 0) as bigint) as seed_event_present_3h,
    cast(coalesce(l.e2, 0) as double) / cast(t.corridor_total as double) as cascade_density
  from fol f left join lbp l on f.id = l.id join ctot t on f.corridor = t.corridor)"""

# stand-in score (mirrors ripple.operators.decisions.standin_score)
SCORED_CTES = LABELLED_CTES + """,
sc as (
  select *, least(5 * corridor_events_2h + 25 * seed_event_present_3h + 5 * is_peak_hour
                  + 10 * cast(requires_road_closure as bigint)
                  + cast(floor(corridor_risk_score * 30) as bigint), 100) as risk_pct
  from lab),
scored as (
  select *, cast(risk_pct as double) / 100.0 as cascade_probability,
    corridor_events_2h as predicted_secondary_count
  from sc)"""


def with_ctes(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"
