"""Registered report queries (step 3: A1-A20, K8-K13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripple import constants as K
from ripple.operators import clean, reports
from ripple.plans import flows
from ripple.plans import oracle as O
from ripple.plans.catalog import query

E, L, W, NAMED = O.ENGINEERED_CTES, O.LABELLED_CTES, O.with_ctes, O.NAMED


def WX(base: str, extra: str, body: str) -> str:
    """``with <base>, <extra CTEs> <body>``."""
    return f"with {base},\n{extra}\n{body}"

# The test tables span January 2024, so the time split is placed inside it.
DATA_CUTOFF = "2024-01-22"


def _vc(name, col, n=None, where="", src="eng"):
    lim = f" limit {n}" if n else ""
    cond = f"where {col} is not null" + (f" and {where}" if where else "")
    return W(E, f"""select {col}, count(*) as n from {src} {cond}
group by {col} order by n desc, {col} asc nulls first{lim}""")


@query("value_counts_cause", _vc("c", "event_cause", 15))
def q_vc_cause(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "event_cause", 15)


@query("value_counts_priority", _vc("p", "priority"))
def q_vc_priority(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "priority")


@query("value_counts_closure", _vc("r", "requires_road_closure"))
def q_vc_closure(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "requires_road_closure")


@query("value_counts_status", _vc("s", "status"))
def q_vc_status(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "status")


@query("value_counts_corridor", _vc("k", "corridor", 15))
def q_vc_corridor(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "corridor", 15)


@query("value_counts_vehicle", _vc("v", "veh_type", 10, "veh_type <> 'unknown'"))
def q_vc_vehicle(spark, sf):
    eng = flows.light(spark, sf)
    return reports.value_counts(eng.where(F.col("veh_type") != "unknown"), "veh_type", 10)


@query("value_counts_raw_cause", W(O.INC_CTE, """select event_cause, count(*) as n from inc
group by event_cause order by n desc, event_cause asc nulls first limit 15"""))
def q_vc_raw_cause(spark, sf):
    return reports.value_counts(flows.raw(spark, sf), "event_cause", 15, dropna=False)


@query("cause_share", WX(E, "tot as (select count(*) as total from eng)", """
select event_cause_grouped, count(*) as n,
  cast(count(*) as double) * 100.0 / cast(max(tot.total) as double) as pct
from eng cross join tot group by event_cause_grouped"""))
def q_cause_share(spark, sf):
    return reports.value_counts(flows.light(spark, sf), "event_cause_grouped", pct=True)


RES_DD = """dd as (
  select event_cause,
    cast(date_diff('second', date_trunc('second', start_datetime), date_trunc('second', closed_datetime))
         as double) / 60.0 as d
  from inc),
dv as (select * from dd where d > 0 and d < 20000),
med as (
  select event_cause, d as upper_median_minutes from (
    select event_cause, d, row_number() over (partition by event_cause order by d) as rn,
      count(*) over (partition by event_cause) as cnt from dv) x
  where rn = cnt // 2 + 1)"""


@query("resolution_by_cause", W(O.INC_CTE + ",\n" + RES_DD, """
select a.event_cause, a.avg_minutes, m.upper_median_minutes, a.n from
  (select event_cause, avg(d) as avg_minutes, count(*) as n from dv group by event_cause) a
  join med m on a.event_cause is not distinct from m.event_cause"""))
def q_resolution_by_cause(spark, sf):
    return reports.resolution_by_cause(flows.raw(spark, sf))


@query("hour_dense", W(E, """select h.range as hour_of_day, cast(coalesce(c.n, 0) as bigint) as n
from range(24) h left join (
  select hour_of_day, count(*) as n from eng where hour_of_day is not null group by 1) c
  on h.range = c.hour_of_day"""))
def q_hour_dense(spark, sf):
    return reports.by_hour(flows.light(spark, sf), dense=True)


@query("dow_counts", W(E, """select day_name, count(*) as n from eng
where day_name is not null group by day_name"""))
def q_dow_counts(spark, sf):
    return reports.by_day(flows.light(spark, sf))


@query("high_pct", W(E, f"""select corridor, count(*) filter (where priority = 'High') as high,
  count(*) as total,
  cast(count(*) filter (where priority = 'High') as double) * 100.0 / count(*) as high_pct
from eng where {NAMED} group by corridor order by high desc, corridor limit 10"""))
def q_high_pct(spark, sf):
    return reports.high_share(flows.light(spark, sf), 10)


@query("hot_corridor_days", WX(E, f"""bc as (
  select corridor, date, event_cause, count(*) as k from eng
  where {NAMED} and date is not null group by 1, 2, 3),
r as (
  select *, sum(k) over (partition by corridor, date) as n_events,
    row_number() over (partition by corridor, date order by k desc, event_cause) as rn
  from bc)""", """select corridor, date, cast(n_events as bigint) as n_events,
  string_agg(event_cause || ':' || cast(k as varchar), ', ' order by rn) as top_causes
from r where n_events >= 5 and rn <= 3
group by corridor, date, n_events order by n_events desc, corridor, date limit 10"""))
def q_hot_corridor_days(spark, sf):
    return reports.hot_corridor_days(flows.light(spark, sf))


@query("closure_share", W(E, """select count(*) filter (where requires_road_closure) as closures,
  count(*) as total,
  cast(count(*) filter (where requires_road_closure) as double) * 100.0 / count(*) as closure_pct
from eng"""))
def q_closure_share(spark, sf):
    return reports.closure_share(flows.light(spark, sf))


@query("closures_by_cause", W(E, """select event_cause, count(*) as closures from eng
where requires_road_closure group by event_cause"""))
def q_closures_by_cause(spark, sf):
    return reports.closures_by_cause(flows.light(spark, sf))


@query("summary_stats", W(E, """select count(*) as n_rows, avg(resolution_minutes) as mean_resolution,
  quantile_cont(resolution_minutes, 0.5) as median_resolution,
  quantile_cont(resolution_minutes, 0.99) as p99_resolution,
  count(resolution_minutes) as n_valid, cast(sum(is_open) as bigint) as n_open,
  cast(sum(is_peak_hour) as bigint) as n_peak, avg(is_peak_hour) as peak_rate,
  cast(sum(is_weekend) as bigint) as n_weekend, avg(is_weekend) as weekend_rate,
  cast(sum(is_heavy_vehicle) as bigint) as n_heavy, avg(is_heavy_vehicle) as heavy_rate
from eng"""))
def q_summary(spark, sf):
    return reports.summary(flows.light(spark, sf))


@query("top_corridors", W(E, f"""select corridor, count(*) as n, max(corridor_risk_score) as corridor_risk_score
from eng where {NAMED} group by corridor order by n desc, corridor limit 10"""))
def q_top_corridors(spark, sf):
    return reports.top_corridors(flows.light(spark, sf, "corridor_risk_score"), 10)


def _heat_sql(where=""):
    cols = ",\n  ".join(
        f"cast(count(e.id) filter (where e.hour_of_day = {h}) as bigint) as h{h:02d}" for h in range(24))
    days = "[" + ", ".join(f"'{d}'" for d in K.DAY_NAMES) + "]"
    cond = f" and e.{where}" if where else ""
    return W(E, f"""select d.range as day_of_week, {days}[d.range + 1] as day_name,
  {cols}
from range(7) d left join eng e on e.day_of_week = d.range{cond}
group by d.range""")


@query("heatmap", _heat_sql())
def q_heatmap(spark, sf):
    return reports.heatmap(flows.light(spark, sf))


@query("heatmap_high", _heat_sql("congestion_severity = 'high'"))
def q_heatmap_high(spark, sf):
    return reports.heatmap(flows.light(spark, sf), severity="high")


@query("resolution_quantiles", W(E, """select event_cause_grouped, count(*) as n,
  quantile_cont(resolution_minutes_capped, 0.0) as q_min,
  quantile_cont(resolution_minutes_capped, 0.25) as q1,
  quantile_cont(resolution_minutes_capped, 0.5) as median,
  quantile_cont(resolution_minutes_capped, 0.75) as q3,
  quantile_cont(resolution_minutes_capped, 1.0) as q_max
from eng where resolution_minutes_capped is not null and event_cause_grouped <> 'others'
group by event_cause_grouped"""))
def q_resolution_quantiles(spark, sf):
    return reports.resolution_quantiles(flows.light(spark, sf, "resolution_minutes_capped"))


# the dashboard labels seeds with its own rule: 130 min window, >= 4 followers
DASH = O.ENGINEERED_CTES + "," + O._follow_cte("dash", K.DASHBOARD_FOLLOW_MINUTES, K.DASHBOARD_MIN_FOLLOWERS)
KPI_SQL = """select count(*) as events, count(*) filter (where is_cascade_seed) as seeds,
  count(distinct case when is_cascade_seed then corridor end) as corridors_at_risk,
  avg(case when resolution_minutes > 0 and resolution_minutes <= 43200 then resolution_minutes end)
    as avg_resolution
from dash"""


@query("period_kpis", W(DASH, KPI_SQL))
def q_period_kpis(spark, sf):
    return reports.period_kpis(flows.dashboard_labelled(spark, sf))


FILTER_ARGS = ("2024-01-08", "2024-01-21", ["Corridor 01", "Corridor 02", "Corridor 07"],
               ["accident", "water_logging", "civic_event", "vehicle_breakdown"])


@query("period_kpis_filtered", W(DASH, KPI_SQL + """
where date between date '2024-01-08' and date '2024-01-21'
  and corridor in ('Corridor 01', 'Corridor 02', 'Corridor 07')
  and event_cause_grouped in ('accident', 'water_logging', 'civic_event', 'vehicle_breakdown')"""))
def q_period_kpis_filtered(spark, sf):
    return reports.period_kpis(clean.filter_incidents(flows.dashboard_labelled(spark, sf), *FILTER_ARGS))


@query("bounds", W(E, f"""select min(date) as min_date, max(date) as max_date,
  count(distinct case when {NAMED} then corridor end) as n_corridors,
  count(distinct event_cause_grouped) as n_causes from eng"""))
def q_bounds(spark, sf):
    return reports.bounds(flows.light(spark, sf))


@query("distinct_corridors", W(E, f"select distinct corridor from eng where {NAMED} order by corridor"))
def q_distinct_corridors(spark, sf):
    return reports.distinct_values(flows.light(spark, sf), "corridor", named_only=True)


def _mode_sql(col):
    return f"""(select corridor, {col} as v from (
    select corridor, {col}, row_number() over (partition by corridor order by count(*) desc, {col}) as rn
    from eng where {NAMED} and {col} is not null group by corridor, {col}) x where rn = 1)"""


@query("corridor_profile", W(E, f"""select a.corridor, z.v as typical_zone, s.v as typical_station,
  a.typical_risk from
  (select corridor, max(corridor_risk_score) as typical_risk from eng where {NAMED} group by corridor) a
  left join {_mode_sql('zone')} z on a.corridor = z.corridor
  left join {_mode_sql('police_station')} s on a.corridor = s.corridor"""))
def q_corridor_profile(spark, sf):
    return reports.corridor_profile(flows.light(spark, sf, "zone", "corridor_risk_score"))


def _slot_cte(k):
    return f"""s{k} as (
  select corridor, day_of_week, hour, cast(ceil(avg(c)) as bigint) as events_{k}h from (
    select corridor, day_of_week, hour, date, count(*) as c from (
      select corridor, day_of_week, date,
        unnest(generate_series(hour_of_day, least(hour_of_day + {k}, 23))) as hour
      from eng where {NAMED} and hour_of_day is not null) x
    group by 1, 2, 3, 4) y
  group by 1, 2, 3)"""


@query("slot_intensity", W(E + ",\n" + _slot_cte(2) + ",\n" + _slot_cte(6), """
select s6.corridor, s6.day_of_week, s6.hour, coalesce(s2.events_2h, 0) as events_2h, s6.events_6h
from s6 left join s2 on s6.corridor = s2.corridor and s6.day_of_week = s2.day_of_week
 and s6.hour = s2.hour"""))
def q_slot_intensity(spark, sf):
    return reports.slot_intensity(flows.light(spark, sf))


@query("seeds_by_cause", W(L, """select event_cause_grouped, count(*) as seeds from lab
where is_cascade_seed group by event_cause_grouped"""))
def q_seeds_by_cause(spark, sf):
    return reports.seeds_by_cause(flows.labelled(spark, sf, ()))


@query("seeds_by_corridor_full", W(L, f"""select corridor, count(*) filter (where is_cascade_seed) as seed_count,
  cast(coalesce(sum(case when is_cascade_seed then secondary_count end), 0) as bigint)
    as total_secondary_events
from lab where {NAMED} group by corridor"""))
def q_seeds_by_corridor_full(spark, sf):
    return reports.seeds_by_corridor(flows.labelled(spark, sf, ()))


@query("cascade_kpis", WX(L, """w as (
  select corridor, date, event_cause_grouped from lab where is_cascade_seed
  order by secondary_count desc, id limit 1)""", """
select count(*) as seeds, cast(coalesce(sum(secondary_count), 0) as bigint) as secondary_events,
  max(secondary_count) as worst_cascade,
  (select corridor from w) as worst_corridor, (select date from w) as worst_date,
  (select event_cause_grouped from w) as worst_cause,
  avg(secondary_count) as mean_per_seed, count(distinct corridor) as affected_corridors
from lab where is_cascade_seed"""))
def q_cascade_kpis(spark, sf):
    return reports.cascade_kpis(flows.labelled(spark, sf, ()))


@query("split_summary", W(L, f"""select case when start_local is null
    or start_local < timestamp '{DATA_CUTOFF}' then 'train' else 'test' end as split,
  count(*) as n, count(*) filter (where is_cascade_seed) as seeds,
  avg(cast(is_cascade_seed as double)) as seed_rate
from lab group by 1"""))
def q_split_summary(spark, sf):
    return reports.split_summary(flows.labelled(spark, sf, ()), DATA_CUTOFF)


@query("replay_slice", W(E, """select corridor, date, id, start_local, clock, event_cause_grouped,
  priority, requires_road_closure,
  row_number() over (partition by corridor, date order by start_local, id) as seq
from eng where start_local is not null and hour_of_day <= 24"""))
def q_replay_slice(spark, sf):
    return reports.replay_slice(flows.engineered(spark, sf))
