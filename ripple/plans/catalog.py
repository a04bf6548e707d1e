"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every query reads the driver tables (through the incident adapter) and
runs over whole tables.  Column names and types match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripple.operators import cascade, clean, features, reports, timeseries
from ripple.plans import flows
from ripple.plans import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


E = O.ENGINEERED_CTES
L = O.LABELLED_CTES
S = O.SCORED_CTES
W = O.with_ctes
NAMED = O.NAMED


# --------------------------------------------------------------------------
# Step 0: minimum slice — label seeds and count them per corridor (entry)
# --------------------------------------------------------------------------
@query("seeds_by_corridor", W(O.INC_CTE + """,
lin as (
  select id, start_datetime,
    coalesce(case when corridor in ('NULL', 'nan') then null else corridor end, 'Non-corridor') as corridor,
    lower(trim(coalesce(case when event_cause in ('NULL', 'nan') then null else event_cause end, 'others')))
      as event_cause
  from inc),
lclean as (select * from lin where event_cause <> 'test_demo'),""" + O._follow_cte("lf", 120, 3, "lclean"), f"""
select corridor, cast(count(*) filter (where is_cascade_seed) as bigint) as seed_count,
  cast(coalesce(sum(case when is_cascade_seed then secondary_count end), 0) as bigint) as total_secondary_events
from lf where {NAMED} group by corridor"""))
def q_seeds_by_corridor(spark, sf):
    # the report only covers named corridors, so only they are labelled
    return reports.seeds_by_corridor(cascade.follow_count(flows.label_input(spark, sf)))


# --------------------------------------------------------------------------
# Step 1: cleaning and scalar features
# --------------------------------------------------------------------------
@query("clean_incidents", W(E, "select * from eng"))
def q_clean_incidents(spark, sf):
    return flows.engineered(spark, sf)


@query("temporal_features", W(E, """select id, start_local, hour_of_day, day_of_week, day_name, month,
  month_name, date, is_weekend, is_peak_hour, hour_fraction, date_str, time_label, clock from eng"""))
def q_temporal_features(spark, sf):
    return flows.light(spark, sf).select(
        "id", "start_local", "hour_of_day", "day_of_week", "day_name", "month", "month_name", "date",
        "is_weekend", "is_peak_hour", "hour_fraction", "date_str", "time_label", "clock")


@query("vehicle_features", W(E, "select id, veh_type, is_heavy_vehicle, veh_category from eng"))
def q_vehicle_features(spark, sf):
    return flows.light(spark, sf).select("id", "veh_type", "is_heavy_vehicle", "veh_category")


@query("impute_zone", W(E, "select police_station, modal_zone from modal"))
def q_impute_zone(spark, sf):
    df = clean.parse_ts(clean.null_sentinels(flows.raw(spark, sf)))
    return clean.zone_by_station(df).withColumnRenamed("_modal_zone", "modal_zone")


@query("resolution_capped", W(E, """select id, resolution_minutes, resolution_minutes_capped, is_open
from eng"""))
def q_resolution_capped(spark, sf):
    return flows.light(spark, sf, "resolution_minutes_capped").select("id", "resolution_minutes", "resolution_minutes_capped",
                                              "is_open")


@query("severity", W(E, """select id, priority, requires_road_closure, congestion_severity,
  event_cause, event_cause_grouped from eng"""))
def q_severity(spark, sf):
    return flows.light(spark, sf).select("id", "priority", "requires_road_closure",
                                              "congestion_severity", "event_cause", "event_cause_grouped")


NULL_COLS = ("zone", "corridor", "priority", "veh_type", "resolution_minutes",
             "event_cause_grouped", "start_local")


@query("null_profile", W(E, "\nunion all\n".join(
    f"""select '{c}' as column_name, cast(count(*) filter (where {c} is null) as bigint) as null_count,
  round(cast(count(*) filter (where {c} is null) as double) * 100.0 / count(*), 1) as null_pct from eng"""
    for c in NULL_COLS)))
def q_null_profile(spark, sf):
    return clean.null_profile(flows.engineered(spark, sf), list(NULL_COLS))


@query("filter_incidents", W(E, """select * from eng
where date >= date '2024-01-08' and date <= date '2024-01-21'
  and corridor in ('Corridor 01', 'Corridor 02', 'Corridor 07')
  and event_cause_grouped in ('accident', 'water_logging', 'civic_event')"""))
def q_filter_incidents(spark, sf):
    return clean.filter_incidents(flows.engineered(spark, sf), "2024-01-08", "2024-01-21",
                                  ["Corridor 01", "Corridor 02", "Corridor 07"],
                                  ["accident", "water_logging", "civic_event"])


@query("profile", W(E, """select count(*) as n_rows, cast(13 as bigint) as n_columns,
  count(start_datetime) as n_parsed from inc"""))
def q_profile(spark, sf):
    return clean.profile(flows.raw(spark, sf))


# --------------------------------------------------------------------------
# Step 2: cascade labels, look-back windows, risk, hourly series
# --------------------------------------------------------------------------
@query("follow_count_120", W(E + "," + O._follow_cte("f", 120, 3), f"""
select id, corridor, start_datetime, secondary_count, is_cascade_seed from f where {NAMED}"""))
def q_follow_120(spark, sf):
    return cascade.follow_count(flows.light(spark, sf), 120, 3).select(
        "id", "corridor", "start_datetime", "secondary_count", "is_cascade_seed")


@query("follow_count_130", W(E + "," + O._follow_cte("f", 130, 4), f"""
select id, corridor, start_datetime, secondary_count, is_cascade_seed from f where {NAMED}"""))
def q_follow_130(spark, sf):
    return cascade.follow_count(flows.light(spark, sf), 130, 4).select(
        "id", "corridor", "start_datetime", "secondary_count", "is_cascade_seed")


@query("cascade_pairs", W(E, f"""
select a.corridor, a.id as seed_id, a.start_datetime as seed_ts, b.id as follow_id,
  b.start_datetime as follow_ts,
  cast(date_diff('microsecond', a.start_datetime, b.start_datetime) as double) / 60000000.0 as gap_minutes
from eng a join eng b on a.corridor = b.corridor and b.start_datetime > a.start_datetime
 and b.start_datetime <= a.start_datetime + interval 120 minute
where a.{NAMED}"""))
def q_cascade_pairs(spark, sf):
    return cascade.cascade_pairs(flows.light(spark, sf), 120)


@query("lookback_2h_6h", W(L, "select id, corridor, corridor_events_2h, corridor_events_6h from lab"))
def q_lookback(spark, sf):
    return flows.labelled(spark, sf, ()).select("id", "corridor", "corridor_events_2h", "corridor_events_6h")


@query("seed_present_3h", W(L, "select id, seed_event_present_3h from lab"))
def q_seed_present(spark, sf):
    return flows.labelled(spark, sf, ()).select("id", "seed_event_present_3h")


@query("cascade_density", W(L, "select id, cascade_density from lab"))
def q_density(spark, sf):
    return flows.labelled(spark, sf, ()).select("id", "cascade_density")


@query("cascade_features", W(L, """select id, corridor, secondary_count, is_cascade_seed,
  corridor_events_2h, corridor_events_6h, seed_event_present_3h, cascade_density from lab"""))
def q_cascade_features(spark, sf):
    return flows.labelled(spark, sf, ()).select(
        "id", "corridor", "secondary_count", "is_cascade_seed", "corridor_events_2h",
        "corridor_events_6h", "seed_event_present_3h", "cascade_density")


@query("corridor_risk", W(E, "select corridor, high_count, corridor_risk_score from risk"))
def q_corridor_risk(spark, sf):
    df = flows.engineered(spark, sf)
    return features.corridor_risk(df)


@query("corridor_totals", W(E, "select corridor, count(*) as corridor_total from eng group by corridor"))
def q_corridor_totals(spark, sf):
    return cascade.corridor_totals(flows.light(spark, sf))


HOURLY = f"""hc as (
  select corridor, date_trunc('hour', start_local) as hourly_bucket, count(*) as event_count
  from eng where {NAMED} and start_local is not null group by 1, 2),
span as (select min(hourly_bucket) as lo, max(hourly_bucket) as hi from hc),
grid as (
  select c.corridor, g.hourly_bucket
  from (select distinct corridor from hc) c
  cross join (select unnest(generate_series(lo, hi, interval 1 hour)) as hourly_bucket from span) g),
hg as (
  select grid.corridor, grid.hourly_bucket, cast(coalesce(hc.event_count, 0) as bigint) as event_count,
    isodow(grid.hourly_bucket) - 1 as day_of_week, hour(grid.hourly_bucket) as hour_of_day
  from grid left join hc on grid.corridor = hc.corridor and grid.hourly_bucket = hc.hourly_bucket)"""


@query("hourly_counts", W(E + "," + HOURLY, "select * from hc"))
def q_hourly_counts(spark, sf):
    return timeseries.hourly_counts(flows.light(spark, sf))


@query("hourly_grid", W(E + "," + HOURLY, "select * from hg"))
def q_hourly_grid(spark, sf):
    return timeseries.hourly_grid(timeseries.hourly_counts(flows.light(spark, sf)))


@query("hourly_lags", W(E + "," + HOURLY, """select * from (
  select *,
    lag(event_count, 1) over (partition by corridor order by hourly_bucket) as count_lag_1,
    lag(event_count, 24) over (partition by corridor order by hourly_bucket) as count_lag_24,
    lag(event_count, 168) over (partition by corridor order by hourly_bucket) as count_lag_168
  from hg) t where count_lag_168 is not null"""))
def q_hourly_lags(spark, sf):
    grid = timeseries.hourly_grid(timeseries.hourly_counts(flows.light(spark, sf)))
    return timeseries.add_lags(grid)


def registered() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# further query groups register themselves on import
from ripple.plans import catalog_reports, catalog_decisions, catalog_ml, catalog_stream, catalog_io  # noqa: E402,F401
