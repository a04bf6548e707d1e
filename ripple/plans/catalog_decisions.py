"""Registered alert, plan and metric queries (steps 4-5) on the stand-in score.

The stand-in score (``decisions.standin_score``) is a fixed linear
function of the look-back features, so the whole replay -> alert -> plan
chain and the threshold / confusion / error metrics can be checked
exactly against SQL.  The trained-model versions are in ``catalog_ml``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ripple import constants as K
from ripple.operators import decisions, features, metrics, timeseries
from ripple.plans import flows
from ripple.plans import oracle as O
from ripple.plans.catalog import HOURLY, query
from ripple.plans.catalog_reports import DATA_CUTOFF, WX

RISK = ("corridor_risk_score",)      # what the score itself needs of the derived columns
S, E, L = O.SCORED_CTES, O.ENGINEERED_CTES, O.LABELLED_CTES


def _case_map(col, mapping, default, quote_values=False):
    whens = " ".join(
        f"when {O._q([k])} then {O._q([v]) if quote_values else v}" for k, v in mapping.items())
    dflt = O._q([default]) if quote_values else default
    return f"coalesce(case {col} {whens} end, {dflt})"


def _pick(hi, mid, lo):
    p = "cascade_probability"
    return f"case when {p} >= 0.7 then {hi} when {p} >= 0.4 then {mid} else {lo} end"


_CODE = ("rpad(upper(substr(array_to_string(list_transform(list_filter("
         "string_split_regex(trim(corridor), '\\s+'), lambda w: regexp_matches(left(w, 1), '^[A-Za-z]$')), "
         "lambda w: left(w, 1)), ''), 1, 3)), 3, 'X')")

ALERT_CTES = f"""al as (
  select *, row_number() over (partition by corridor, date order by start_local, id) as seq
  from scored where cascade_probability >= 0.1 and start_local is not null),
rq as (
  select *,
    {_pick("'HIGH'", "'MEDIUM'", "'LOW'")} as confidence_band,
    {_pick("'PRIORITY DEPLOYMENT'", "''", "''")} as prio_flag,
    cast({_pick(4, 3, 2)} as bigint) as police_needed,
    cast({_pick(2, 1, 0)} + case when event_cause_grouped = 'water_logging' then 1 else 0 end as bigint)
      as breakdown_needed,
    cast({_pick(3, 2, 1)} + case when event_cause_grouped = 'pot_holes' and hour_of_day between 0 and 6
      then 2 else 0 end + case when requires_road_closure then 2 else 0 end as bigint) as barricades_needed,
    {_case_map("event_cause_grouped", K.AVG_RESOLUTIONS, K.DEFAULT_RESOLUTION_MIN)} as res_min,
    {_case_map("event_cause_grouped", K.RESOLUTION_SAMPLE_N, K.DEFAULT_SAMPLE_N)} as sample_n,
    {_case_map("zone", K.NEIGHBOUR_ZONES, K.DEFAULT_NEIGHBOUR, True)} as neighbour,
    {_CODE} as code
  from al),
alerts as (
  select 'ALERT-' || strftime(date, '%Y%m%d') || '-' || code || '-' || printf('%03d', seq) as alert_id,
    id, corridor, date, seq, start_local, hour_of_day, event_cause_grouped as cause,
    time_label as time_ist, requires_road_closure as road_closure_required,
    cascade_probability, round(cascade_probability, 2) as risk_score,
    predicted_secondary_count as predicted_secondary_events_2h,
    '{K.TOP_CAUSE_EXPECTED}' as top_cause_expected, confidence_band,
    case when police_needed <= 0 and breakdown_needed <= 0 and barricades_needed <= 0
      then 'Monitor ' || corridor || ' - no immediate deployment required'
      else 'Deploy ' || concat_ws(', ',
        case when police_needed > 0 then cast(police_needed as varchar) || ' traffic police' end,
        case when breakdown_needed > 0 then cast(breakdown_needed as varchar) || ' breakdown units' end,
        case when barricades_needed > 0 then cast(barricades_needed as varchar) || ' barricades' end)
        || ' -> ' || corridor || ', ETA: subject to fleet positioning' end as deploy_now,
    coalesce(police_station, 'Unknown Station') as alert_stations,
    'Activate additional 2 breakdown recovery units if secondary count exceeds '
      || cast(predicted_secondary_count as varchar) as standby,
    police_needed, breakdown_needed, barricades_needed,
    case when police_needed > 50 then 'RESOURCE SHORTFALL: request backup from ' || neighbour
      else 'ALLOCATED' end as police_flag,
    prio_flag,
    strftime(start_datetime + res_min * interval 1 minute + interval 330 minute, '%Y-%m-%d %H:%M:%S')
      || ' IST (clears in '
      || case when res_min < 60 then '~' || cast(res_min as varchar) || ' min'
              when res_min % 60 > 0 then '~' || cast(res_min // 60 as varchar) || 'h '
                   || cast(res_min % 60 as varchar) || 'm'
              else '~' || cast(res_min // 60 as varchar) || 'h' end
      || ')' || case when sample_n < 10 then ' (estimate — limited data)' else '' end
      as estimated_clearance_ist
  from rq)"""

ALERT_COLS = ("alert_id, id, corridor, date, seq, start_local, hour_of_day, cause, time_ist, "
              "road_closure_required, cascade_probability, risk_score, predicted_secondary_events_2h, top_cause_expected, "
              "confidence_band, deploy_now, alert_stations, standby, police_needed, breakdown_needed, "
              "barricades_needed, police_flag, prio_flag, estimated_clearance_ist")

PLAN_CTES = ALERT_CTES + """,
ranked as (
  select *, row_number() over (partition by corridor, date order by risk_score desc, seq) as r
  from alerts),
rec as (
  select corridor, date, r,
    least(police_needed, 50) as dp, least(breakdown_needed, 8) as db, least(barricades_needed, 20) as dr,
    50 - least(police_needed, 50) as lp, 8 - least(breakdown_needed, 8) as lb,
    20 - least(barricades_needed, 20) as lr
  from ranked where r = 1
  union all
  select n.corridor, n.date, n.r,
    least(n.police_needed, rec.lp), least(n.breakdown_needed, rec.lb), least(n.barricades_needed, rec.lr),
    rec.lp - least(n.police_needed, rec.lp), rec.lb - least(n.breakdown_needed, rec.lb),
    rec.lr - least(n.barricades_needed, rec.lr)
  from rec join ranked n on n.corridor = rec.corridor and n.date = rec.date and n.r = rec.r + 1),
plan as (
  select k.*, cast(rec.dp as bigint) as deploy_police, cast(rec.db as bigint) as deploy_breakdown,
    cast(rec.dr as bigint) as deploy_barricades,
    case when rec.dp < k.police_needed or rec.db < k.breakdown_needed or rec.dr < k.barricades_needed
      then 'RESOURCE SHORTFALL: request backup' else 'ALLOCATED' end as resource_flag
  from ranked k join rec on k.corridor = rec.corridor and k.date = rec.date and k.r = rec.r)"""


def WR(base, extra, body):
    return "with recursive " + base + ",\n" + extra + "\n" + body


@query("alert_bands", WX(S, ALERT_CTES, """select id, confidence_band, prio_flag, police_needed,
  breakdown_needed, barricades_needed from alerts"""))
def q_alert_bands(spark, sf):
    return flows.alerts_standin(spark, sf).select(
        "id", "confidence_band", "prio_flag", "police_needed", "breakdown_needed", "barricades_needed")


@query("alerts", WX(S, ALERT_CTES, f"select {ALERT_COLS} from alerts"))
def q_alerts(spark, sf):
    return flows.alerts_standin(spark, sf)


@query("replay_status", WX(S, "x as (select 1)", """select id, corridor, date, clock,
  case when cascade_probability >= 0.1
       then 'CASCADE SEED (' || printf('%.0f', cascade_probability * 100) || '% risk)'
       else 'NO CASCADE (' || printf('%.0f', cascade_probability * 100) || '% risk)' end as status
from scored where start_local is not null"""))
def q_replay_status(spark, sf):
    """Timeline status line for every incident of every corridor-day."""
    s = flows.scored_standin(spark, sf, RISK).where(F.col("start_local").isNotNull())
    return s.select("id", "corridor", "date", "clock", decisions.status_text("cascade_probability", 0.10)
                    .alias("status"))


@query("alert_ids", WX(S, ALERT_CTES, "select id, corridor, date, seq, alert_id from alerts"))
def q_alert_ids(spark, sf):
    return flows.alerts_standin(spark, sf).select("id", "corridor", "date", "seq", "alert_id")


@query("clearance", WX(S, ALERT_CTES, "select id, cause, estimated_clearance_ist from alerts"))
def q_clearance(spark, sf):
    return flows.alerts_standin(spark, sf).select("id", "cause", "estimated_clearance_ist")


@query("deploy_message", WX(S, ALERT_CTES, "select id, deploy_now, standby, police_flag from alerts"))
def q_deploy_message(spark, sf):
    return flows.alerts_standin(spark, sf).select("id", "deploy_now", "standby", "police_flag")


PLAN_COLS = ("alert_id, corridor, time_ist, cause as seed_cause, risk_score, deploy_police, "
             "deploy_breakdown, deploy_barricades, estimated_clearance_ist as estimated_clearance, "
             "resource_flag")


@query("greedy_plan", WR(S, PLAN_CTES, f"select {PLAN_COLS} from plan"))
def q_greedy_plan(spark, sf):
    return decisions.plan_columns(flows.plan_standin(spark, sf))


@query("resource_burn", WR(S, PLAN_CTES + """,
ph as (
  select corridor, date, hour_of_day as hour, sum(deploy_police) as p, sum(deploy_breakdown) as b,
    sum(deploy_barricades) as r from plan group by 1, 2, 3),
sp as (select distinct corridor, date, unnest(range(24)) as hour from plan)""", """
select sp.corridor, sp.date, sp.hour,
  cast(least(sum(coalesce(p, 0)) over w, 50) as bigint) as police_used,
  cast(least(sum(coalesce(b, 0)) over w, 8) as bigint) as breakdown_used,
  cast(least(sum(coalesce(r, 0)) over w, 20) as bigint) as barricades_used
from sp left join ph on sp.corridor = ph.corridor and sp.date = ph.date and sp.hour = ph.hour
window w as (partition by sp.corridor, sp.date order by sp.hour
             rows between unbounded preceding and current row)"""))
def q_resource_burn(spark, sf):
    return timeseries.resource_burn(flows.plan_standin(spark, sf))


@query("alert_tiers", WX(S, ALERT_CTES + """,
t as (
  select *, case when cascade_probability >= 0.6 then 'RED' when cascade_probability >= 0.3 then 'AMBER'
    else 'GREEN' end as tier from alerts),
d as (
  select *,
    cast(case tier when 'RED' then police_needed when 'AMBER' then greatest(police_needed, 2) else 1 end
      as bigint) as police_disp,
    cast(case tier when 'RED' then breakdown_needed when 'AMBER' then greatest(breakdown_needed, 1)
      else case when cause in ('accident', 'vehicle_breakdown', 'tree_fall') then 1 else 0 end end
      as bigint) as breakdown_disp,
    cast(case tier when 'RED' then barricades_needed when 'AMBER' then greatest(barricades_needed, 1)
      else case when cause in ('accident', 'water_logging', 'tree_fall') then 1 else 0 end end
      as bigint) as barricades_disp
  from t)""", """
select id, tier, police_disp, breakdown_disp, barricades_disp,
  case tier when 'RED' then deploy_now
    when 'AMBER' then 'Pre-position ' || cast(police_disp as varchar) || ' traffic police and '
      || cast(breakdown_disp as varchar) || ' breakdown unit(s) near ' || corridor
    else 'Dispatch 1 patrol officer to ' || corridor || ' — routine monitoring' end as action,
  case tier when 'RED' then police_flag when 'AMBER' then 'STANDBY — Deploy on confirmation'
    else 'ROUTINE MONITORING' end as status
from d"""))
def q_alert_tiers(spark, sf):
    a = decisions.tier_actions(decisions.tiers(flows.alerts_standin(spark, sf)))
    return a.select("id", "tier", "police_disp", "breakdown_disp", "barricades_disp", "action", "status")


_TERMS = [("corridor_events_2h", "cast(corridor_events_2h * 5 as double)"),
          ("seed_event_present_3h", "cast(seed_event_present_3h * 25 as double)"),
          ("is_peak_hour", "cast(is_peak_hour * 5 as double)"),
          ("requires_road_closure", "cast(cast(requires_road_closure as bigint) * 10 as double)"),
          ("corridor_risk_score", "cast(floor(corridor_risk_score * 30) as double)")]
_UNPIVOT = "\n  union all\n  ".join(
    f"select id, {i} as i, '{K.FEATURE_LABELS.get(n, n)}' as label, greatest({e} / 100.0, 0.001) as v "
    f"from scored where cascade_probability >= 0.1" for i, (n, e) in enumerate(_TERMS))


def _dec_round(x):
    # Spark rounds a double HALF_UP on its shortest decimal text
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 18)), 2) as double)"


# The nested alert document (structs and driver arrays) as JSON text.
@query("alerts_nested", WX(S, ALERT_CTES + f""",
terms as (
  {_UNPIVOT}),
top3 as (
  select *, row_number() over (partition by id order by v desc, i) as rn from terms),
drivers as (
  select id, list(label order by rn) as driver_top3, list(v order by rn) as driver_values3
  from top3 where rn <= 3 group by id)""", """
select alert_id, cast(to_json({
  'alert_id': alert_id,
  'trigger': {'cause': cause, 'corridor': corridor, 'time_ist': time_ist,
    'road_closure_required': road_closure_required},
  'cascade_prediction': {'risk_score': risk_score, 'predicted_secondary_events_2h': predicted_secondary_events_2h,
    'top_cause_expected': top_cause_expected, 'confidence_band': confidence_band},
  'deployment': {'DEPLOY_NOW': deploy_now, 'ALERT_STATIONS': alert_stations, 'STANDBY': standby,
    'police_needed': police_needed, 'breakdown_needed': breakdown_needed, 'barricades_needed': barricades_needed,
    'police_flag': police_flag, 'prio_flag': prio_flag},
  'estimated_clearance_ist': estimated_clearance_ist,
  'driver_top3': driver_top3, 'driver_values3': driver_values3}) as varchar) as alert_json
from alerts join drivers using (id)"""))
def q_alerts_nested(spark, sf):
    scored = decisions.standin_drivers(flows.scored_standin(spark, sf))
    doc = decisions.nest_alerts(decisions.build_alerts(scored))
    return doc.select("alert_id", F.to_json(F.struct(*doc.columns)).alias("alert_json"))


@query("driver_shares", WX(S, f"""terms as (
  {_UNPIVOT}),
top3 as (
  select *, row_number() over (partition by id order by v desc, i) as rn from terms),
t3 as (select *, sum(v) over (partition by id) as tot from top3 where rn <= 3)""", f"""
select id,
  max(case when rn = 1 then label end) as driver_1, max(case when rn = 2 then label end) as driver_2,
  max(case when rn = 3 then label end) as driver_3,
  max(case when rn = 1 then v end) as value_1, max(case when rn = 2 then v end) as value_2,
  max(case when rn = 3 then v end) as value_3,
  max(case when rn = 1 then {_dec_round('v / tot')} end) as share_1,
  max(case when rn = 2 then {_dec_round('v / tot')} end) as share_2,
  max(case when rn = 3 then {_dec_round('v / tot')} end) as share_3
from t3 group by id"""))
def q_driver_shares(spark, sf):
    s = flows.scored_standin(spark, sf, RISK).where(F.col("cascade_probability") >= 0.1)
    d = decisions.driver_shares(decisions.standin_drivers(s))
    return d.select("id", *[F.col("driver_top3")[i].alias(f"driver_{i + 1}") for i in range(3)],
                    *[F.col("driver_values3")[i].alias(f"value_{i + 1}") for i in range(3)],
                    *[F.col("driver_shares")[i].alias(f"share_{i + 1}") for i in range(3)])


@query("alert_log", WX(S, ALERT_CTES, """select alert_id, corridor, start_local,
  case when cascade_probability >= 0.6 then 'RED' else 'AMBER' end as tier,
  printf('%.0f%%', cascade_probability * 100) as risk, cause
from alerts where cascade_probability >= 0.3 order by start_local desc, id desc limit 5"""))
def q_alert_log(spark, sf):
    a = decisions.tiers(flows.alerts_standin(spark, sf))
    return decisions.alert_log(a, 5)


@query("map_feed", O.with_ctes(E, """select id, latitude, longitude, corridor, event_cause, congestion_severity,
  upper(congestion_severity) as severity_label, coalesce(corridor_risk_score, 0.0) as corridor_risk_score,
  greatest(coalesce(corridor_risk_score, 0.0), 0.1) * 15 + 5 as point_size,
  (select count(*) from eng where latitude is not null and longitude is not null) as n_points
from eng where latitude is not null and longitude is not null"""))
def q_map_feed(spark, sf):
    return features.map_feed(flows.light(spark, sf, "corridor_risk_score"))


# ---- M12 with the stand-in score: the whole what-if scenario grid --------
def _prof_mode(col):
    return f"""(select corridor, {col} as v from (
    select corridor, {col}, row_number() over (partition by corridor order by count(*) desc, {col}) as rn
    from eng where {O.NAMED} and {col} is not null group by corridor, {col}) x where rn = 1)"""


def _slot(k):
    return f"""s{k} as (
  select corridor, day_of_week, hour, cast(ceil(avg(c)) as bigint) as events_{k}h from (
    select corridor, day_of_week, hour, date, count(*) as c from (
      select corridor, day_of_week, date,
        unnest(generate_series(hour_of_day, least(hour_of_day + {k}, 23))) as hour
      from eng where {O.NAMED} and hour_of_day is not null) x
    group by 1, 2, 3, 4) y
  group by 1, 2, 3)"""


SCEN_CTES = f"""prof as (
  select corridor, max(corridor_risk_score) as typical_risk from eng where {O.NAMED} group by corridor),
{_slot(2)},
{_slot(6)},
causes as (select distinct event_cause_grouped as cause from eng),
grid as (
  select p.corridor, d.range as day_of_week, h.range as hour, c.cause, p.typical_risk
  from prof p cross join range(7) d cross join range(24) h cross join causes c),
sf as (
  select g.*, coalesce(s2.events_2h, 0) as e2, coalesce(s6.events_6h, 0) as e6,
    cast(g.cause in ({O._q(K.WHATIF_SEED_CAUSES)}) as bigint) as seed3,
    cast(g.cause in ({O._q(K.WHATIF_HEAVY_CAUSES)}) as bigint) as heavy,
    g.cause in ({O._q(K.WHATIF_CLOSURE_CAUSES)}) as closure,
    cast(coalesce(g.hour between 19 and 22 or g.hour between 4 and 6, false) as bigint) as peak
  from grid g
  left join s2 on g.corridor = s2.corridor and g.day_of_week = s2.day_of_week and g.hour = s2.hour
  left join s6 on g.corridor = s6.corridor and g.day_of_week = s6.day_of_week and g.hour = s6.hour)"""


@query("score_scenarios", WX(E, SCEN_CTES, """select corridor, day_of_week, hour, cause,
  e2 as corridor_events_2h, e6 as corridor_events_6h, seed3 as seed_event_present_3h,
  heavy as is_heavy_vehicle, closure as requires_road_closure,
  cast(least(5 * e2 + 25 * seed3 + 5 * peak + 10 * cast(closure as bigint)
             + cast(floor(typical_risk * 30) as bigint), 100) as double) / 100.0 as cascade_probability
from sf"""))
def q_score_scenarios(spark, sf):
    eng = flows.light(spark, sf, "corridor_risk_score")
    return metrics.scenario_grid(eng).select(
        "corridor", "day_of_week", "hour", "cause", "corridor_events_2h", "corridor_events_6h",
        "seed_event_present_3h", "is_heavy_vehicle", "requires_road_closure", "cascade_probability")


# ---- step 5: metrics on the stand-in score -------------------------------
SWEEP_CTES = """pos as (select count(*) filter (where is_cascade_seed) as p from scored),
grid as (select range * 10 as t from range(1, 10)),
sw as (
  select g.t, count(*) filter (where s.risk_pct >= g.t and s.is_cascade_seed) as tp,
    count(*) filter (where s.risk_pct >= g.t) as predicted
  from grid g cross join scored s group by g.t)"""


@query("threshold_sweep", WX(S, SWEEP_CTES, """select cast(t as double) / 100.0 as threshold,
  cast(tp as bigint) as tp, cast(predicted as bigint) as predicted,
  case when predicted > 0 then cast(tp as double) / cast(predicted as double) else 0.0 end as precision,
  case when p > 0 then cast(tp as double) / cast(p as double) else 0.0 end as recall
from sw cross join pos"""))
def q_threshold_sweep(spark, sf):
    return metrics.threshold_sweep(flows.scored_standin(spark, sf, RISK), "risk_pct", "is_cascade_seed")


@query("threshold_choice", WX(S, """pos as (select count(*) filter (where is_cascade_seed) as p from scored),
fine as (select range as t from range(10, 91)),
fw as (
  select f.t, case when max(pos.p) > 0 then cast(count(*) filter (where s.risk_pct >= f.t and s.is_cascade_seed)
    as double) / cast(max(pos.p) as double) else 0.0 end as recall
  from fine f cross join scored s cross join pos group by f.t),
coarse as (select min(t) as t from fw where t % 10 = 0 and recall >= 0.8),
closest as (select t, recall from fw order by abs(recall - 0.8), t limit 1)""", """
select cast(coalesce((select t from coarse), (select t from closest)) as double) / 100.0 as chosen_threshold,
  (select recall from fw where t = coalesce((select t from coarse), (select t from closest))) as recall"""))
def q_threshold_choice(spark, sf):
    return metrics.choose_threshold(flows.scored_standin(spark, sf, RISK), "risk_pct", "is_cascade_seed")


@query("confusion", O.with_ctes(S, """select cast(is_cascade_seed as bigint) as label,
  cast(cascade_probability >= 0.1 as bigint) as prediction, count(*) as n from scored group by 1, 2"""))
def q_confusion(spark, sf):
    return metrics.confusion(flows.scored_standin(spark, sf, RISK), 0.10)


@query("class_report", WX(S, """cm as (select cast(is_cascade_seed as bigint) as label,
  cast(cascade_probability >= 0.1 as bigint) as prediction from scored),
cls as (select range as cls from range(2)),
st as (
  select c.cls, count(*) filter (where cm.label = c.cls and cm.prediction = c.cls) as tp,
    count(*) filter (where cm.prediction = c.cls) as pp, count(*) filter (where cm.label = c.cls) as support
  from cls c cross join cm group by c.cls)""", """
select cls as class, case when pp > 0 then cast(tp as double) / pp else 0.0 end as precision,
  case when support > 0 then cast(tp as double) / support else 0.0 end as recall,
  case when pp + support > 0 then cast(2 * tp as double) / cast(pp + support as double) else 0.0 end as f1,
  cast(support as bigint) as support
from st"""))
def q_class_report(spark, sf):
    return metrics.class_report(flows.scored_standin(spark, sf, RISK), 0.10)


@query("mae_rmse", WX(E, HOURLY + f""",
lg as (
  select *, lag(event_count, 1) over (partition by corridor order by hourly_bucket) as count_lag_1,
    lag(event_count, 24) over (partition by corridor order by hourly_bucket) as count_lag_24,
    lag(event_count, 168) over (partition by corridor order by hourly_bucket) as count_lag_168
  from hg),
te as (select * from lg where count_lag_168 is not null and hourly_bucket >= timestamp '{DATA_CUTOFF}')""", """
select count(*) as n, avg(abs(cast(event_count - count_lag_1 as double))) as mae,
  sqrt(avg(cast(event_count - count_lag_1 as double) * cast(event_count - count_lag_1 as double))) as rmse
from te"""))
def q_mae_rmse(spark, sf):
    grid = timeseries.add_lags(timeseries.hourly_grid(timeseries.hourly_counts(flows.light(spark, sf))))
    test = grid.where(F.col("hourly_bucket") >= F.lit(DATA_CUTOFF).cast("timestamp_ntz"))
    return metrics.regression_errors(test.withColumn("prediction", F.col("count_lag_1").cast("double")),
                                     "event_count", "prediction")

