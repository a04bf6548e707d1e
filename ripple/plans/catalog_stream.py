"""Registered streaming queries (step 6).

Each runs a Structured Streaming query with an ``availableNow`` trigger over
the ``events`` file, writes Parquet under the shared checkpoint folder and
returns the result as a batch DataFrame.  The oracle is the batch SQL over all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ripple.plans import flows
from ripple.plans import oracle as O
from ripple.plans.catalog import HOURLY, query
from ripple.plans.catalog_decisions import ALERT_COLS, ALERT_CTES
from ripple.plans.catalog_reports import WX
from ripple.streaming import jobs

LIGHT = O.INC_CTE + """,
lin as (
  select id, start_datetime,
    coalesce(case when corridor in ('NULL', 'nan') then null else corridor end, 'Non-corridor') as corridor,
    lower(trim(coalesce(case when event_cause in ('NULL', 'nan') then null else event_cause end, 'others')))
      as event_cause
  from inc),
lclean as (select * from lin where event_cause <> 'test_demo')"""


# K1 over every named incident: zero followers and the newest ones included.
@query("stream_seed_labels", O.with_ctes(LIGHT, f"""select a.id as seed_id, a.corridor, a.start_datetime as seed_ts,
  count(b.id) as secondary_count, count(b.id) >= 3 as is_cascade_seed
from lclean a left join lclean b on a.corridor = b.corridor and b.start_datetime > a.start_datetime
 and b.start_datetime <= a.start_datetime + interval 120 minute
where a.{O.NAMED} and a.start_datetime is not null
group by a.id, a.corridor, a.start_datetime"""))
def q_stream_seed_labels(spark, sf):
    out = jobs.run_to_end(jobs.stream_seed_labels, jobs.incident_stream(spark, sf), "stream_seeds")
    return out.select("seed_id", "corridor", F.col("seed_time").cast("timestamp_ntz").alias("seed_ts"),
                      "secondary_count", "is_cascade_seed")


@query("stream_hourly", WX(O.ENGINEERED_CTES, HOURLY, "select * from hc"))
def q_stream_hourly(spark, sf):
    return jobs.run_to_end(jobs.stream_hourly, jobs.incident_stream(spark, sf), "stream_hourly")


LOOKBACK_SQL = O.with_ctes(O.LABELLED_CTES, """select id, corridor, corridor_events_2h, corridor_events_6h,
  seed_event_present_3h from lab where start_datetime is not null""")


@query("stream_lookback", LOOKBACK_SQL)
def q_stream_lookback(spark, sf):
    return jobs.run_to_end(jobs.window_lookback, jobs.incident_stream(spark, sf), "stream_lookback")


# T3 at arrival: every row leaves in the batch it comes in.
@query("stream_arrival", LOOKBACK_SQL)
def q_stream_arrival(spark, sf):
    return jobs.run_available(jobs.arrival_lookback(jobs.incident_stream(spark, sf)), "stream_arrival")


# Every incident with a start: the stream's final rows and, behind its last watermark, the batch look-back.
@query("stream_lookback_all", O.with_ctes(O.LABELLED_CTES, """select id, corridor, corridor_events_2h,
  corridor_events_6h, seed_event_present_3h from lab where start_datetime is not null"""))
def q_stream_lookback_all(spark, sf):
    final = jobs.run_available(jobs.window_lookback(jobs.incident_stream(spark, sf)), "stream_lookback_open")
    return final.unionByName(jobs.lookback_tail(jobs.incident_table(spark, sf)))


@query("stream_alert_sink", LOOKBACK_SQL)
def q_stream_alert_sink(spark, sf):
    return jobs.run_foreach(jobs.arrival_lookback(jobs.incident_stream(spark, sf)), "stream_sink").drop("batch_id")


# T3 scoring (stand-in score) and T4: the alerts of every incident, keyed by (corridor, alert_id).
@query("stream_alerts", WX(O.SCORED_CTES, ALERT_CTES, f"select {ALERT_COLS} from alerts"))
def q_stream_alerts(spark, sf):
    return jobs.run_alerts(jobs.incident_stream(spark, sf), flows.engineered(spark, sf), "stream_alerts")
