"""Registered source/sink round trips.

Each writes data Spark derives from the driver tables into a fresh folder
under the shared checkpoint folder and reads it back with the library's
readers, so the check covers writer + reader + parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ripple.operators import decisions
from ripple.plans import flows
from ripple.plans import oracle as O
from ripple.plans.catalog import query
from ripple.plans.catalog_decisions import PLAN_COLS, PLAN_CTES, WR
from ripple.session import scratch_path
from ripple.sources import io

RAW_TEXT = ("id", "start_datetime", "closed_datetime", "corridor", "zone", "police_station", "priority",
            "requires_road_closure", "event_cause", "veh_type", "status")


@query("raw_csv_roundtrip", O.with_ctes(O.INC_CTE, """select id, start_datetime, closed_datetime,
  corridor, zone, police_station, priority, requires_road_closure, event_cause, veh_type, status,
  latitude, longitude from inc"""))
def q_raw_csv_roundtrip(spark, sf):
    """Incidents exported as text (UTC with ``+00``, ``NULL`` tokens) and
    read back with an explicit schema; timestamps parsed, sentinels kept as text."""
    raw = flows.raw(spark, sf)
    text = raw.select(
        F.col("id").cast("string").alias("id"),
        *[F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")), F.lit("NULL"))
          .alias(c) for c in ("start_datetime", "closed_datetime")],
        *[F.col(c) for c in RAW_TEXT[3:]], "latitude", "longitude")
    path = scratch_path(spark, "raw_csv")
    io.write_raw(text, path, null_token="\\N")
    return io.read_incidents(spark, path, "csv", null_token="\\N").select(*RAW_TEXT, "latitude", "longitude")


EXPORT_COLS = [c for c in flows.ENGINEERED_COLUMNS if c not in io.EXPORT_DROP]


@query("engineered_export", O.with_ctes(O.ENGINEERED_CTES, f"select {', '.join(EXPORT_COLS)} from eng"))
def q_engineered_export(spark, sf):
    """Engineered table written as Parquet partitioned by month, read back."""
    path = scratch_path(spark, "engineered")
    io.write_engineered(flows.engineered(spark, sf), path)
    back = io.read_engineered(spark, path)
    return back.select(*[F.col(c).cast("long") if c == "month" else F.col(c) for c in EXPORT_COLS])


@query("plan_csv_roundtrip", WR(O.SCORED_CTES, PLAN_CTES, f"select {PLAN_COLS} from plan"))
def q_plan_csv(spark, sf):
    """Plan written as header CSV and read back."""
    path = scratch_path(spark, "plan_csv")
    io.write_plan(decisions.plan_columns(flows.plan_standin(spark, sf)), path, "csv")
    return io.read_plan(spark, path, "csv")


@query("plan_json_roundtrip", WR(O.SCORED_CTES, PLAN_CTES, f"select {PLAN_COLS} from plan"))
def q_plan_json(spark, sf):
    """Plan written as JSON Lines and read back."""
    path = scratch_path(spark, "plan_json")
    io.write_plan(decisions.plan_columns(flows.plan_standin(spark, sf)), path, "json")
    return io.read_plan(spark, path, "json")

