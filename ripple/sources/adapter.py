"""Raw incident rows derived from the driver's ``events`` table.

The test tables carry no incident data, so every registered query reads
``events`` and derives raw incident columns from it with column
expressions (a pure projection: it scans, prunes and scales like events).
The same derivation is repeated as a SQL CTE for the DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES — cause and vehicle vocabularies of the derived rows, in order.
CAUSE_CYCLE = ("vehicle_breakdown", " Vehicle_Breakdown", "accident", "water_logging",
               "pot_holes", "tree_fall", "construction", "public_event", "procession",
               "protest", "test_demo", "debris", "others", None)
VEHICLE_CYCLE = ("truck", "BMTC_bus ", "private_car", "auto", "lcv", "0", "",
                 "heavy_vehicle", "NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _cycle(k, values, default=None) -> F.Column:
    """``values[k % n]`` (``default`` for a negative or null remainder).

    One array lookup instead of an n-way CASE, so ``k`` (a JSON field) is
    referenced once per column, also after Catalyst pushes filters down.
    ``get`` is null off the array; a value that is itself null must be the default.
    """
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.coalesce(F.get(arr, k % len(values)), F.lit(default).cast("string"))


def incidents_from_events(events: DataFrame, n_corridors: int = 15) -> DataFrame:
    """Raw incident columns (all text except timestamps and coordinates)."""
    width = max(2, len(str(n_corridors - 1)))
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    corr_no = F.col("user_id") % n_corridors
    closed = (F.when(F.col("k") % 7 == 0, F.lit(None))
              .when(F.col("k") == 50, F.col("ts") - F.expr("INTERVAL 5 MINUTES"))
              .otherwise(F.timestamp_add("MINUTE", F.floor(F.col("value") * 10).cast("int"),
                                        F.col("ts"))))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("start_datetime"),
        closed.alias("closed_datetime"),
        F.when(corr_no == 0, F.lit("Non-corridor"))
         .otherwise(F.concat(F.lit("Corridor "), F.lpad(corr_no.cast("string"), width, "0")))
         .alias("corridor"),
        F.when(F.col("event_type").isin("error", "purchase"), F.lit("High"))
         .when(F.col("event_type") == "view", F.lit(None).cast("string"))
         .otherwise(F.lit("Low")).alias("priority"),
        F.when(F.col("k") % 12 == 0, F.lit(" true "))
         .when(F.col("k") % 12 == 1, F.lit("NULL"))
         .otherwise(F.lit("FALSE")).alias("requires_road_closure"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
         .when((F.col("event_id") % 10).isin(3, 7),
               F.concat(F.lit("Zone "), (F.col("event_id") % 6).cast("string")))
         .otherwise(F.concat(F.lit("Zone "), (F.col("user_id") % 20 % 6).cast("string")))
         .alias("zone"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("PS "), (F.col("user_id") % 20).cast("string")))
         .alias("police_station"),
        _cycle(F.col("k"), CAUSE_CYCLE).alias("event_cause"),
        _cycle(F.col("k"), VEHICLE_CYCLE, VEHICLE_CYCLE[-1]).alias("veh_type"),
        F.when(F.col("k") % 3 == 0, F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        F.when(F.col("k") % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.expr("cast(12.85 + (user_id % 50) * 0.005 as double)"))
         .alias("latitude"),
        F.when(F.col("k") % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.expr("cast(77.45 + (user_id % 40) * 0.006 as double)"))
         .alias("longitude"),
    )


def incidents(spark: SparkSession, sf_dir: str, n_corridors: int = 15) -> DataFrame:
    return incidents_from_events(table(spark, sf_dir, "events"), n_corridors)


def adapter_sql(n_corridors: int = 15) -> str:
    """DuckDB form of :func:`incidents_from_events` (for the oracle)."""
    width = max(2, len(str(n_corridors - 1)))
    causes = " ".join(
        f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(CAUSE_CYCLE[:-1]))
    vehicles = " ".join(f"when {i} then {v!r}" for i, v in enumerate(VEHICLE_CYCLE[:-1]))
    last_vehicle = repr(VEHICLE_CYCLE[-1])
    n = n_corridors
    return f"""
select event_id as id, ts as start_datetime,
  case when k % 7 = 0 then null
       when k = 50 then ts - interval '5' minute
       else ts + cast(floor(value * 10) as int) * interval '1' minute end as closed_datetime,
  case when user_id % {n} = 0 then 'Non-corridor'
       else concat('Corridor ', lpad(cast(user_id % {n} as varchar), {width}, '0')) end as corridor,
  case when event_type in ('error', 'purchase') then 'High'
       when event_type = 'view' then null else 'Low' end as priority,
  case when k % 12 = 0 then ' true ' when k % 12 = 1 then 'NULL' else 'FALSE' end as requires_road_closure,
  case when event_id % 4 = 0 then null
       when event_id % 10 in (3, 7) then concat('Zone ', cast(event_id % 6 as varchar))
       else concat('Zone ', cast(user_id % 20 % 6 as varchar)) end as zone,
  case when event_id % 11 = 0 then null
       else concat('PS ', cast(user_id % 20 as varchar)) end as police_station,
  case k % 14 {causes} else null end as event_cause,
  case k % 9 {vehicles} else {last_vehicle} end as veh_type,
  case when k % 3 = 0 then 'closed' else 'active' end as status,
  case when k % 13 = 0 then null else cast(12.85 + (user_id % 50) * 0.005 as double) end as latitude,
  case when k % 13 = 0 then null else cast(77.45 + (user_id % 40) * 0.006 as double) end as longitude
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
"""
