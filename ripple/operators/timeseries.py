"""Hourly corridor series (A17, J5, K6, K7) and resource burn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X


def hourly_counts(df: DataFrame, ts: str = "start_local") -> DataFrame:
    """Incidents per named corridor and local clock hour."""
    return (df.where(X.is_named_corridor("corridor") & F.col(ts).isNotNull())
              .groupBy("corridor", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
                       .alias("hourly_bucket"))
              .agg(F.count(F.lit(1)).alias("event_count")))


def hourly_grid(counts: DataFrame) -> DataFrame:
    """Dense corridor x hour grid between the first and last observed
    hour, zero-filled.

    Each corridor row explodes its own hour sequence (bounded by the time
    span, not by the number of incidents), then the observed counts are
    left-joined on ``(corridor, hour)``.
    """
    span = counts.select(F.struct(F.min("hourly_bucket").alias("lo"),
                                  F.max("hourly_bucket").alias("hi"))).scalar()   # one subquery
    lo, hi = span["lo"], span["hi"]
    corridors = counts.select("corridor").distinct()
    grid = corridors.select("corridor", F.explode(
        F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))).alias("hourly_bucket"))
    out = grid.join(counts, on=["corridor", "hourly_bucket"], how="left")
    t = F.col("hourly_bucket")
    return out.select("corridor", "hourly_bucket",
                      F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
                      F.weekday(t).cast("long").alias("day_of_week"),
                      F.hour(t).cast("long").alias("hour_of_day"))


def add_lags(grid: DataFrame, lags=K.LAGS, drop_incomplete: bool = True) -> DataFrame:
    """K7: ``count_lag_k`` = count k hours earlier on the same corridor."""
    w = Window.partitionBy("corridor").orderBy("hourly_bucket")
    out = grid.withColumns({f"count_lag_{k}": F.lag("event_count", k).over(w) for k in lags})
    if drop_incomplete:
        out = out.dropna(subset=[f"count_lag_{k}" for k in lags])
    return out


def resource_burn(plan: DataFrame, caps=K.RESOURCE_CAPS) -> DataFrame:
    """Resources committed up to each local hour of each plan, capped.

    ``plan`` has ``corridor``, ``date``, ``hour_of_day`` and the three
    ``deploy_*`` columns.  One aggregate per plan builds 24-hour arrays;
    running sums are array functions, so there is no second shuffle.
    """
    cap = dict(caps)
    cols = (("deploy_police", "police_used", cap["traffic_police"]),
            ("deploy_breakdown", "breakdown_used", cap["breakdown_units"]),
            ("deploy_barricades", "barricades_used", cap["barricades"]))
    per = plan.groupBy("corridor", "date").agg(*[
        F.array(*[F.sum(F.when(F.col("hour_of_day") == h, F.col(src)).otherwise(0)) for h in range(24)])
        .alias(f"_{out}") for src, out, _ in cols])
    hours = F.sequence(F.lit(0), F.lit(23))

    def running(arr, limit):
        return F.transform(hours, lambda h: F.least(
            F.aggregate(F.slice(F.col(arr), 1, h + 1), F.lit(0).cast("long"), lambda a, x: a + x),
            F.lit(limit).cast("long")))

    z = per.select("corridor", "date", F.explode(F.arrays_zip(
        hours.alias("hour"), *[running(f"_{out}", lim).alias(out) for _, out, lim in cols])).alias("z"))
    return z.select("corridor", "date", F.col("z.hour").cast("long").alias("hour"),
                    *[F.col(f"z.{out}").cast("long").alias(out) for _, out, _ in cols])
