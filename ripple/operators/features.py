"""Scalar features and the engineered incident table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators import clean as C
from ripple.operators.joins import lookup_join
from ripple.operators.quantiles import exact_quantiles


def add_time_features(df: DataFrame, ts: str = "start_local", peaks=K.PEAK_HOURS) -> DataFrame:
    """F1-F3, F11, F12 from the local wall clock."""
    t = F.col(ts)
    return df.withColumns({
        "hour_of_day": F.hour(t).cast("long"),
        "day_of_week": F.weekday(t).cast("long"),
        "day_name": F.date_format(t, "EEEE"),
        "month": F.month(t).cast("long"),
        "month_name": F.date_format(t, "MMMM"),
        "date": F.to_date(t),
    }).withColumns({
        "is_weekend": X.is_weekend("day_of_week").cast("long"),
        "is_peak_hour": X.is_peak("hour_of_day", peaks).cast("long"),
        "hour_fraction": (F.hour(t) + F.minute(t) / F.lit(60.0)),
        "date_str": F.date_format(t, "yyyy-MM-dd"),
        "time_label": F.concat(F.date_format(t, "HH:mm"), F.lit(" IST")),
        "clock": F.date_format(t, "HH:mm:ss"),
    })


def add_vehicle_features(df: DataFrame) -> DataFrame:
    """C8, F4, F5."""
    df = df.withColumn("veh_type", X.norm_vehicle("veh_type"))
    return df.withColumns({
        "is_heavy_vehicle": X.is_heavy("veh_type").cast("long"),
        "veh_category": X.vehicle_category("veh_type"),
    })


def add_resolution(df: DataFrame, cap_q: float = 0.99, floor: float | None = 0.0,
                   exact: bool = True, cap_from: DataFrame | None = None,
                   accuracy: int = 100_000) -> DataFrame:
    """Resolution minutes, P``cap_q`` cap (and floor), open flag.

    The cap is a scalar subquery over ``cap_from`` (default: ``df``).
    ``exact`` gives the interpolated percentile of the original
    (``quantiles.exact_quantiles``: sketch bracket + ranking of the few rows
    inside it, no global value map); ``exact=False`` uses the sketch alone.
    """
    res = X.minutes_between("start_datetime", "closed_datetime")
    df = df.withColumn("resolution_minutes", res)
    src = (cap_from if cap_from is not None else df)
    if "resolution_minutes" not in src.columns:
        src = src.withColumn("resolution_minutes", res)
    if exact:
        cap = exact_quantiles(src, "resolution_minutes", [cap_q]).select("q0").scalar()
    else:
        cap = src.select(F.percentile_approx("resolution_minutes", cap_q, accuracy).cast("double")).scalar()
    capped = F.least(F.col("resolution_minutes"), cap)
    if floor is not None:
        capped = F.greatest(capped, F.lit(float(floor)))
    # least/greatest skip nulls; an open incident must stay null
    capped = F.when(F.col("resolution_minutes").isNotNull(), capped)
    return df.withColumns({
        "resolution_minutes_capped": capped,
        "is_open": F.col("resolution_minutes").isNull().cast("long"),
    })


def add_severity(df: DataFrame) -> DataFrame:
    """F9."""
    return df.withColumn("congestion_severity",
                         X.severity("priority", "requires_road_closure"))


def corridor_risk(df: DataFrame, as_of=None, ts: str = "start_local") -> DataFrame:
    """High-priority count per corridor, min-max normalised to [0, 1].

    ``as_of`` restricts the counts to incidents before that local time
    (point-in-time safe); default is the full table, as in the original.
    The min/max run over the per-corridor aggregate (one row per corridor).
    """
    src = df if as_of is None else df.where(F.col(ts) < F.lit(as_of).cast("timestamp_ntz"))
    high = (src.where(F.col("priority") == "High")
               .groupBy("corridor").agg(F.count(F.lit(1)).alias("high_count")))
    everything = Window.partitionBy()
    lo, hi = F.min("high_count").over(everything), F.max("high_count").over(everything)
    risk = F.coalesce(F.try_divide((F.col("high_count") - lo).cast("double"), (hi - lo).cast("double")),
                      F.lit(0.0))
    return high.select("corridor", "high_count", risk.alias("corridor_risk_score"))


def add_corridor_risk(df: DataFrame, risk: DataFrame) -> DataFrame:
    """Left join the risk, 0 where a corridor has no High incident."""
    out = lookup_join(df, risk.select("corridor", "corridor_risk_score"), on="corridor")
    return out.withColumn("corridor_risk_score", F.coalesce("corridor_risk_score", F.lit(0.0)))


# Columns that need an aggregate of the whole table before a row can be made.
DERIVED = ("resolution_minutes_capped", "zone", "corridor_risk_score")


def clean_incidents(raw: DataFrame, tz: str = K.LOCAL_TZ, cap_q: float = 0.99,
                    floor: float | None = 0.0, exact: bool = True, risk_as_of=None, derived=DERIVED,
                    timed: bool = True) -> DataFrame:
    """Raw incident rows -> the engineered incident table.

    Order follows the original training script: sentinels, timestamps,
    resolution (P99 over all rows), defaults, zone imputation, vehicle,
    causes, noise drop, time features, severity, corridor risk.  The three
    aggregates (P99, modal zone per station, High count per corridor) read
    the cheap ``base`` projection, so each is a column-pruned scan with a
    map-side partial aggregate, not a re-run of the whole pipeline.  They run
    when the table is built; ``derived`` names those columns that are wanted
    (the others are left out, ``zone`` as it came in).  Without ``timed`` the
    wall-clock columns are left to a later ``add_time_features``.
    """
    base = C.to_local(C.parse_ts(C.null_sentinels(raw)), "start_datetime", "start_local", tz)
    if "resolution_minutes_capped" in derived:
        df = add_resolution(base, cap_q=cap_q, floor=floor, exact=exact, cap_from=base)
    else:
        minutes = X.minutes_between("start_datetime", "closed_datetime")
        df = base.withColumns({"resolution_minutes": minutes, "is_open": minutes.isNull().cast("long")})
    df = C.fill_defaults(df)
    if "zone" in derived:
        df = C.impute_mode(df, "zone", "police_station", K.DEFAULT_ZONE,
                           modal=C.zone_by_station(base, "zone", "police_station"))
    df = add_vehicle_features(df)
    df = C.normalise_causes(df)
    df = C.drop_noise(df)
    if timed:
        df = add_time_features(df, "start_local")
    df = add_severity(df)
    if "corridor_risk_score" not in derived:
        return df
    risk_src = C.drop_noise(C.normalise_causes(C.fill_defaults(base)))
    return add_corridor_risk(df, corridor_risk(risk_src, as_of=risk_as_of))


def map_feed(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Map points of all incidents with coordinates, with their severity and size.

    ``limit`` keeps the lowest ids, for a caller that draws only so many.
    """
    risk = F.coalesce("corridor_risk_score", F.lit(0.0))
    pts = (df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
             .select("id", "latitude", "longitude", "corridor", "event_cause", "congestion_severity",
                     F.upper("congestion_severity").alias("severity_label"), risk.alias("corridor_risk_score"),
                     (F.greatest(risk, F.lit(0.1)) * 15 + 5).alias("point_size")))
    total = pts.select(F.count(F.lit(1))).scalar()      # all mappable incidents, not just shown
    pts = pts.withColumn("n_points", total)
    return pts.orderBy("id").limit(limit) if limit else pts
