"""End-to-end flows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators import cascade, clean, decisions, features
from ripple.sources import adapter

# Columns of the engineered incident table.
ENGINEERED_COLUMNS = (
    "id", "start_datetime", "closed_datetime", "start_local", "corridor", "zone",
    "police_station", "priority", "requires_road_closure", "event_cause",
    "event_cause_grouped", "veh_type", "is_heavy_vehicle", "veh_category", "status",
    "latitude", "longitude", "hour_of_day", "day_of_week", "day_name", "month",
    "month_name", "date", "is_weekend", "is_peak_hour", "hour_fraction", "date_str",
    "time_label", "clock", "resolution_minutes", "resolution_minutes_capped", "is_open",
    "congestion_severity", "corridor_risk_score",
)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.incidents(spark, sf_dir)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incidents -> cleaned, feature-engineered table."""
    return features.clean_incidents(raw(spark, sf_dir)).select(*ENGINEERED_COLUMNS)


def light(spark: SparkSession, sf_dir: str, *derived: str) -> DataFrame:
    """The engineered table without the columns that need an aggregate first, but for those named."""
    out = [c for c in ENGINEERED_COLUMNS if c not in features.DERIVED or c in derived]
    return features.clean_incidents(raw(spark, sf_dir), derived=derived).select(*out)


def label_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light cleaning the labelling step needs (no imputation joins)."""
    df = clean.parse_ts(clean.null_sentinels(raw(spark, sf_dir)))
    df = clean.fill_defaults(df)
    df = clean.normalise_causes(df)
    return clean.drop_noise(df)


def labelled(spark: SparkSession, sf_dir: str, derived=features.DERIVED, **kw) -> DataFrame:
    """Engineered table (with the ``derived`` columns named) + cascade label + look-back features (K1-K5)."""
    out = [c for c in ENGINEERED_COLUMNS if c not in features.DERIVED or c in derived]
    # the wall-clock columns come after the windows: they aren't shuffled, and all columns in one
    # generated method are more code than the JVM compiles
    df = features.clean_incidents(raw(spark, sf_dir), derived=derived, timed=False)
    lab = cascade.cascade_features(df.select(*(c for c in out if c in df.columns)), **kw)
    added = [c for c in lab.columns if c not in out]
    return features.add_time_features(lab, "start_local").select(*out, *added)


def dashboard_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered table (without derived columns) labelled with the dashboard's seed rule (130 min, >= 4)."""
    return seed_flags(light(spark, sf_dir), K.DASHBOARD_FOLLOW_MINUTES, K.DASHBOARD_MIN_FOLLOWERS)


def scored_standin(spark: SparkSession, sf_dir: str, derived=("zone", "corridor_risk_score")) -> DataFrame:
    """Labelled table with the stand-in score; nothing behind it names the capped resolution times."""
    return decisions.standin_score(labelled(spark, sf_dir, derived))


def alerts_standin(spark: SparkSession, sf_dir: str, threshold: float = 0.10) -> DataFrame:
    """Replay of every corridor-day at once -> alerts (stand-in score)."""
    return decisions.build_alerts(scored_standin(spark, sf_dir), threshold=threshold)


def plan_standin(spark: SparkSession, sf_dir: str, threshold: float = 0.10) -> DataFrame:
    return decisions.allocate(alerts_standin(spark, sf_dir, threshold))


def seed_flags(df: DataFrame, minutes: int = K.FOLLOW_MINUTES,
               min_followers: int = K.MIN_FOLLOWERS) -> DataFrame:
    """Follow-on counts for every row (0 off named corridors)."""
    lab = cascade.follow_count(df, minutes, min_followers)
    rest = df.where(~X.is_named_corridor("corridor")).withColumns(
        {"secondary_count": F.lit(0).cast("long"), "is_cascade_seed": F.lit(False)})
    return lab.unionByName(rest)
