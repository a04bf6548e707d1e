"""Cleaning: sentinels, timestamps, defaults, imputation, noise.

All functions are ``DataFrame -> DataFrame`` and lazy.  Only the modal
zone (C7) and the P99 cap (F7) need an aggregate; both aggregate with a
map-side partial step before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators.joins import lookup_join

TIMESTAMP_COLS = ("start_datetime", "closed_datetime", "resolved_datetime")


def null_sentinels(df: DataFrame, cols=None, tokens=K.NULL_TOKENS) -> DataFrame:
    """Sentinel text -> NULL in every (or the given) string column."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({col: X.null_token(col, tokens) for col in cols})


def parse_ts(df: DataFrame, cols=TIMESTAMP_COLS, truncate: str | None = None) -> DataFrame:
    """Text (``...+00`` offsets allowed) -> UTC wall clock TIMESTAMP_NTZ.

    An offset of hours only is completed after a clock time; a date alone is
    midnight UTC.  Unparsable text becomes NULL (``try_to_timestamp``; ANSI mode would make
    a plain cast fail).  ``truncate='second'`` drops the fraction.
    """
    tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = {}
    for col in cols:
        if col not in df.columns:
            continue
        dt = df.schema[col].dataType
        if isinstance(dt, T.StringType):
            instant = F.try_to_timestamp(F.regexp_replace(F.trim(F.col(col)), r"(:\d\d(?:\.\d+)?[+-]\d\d)$", "$1:00"))
            v = F.convert_timezone(F.lit(tz), F.lit("UTC"), instant.cast("timestamp_ntz"))
        elif isinstance(dt, T.TimestampType):
            v = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(col).cast("timestamp_ntz"))
        else:
            v = F.col(col).cast("timestamp_ntz")
        if truncate:
            v = F.date_trunc(truncate, v).cast("timestamp_ntz")
        out[col] = v
    return df.withColumns(out)


def to_local(df: DataFrame, ts: str = "start_datetime", out: str = "start_local",
             tz: str = K.LOCAL_TZ) -> DataFrame:
    """UTC -> local wall clock."""
    return df.withColumn(out, X.to_local(ts, tz))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Literal fills and the closure flag."""
    fills = {"corridor": K.DEFAULT_CORRIDOR, "priority": K.DEFAULT_PRIORITY}
    if "junction" in df.columns:
        fills["junction"] = K.DEFAULT_JUNCTION
    df = df.fillna(fills)
    return df.withColumn("requires_road_closure", X.parse_flag("requires_road_closure"))


def zone_by_station(df: DataFrame, target: str = "zone", by: str = "police_station") -> DataFrame:
    """Modal ``target`` per ``by`` key (ties -> smallest value), one row per key."""
    return (df.where(F.col(target).isNotNull() & F.col(by).isNotNull())
              .groupBy(by)
              .agg(F.mode(target, deterministic=True).alias(f"_modal_{target}")))


def impute_mode(df: DataFrame, target: str = "zone", by: str = "police_station",
                default: str | None = K.DEFAULT_ZONE, modal: DataFrame | None = None) -> DataFrame:
    """Fill a null ``target`` with the modal value of its ``by`` group.

    ``modal`` may be precomputed from a cheaper frame with the same rows.
    """
    if modal is None:
        modal = zone_by_station(df, target, by)
    out = lookup_join(df, modal, on=by, how="left")
    filled = F.coalesce(F.col(target), F.col(f"_modal_{target}"))
    if default is not None:
        filled = F.coalesce(filled, F.lit(default))
    return out.withColumn(target, filled).drop(f"_modal_{target}").select(*df.columns)


def normalise_causes(df: DataFrame) -> DataFrame:
    """lower/trim cause (null -> others) and the grouped cause."""
    return (df.withColumn("event_cause", X.norm_cause("event_cause"))
              .withColumn("event_cause_grouped", X.group_cause("event_cause")))


def drop_noise(df: DataFrame, noise: str = K.NOISE_CAUSE) -> DataFrame:
    """Drop test rows; null-safe (a null cause is kept)."""
    return df.where(F.coalesce(F.lower(F.trim(F.col("event_cause"))), F.lit("")) != noise)


def named_corridors(df: DataFrame, col: str = "corridor") -> DataFrame:
    """C11: keep named corridors only."""
    return df.where(X.is_named_corridor(col))


def null_profile(df: DataFrame, cols) -> DataFrame:
    """Null count and percentage per column, one row per column."""
    total = F.count(F.lit(1))
    aggs = [F.sum(F.col(col).isNull().cast("long")).alias(col) for col in cols]
    wide = df.agg(total.alias("_n"), *aggs)
    stack = "stack({}, {}) as (column_name, null_count)".format(
        len(cols), ", ".join(f"'{col}', `{col}`" for col in cols))
    return (wide.selectExpr("_n", stack)
                .select("column_name", F.col("null_count").cast("long").alias("null_count"),
                        F.round(F.try_divide(F.col("null_count") * 100.0, F.col("_n")), 1)
                        .alias("null_pct")))


def valid_resolution(df: DataFrame, lo: float = 0.0, hi: float | None = None,
                     col: str = "resolution_minutes", hi_inclusive: bool = True) -> DataFrame:
    """``lo < x <= hi`` (or ``< hi``); null never passes."""
    cond = F.col(col) > lo
    if hi is not None:
        cond = cond & ((F.col(col) <= hi) if hi_inclusive else (F.col(col) < hi))
    return df.where(cond)


def filter_incidents(df: DataFrame, start=None, end=None, corridors=(), causes=(),
                     date_col: str = "date") -> DataFrame:
    """C14: date range (inclusive) + corridor list + cause list; empty = all."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(date_col) <= F.lit(end).cast("date"))
    if corridors:
        cond = cond & F.col("corridor").isin(*corridors)
    if causes:
        cond = cond & F.col("event_cause_grouped").isin(*causes)
    return df.where(cond)


def profile(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """Row count, column count and parse-success count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("long").alias("n_columns"),
                  F.count(F.col(ts)).alias("n_parsed"))
