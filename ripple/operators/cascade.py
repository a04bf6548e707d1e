"""Cascade labels and look-back features.

Both are per-corridor time-range windows.  Partitioning by corridor alone
would put a hot corridor (the catch-all corridor holds ~40% of incidents)
into one task, and AQE does not split window partitions.  So rows are
partitioned by ``(corridor, time bucket)`` instead: a row near a bucket edge
is also copied into the neighbouring bucket as a *helper* (it is counted in
frames there but never emitted).  With buckets at least as wide as the
longest window every RANGE frame of a native row is complete inside its own
partition, so the counts are exact and the work spreads over
``corridors x buckets`` tasks with one shuffle.  A frame's count is a
difference of two running totals, so a partition costs its sort and a few passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators.joins import lookup_join

MICROS_PER_MINUTE = 60_000_000
NULL_SPREAD = 512          # null-timestamp rows are spread over this many tasks


def _bucketed(df: DataFrame, ts: str, key: str, forward_us: int, backward_us: int,
              bucket_us: int | None) -> DataFrame:
    """Rows tagged with ``_us``, ``_part`` (partition key) and ``_native``.

    A row is copied into bucket ``b-1`` when rows there may count it in a
    forward frame, and into ``b+1`` for backward frames.
    """
    widest = max(forward_us, backward_us, 1)
    B = bucket_us or 4 * widest
    if B < widest:
        raise ValueError("bucket must be at least as wide as the widest window")
    us = X.epoch_micros(ts)
    df = df.withColumn("_us", us)
    b = F.floor(F.col("_us") / F.lit(B)).cast("long")
    off = F.col("_us") - b * F.lit(B)
    copies = F.array(
        F.struct(b.alias("bkt"), F.lit(True).alias("native")),
        F.when(off < forward_us, F.struct((b - 1).alias("bkt"), F.lit(False).alias("native"))),
        F.when(off >= B - backward_us, F.struct((b + 1).alias("bkt"), F.lit(False).alias("native"))),
    )
    null_part = F.struct(F.pmod(F.xxhash64("id"), F.lit(NULL_SPREAD)).alias("bkt"),
                         F.lit(True).alias("native"))
    copies = F.when(F.col("_us").isNull(), F.array(null_part)).otherwise(
        F.filter(copies, lambda s: s.isNotNull()))
    return (df.withColumn("_copy", F.explode(copies))
              .withColumn("_part", F.col("_copy.bkt"))
              .withColumn("_native", F.col("_copy.native"))
              .withColumn("_nul", F.col("_us").isNull())
              .drop("_copy"))


def _counted(window, lo: int, hi: int, flag: str | None = None):
    """Rows (or the sum of ``flag``) with ``_us`` in ``[t + lo, t + hi]``, as a difference of two running totals.

    A frame with two moving ends is added up anew for each row, which grows with
    the square of a corridor's density; a frame that starts at the first row of
    its partition only ever takes in further rows.
    """
    def upto(end):
        frame = window.rangeBetween(Window.unboundedPreceding, end)
        return F.coalesce(F.sum(flag).over(frame), F.lit(0)) if flag else F.count(F.lit(1)).over(frame)
    return upto(hi) - upto(lo - 1)


def cascade_features(df: DataFrame, follow_minutes: int = K.FOLLOW_MINUTES,
                     min_followers: int = K.MIN_FOLLOWERS,
                     lookback_hours=K.LOOKBACK_HOURS, seed_hours: int = K.SEED_LOOKBACK_HOURS,
                     seed_causes=K.SEED_CAUSES, ts: str = "start_datetime",
                     key: str = "corridor", bucket_minutes: int | None = None,
                     with_density: bool = True) -> DataFrame:
    """K1-K5 in one pass (one shuffle on ``(corridor, bucket)``).

    * ``secondary_count``: incidents on the same named corridor in
      ``(t, t + follow]``; ``is_cascade_seed`` when >= ``min_followers``.
    * ``corridor_events_{h}h``: earlier incidents of the corridor with
      ``ts >= t - h``, where "earlier" is the time order with ``id`` breaking
      ties (equal to a sorted-search on the time-sorted table).
    * ``seed_event_present_3h``: a seed-type cause among those rows.
    * ``cascade_density``: ``corridor_events_2h`` / corridor total.
    Rows without a timestamp get 0 for every count.
    """
    f_us = follow_minutes * MICROS_PER_MINUTE
    back = {h: h * 60 * MICROS_PER_MINUTE for h in lookback_hours}
    s_us = seed_hours * 60 * MICROS_PER_MINUTE
    bucket_us = bucket_minutes * MICROS_PER_MINUTE if bucket_minutes else None
    flag = F.coalesce(F.col("event_cause_grouped").isin(*seed_causes), F.lit(False)).cast("long")
    base = df.withColumn("_seedflag", flag)
    t = _bucketed(base, ts, key, f_us, max(list(back.values()) + [s_us]), bucket_us)

    w = Window.partitionBy(key, "_nul", "_part").orderBy("_us")
    peers = Window.partitionBy(key, "_nul", "_part", "_us").orderBy("id")
    cols = {"_follow": _counted(w, 1, f_us)}
    for h, us in back.items():
        cols[f"_back_{h}"] = _counted(w, -us, -1)
    cols["_seed_back"] = _counted(w, -s_us, -1, "_seedflag")
    t = t.withColumns(cols).withColumns({
        "_peer_rank": F.row_number().over(peers) - 1,
        "_peer_seed": F.coalesce(F.sum("_seedflag").over(
            peers.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    has_ts = F.col("_us").isNotNull()
    out = t.where("_native").withColumns({
        "secondary_count": F.when(has_ts & X.is_named_corridor(key), F.col("_follow"))
                            .otherwise(F.lit(0)).cast("long"),
        **{f"corridor_events_{h}h": F.when(has_ts, F.col(f"_back_{h}") + F.col("_peer_rank"))
           .otherwise(F.lit(0)).cast("long") for h in back},
        "seed_event_present_3h": F.when(
            has_ts, ((F.col("_seed_back") + F.col("_peer_seed")) > 0).cast("long"))
            .otherwise(F.lit(0)).cast("long"),
    }).withColumn("is_cascade_seed", F.col("secondary_count") >= min_followers)
    out = out.drop(*[c for c in out.columns if c.startswith("_")])
    if with_density and 2 in back:
        out = add_cascade_density(out, df, key)
    return out


def corridor_totals(df: DataFrame, key: str = "corridor") -> DataFrame:
    """Incidents per corridor (map-side partial count, then one row per key)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("corridor_total"))


def add_cascade_density(df: DataFrame, source: DataFrame, key: str = "corridor") -> DataFrame:
    """K5: 2 h look-back count over the corridor's total incident count."""
    out = lookup_join(df, corridor_totals(source, key), on=key)
    return (out.withColumn("cascade_density",
                           F.coalesce(F.try_divide(F.col("corridor_events_2h").cast("double"),
                                                   F.col("corridor_total").cast("double")), F.lit(0.0)))
               .drop("corridor_total"))


def follow_count(df: DataFrame, minutes: int = K.FOLLOW_MINUTES,
                 min_followers: int = K.MIN_FOLLOWERS, ts: str = "start_datetime",
                 key: str = "corridor", bucket_minutes: int | None = None) -> DataFrame:
    """K1/K2 on named corridors only (the labelling step by itself)."""
    named = df.where(X.is_named_corridor(key))
    f_us = minutes * MICROS_PER_MINUTE
    bucket_us = bucket_minutes * MICROS_PER_MINUTE if bucket_minutes else None
    t = _bucketed(named, ts, key, f_us, 0, bucket_us)
    w = Window.partitionBy(key, "_nul", "_part").orderBy("_us")
    t = t.withColumn("_follow", _counted(w, 1, f_us))
    out = (t.where("_native")
            .withColumn("secondary_count",
                        F.when(F.col("_us").isNotNull(), F.col("_follow")).otherwise(F.lit(0)).cast("long"))
            .withColumn("is_cascade_seed", F.col("secondary_count") >= min_followers))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def cascade_pairs(df: DataFrame, minutes: int = K.FOLLOW_MINUTES, ts: str = "start_datetime",
                  key: str = "corridor", bucket_minutes: int | None = None) -> DataFrame:
    """(seed, follower) pairs with ``seed < follower <= seed + W`` per corridor.

    An equi-join on ``(corridor, bucket)`` with buckets W wide: each follower
    is also offered to the previous bucket when it lies within W of the
    bucket start, so a seed only meets followers less than 2 W after it (the
    candidates are a constant factor of the output, never a whole corridor),
    and AQE's skew join splits a hot bucket.
    """
    f_us = minutes * MICROS_PER_MINUTE
    B = (bucket_minutes * MICROS_PER_MINUTE) if bucket_minutes else f_us
    if B < f_us:
        raise ValueError("bucket must be at least the window width")
    named = df.where(X.is_named_corridor(key) & F.col(ts).isNotNull()) \
              .select("id", key, ts).withColumn("_us", X.epoch_micros(ts))
    bkt = F.floor(F.col("_us") / F.lit(B)).cast("long")
    seeds = named.select(F.col("id").alias("seed_id"), key, F.col(ts).alias("seed_ts"),
                         F.col("_us").alias("_s_us"), bkt.alias("_bkt"))
    off = F.col("_us") - bkt * F.lit(B)
    follows = named.select(
        F.col("id").alias("follow_id"), key, F.col(ts).alias("follow_ts"),
        F.col("_us").alias("_f_us"),
        F.explode(F.filter(F.array(bkt, F.when(off < f_us, bkt - 1)), lambda x: x.isNotNull()))
         .alias("_bkt"))
    pairs = seeds.join(follows, on=[key, "_bkt"]).where(
        (F.col("_f_us") > F.col("_s_us")) & (F.col("_f_us") <= F.col("_s_us") + f_us))
    return pairs.select(key, "seed_id", "seed_ts", "follow_id", "follow_ts",
                        ((F.col("_f_us") - F.col("_s_us")) / F.lit(float(MICROS_PER_MINUTE)))
                        .alias("gap_minutes"))
