"""Descriptive aggregates (A1-A20) and cascade reports.

Each report is one aggregate query; grouped aggregates use Spark's
partial (map-side) aggregation, so a hot key is combined inside each task
before the shuffle.  Top-k reports use a total order (value, then key) so
the cut is deterministic.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators.quantiles import exact_quantiles


def _n():
    return F.count(F.lit(1))


def value_counts(df: DataFrame, col: str, n: int | None = None, pct: bool = False,
                 dropna: bool = True) -> DataFrame:
    """Count per value, most frequent first (ties by value)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(_n().alias("n"))
    if pct:
        total = F.sum("n").over(Window.partitionBy())      # over the per-value aggregate
        out = out.withColumn("pct", F.col("n").cast("double") * F.lit(100.0) / total.cast("double"))
    out = out.orderBy(F.col("n").desc(), F.col(col).asc_nulls_first())
    return out.limit(n) if n else out


def resolution_by_cause(raw: DataFrame, lo: float = 0.0, hi: float = K.REPORT_RESOLUTION_MAX) -> DataFrame:
    """A3: per raw cause: mean, upper median (``sorted[n // 2]``) and n of
    resolution minutes computed on second-truncated timestamps, ``lo < d < hi``."""
    s = F.date_trunc("second", F.col("start_datetime")).cast("timestamp_ntz")
    e = F.date_trunc("second", F.col("closed_datetime")).cast("timestamp_ntz")
    d = raw.select("event_cause", (F.timestamp_diff("SECOND", s, e) / F.lit(60.0)).alias("d")) \
           .where((F.col("d") > lo) & (F.col("d") < hi))
    means = d.groupBy("event_cause").agg(F.avg("d").alias("avg_minutes"))
    med = exact_quantiles(d, "d", [0.5], ["event_cause"], method="upper", prefix="upper_median_minutes")
    out = means.join(med.withColumnRenamed("upper_median_minutes0", "upper_median_minutes"),
                     means["event_cause"].eqNullSafe(med["event_cause"])).drop(med["event_cause"])
    return out.select("event_cause", "avg_minutes", "upper_median_minutes", "n") \
              .orderBy(F.col("avg_minutes").desc(), F.col("event_cause").asc_nulls_first())


def by_hour(df: DataFrame, dense: bool = True, col: str = "hour_of_day") -> DataFrame:
    """A4: incidents per local hour; ``dense`` adds zero rows for empty hours."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(_n().alias("n"))
    if not dense:
        return counts
    spine = df.sparkSession.range(24).select(F.col("id").alias(col))
    return (spine.join(F.broadcast(counts), on=col, how="left")
                 .select(col, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def by_day(df: DataFrame) -> DataFrame:
    """A5: incidents per day name."""
    return df.where(F.col("day_name").isNotNull()).groupBy("day_name").agg(_n().alias("n"))


def high_share(df: DataFrame, n: int | None = 10) -> DataFrame:
    """High-priority count, total and share per named corridor, top ``n`` by High."""
    out = (df.where(X.is_named_corridor("corridor"))
             .groupBy("corridor")
             .agg(F.count_if(F.col("priority") == "High").alias("high"), _n().alias("total"))
             .withColumn("high_pct", F.col("high").cast("double") * F.lit(100.0) / F.col("total")))
    out = out.orderBy(F.col("high").desc(), F.col("corridor"))
    return out.limit(n) if n else out


def hot_corridor_days(df: DataFrame, min_events: int = 5, top: int = 3,
                      n: int | None = 10) -> DataFrame:
    """Corridor-days with >= ``min_events`` incidents and their top causes."""
    named = df.where(X.is_named_corridor("corridor") & F.col("date").isNotNull())
    by_cause = named.groupBy("corridor", "date", "event_cause").agg(_n().alias("k"))
    w = Window.partitionBy("corridor", "date")
    ranked = by_cause.withColumns({
        "n_events": F.sum("k").over(w),
        "_r": F.row_number().over(w.orderBy(F.col("k").desc(), F.col("event_cause"))),
    }).where((F.col("n_events") >= min_events) & (F.col("_r") <= top))
    out = ranked.groupBy("corridor", "date", "n_events").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "event_cause", "k"))),
            lambda s: F.concat(s["event_cause"], F.lit(":"), s["k"].cast("string"))), ", ")
        .alias("top_causes"))
    out = out.orderBy(F.col("n_events").desc(), "corridor", "date")
    return out.limit(n) if n else out


def closure_share(df: DataFrame) -> DataFrame:
    """Share of incidents needing a road closure."""
    return df.agg(F.count_if("requires_road_closure").alias("closures"), _n().alias("total")) \
             .withColumn("closure_pct", F.col("closures").cast("double") * F.lit(100.0) / F.col("total"))


def closures_by_cause(df: DataFrame) -> DataFrame:
    """Closures per cause."""
    return df.where("requires_road_closure").groupBy("event_cause").agg(_n().alias("closures"))


def summary(df: DataFrame) -> DataFrame:
    """One-row summary: resolution mean/median/P99, valid and open counts,
    flag sums and rates."""
    r = F.col("resolution_minutes")
    q = exact_quantiles(df, "resolution_minutes", [0.5, 0.99]) \
        .select(F.struct("q0", "q1")).scalar()
    return df.agg(
        _n().alias("n_rows"),
        F.avg(r).alias("mean_resolution"),
        F.count(r).alias("n_valid"),
        F.sum("is_open").alias("n_open"),
        F.sum("is_peak_hour").alias("n_peak"),
        F.avg("is_peak_hour").alias("peak_rate"),
        F.sum("is_weekend").alias("n_weekend"),
        F.avg("is_weekend").alias("weekend_rate"),
        F.sum("is_heavy_vehicle").alias("n_heavy"),
        F.avg("is_heavy_vehicle").alias("heavy_rate"),
    ).withColumns({"median_resolution": q["q0"], "p99_resolution": q["q1"]})


def top_corridors(df: DataFrame, n: int | None = 10) -> DataFrame:
    """A10: named corridors by incident count, with their risk score."""
    out = (df.where(X.is_named_corridor("corridor"))
             .groupBy("corridor")
             .agg(_n().alias("n"), F.max("corridor_risk_score").alias("corridor_risk_score")))
    out = out.orderBy(F.col("n").desc(), "corridor")
    return out.limit(n) if n else out


def heatmap(df: DataFrame, severity: str | None = None) -> DataFrame:
    """Dense 7 x 24 day-by-hour counts (optionally one severity)."""
    src = df if severity is None else df.where(F.col("congestion_severity") == severity)
    src = src.where(F.col("day_of_week").isNotNull())
    counts = (src.groupBy("day_of_week")
                 .pivot("hour_of_day", list(range(24)))
                 .agg(_n()))
    spark = df.sparkSession
    names = F.element_at(F.array(*[F.lit(d) for d in K.DAY_NAMES]), (F.col("day_of_week") + 1).cast("int"))
    spine = spark.range(7).select(F.col("id").alias("day_of_week")).withColumn("day_name", names)
    out = spine.join(F.broadcast(counts), on="day_of_week", how="left")
    return out.select("day_of_week", "day_name",
                      *[F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}")
                        for h in range(24)])


def resolution_quantiles(df: DataFrame, col: str = "resolution_minutes_capped",
                         exclude=(K.DEFAULT_CAUSE,)) -> DataFrame:
    """Five-number summary per grouped cause, median descending."""
    src = df.where(F.col(col).isNotNull() & ~F.col("event_cause_grouped").isin(*exclude))
    out = exact_quantiles(src, col, (0.0, 0.25, 0.5, 0.75, 1.0), ["event_cause_grouped"])
    return out.select("event_cause_grouped", "n",
                      *[F.col(f"q{i}").alias(a) for i, a in
                        enumerate(("q_min", "q1", "median", "q3", "q_max"))]) \
              .orderBy(F.col("median").desc(), "event_cause_grouped")


def period_kpis(df: DataFrame, lo: float = 0.0, hi: float = K.VALID_RESOLUTION_MAX) -> DataFrame:
    """Events, seeds, distinct corridors with a seed, mean valid resolution."""
    r = F.col("resolution_minutes")
    return df.agg(
        _n().alias("events"),
        F.count_if("is_cascade_seed").alias("seeds"),
        F.count_distinct(F.when(F.col("is_cascade_seed"), F.col("corridor"))).alias("corridors_at_risk"),
        F.avg(F.when((r > lo) & (r <= hi), r)).alias("avg_resolution"),
    )


def bounds(df: DataFrame) -> DataFrame:
    """First and last local date, number of named corridors and causes."""
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                  F.count_distinct(F.when(X.is_named_corridor("corridor"), F.col("corridor")))
                  .alias("n_corridors"),
                  F.count_distinct("event_cause_grouped").alias("n_causes"))


def distinct_values(df: DataFrame, col: str, named_only: bool = False) -> DataFrame:
    """Sorted distinct values of a column."""
    src = df.where(X.is_named_corridor(col)) if named_only else df.where(F.col(col).isNotNull())
    return src.select(col).distinct().orderBy(col)


def corridor_profile(df: DataFrame) -> DataFrame:
    """Modal zone, modal station and mean risk per named corridor.

    The risk score is one value per corridor, so its mean is taken as ``max``
    (exact; a double ``avg`` would depend on the summation order).
    """
    return (df.where(X.is_named_corridor("corridor"))
              .groupBy("corridor")
              .agg(F.mode("zone", deterministic=True).alias("typical_zone"),
                   F.mode("police_station", deterministic=True).alias("typical_station"),
                   F.max("corridor_risk_score").alias("typical_risk")))


def slot_intensity(df: DataFrame, hours=(2, 6)) -> DataFrame:
    """Typical incidents per (corridor, weekday, hour) slot.

    For hour ``h`` and width ``k``: the ceiling of the mean, over dates with
    any, of the daily count of incidents of that weekday with hour in
    ``[max(0, h - k), h]``.  A day of a corridor is one row with its 24 hourly
    counts, all widths are sums inside that row, and one aggregate over the days
    gives every slot.
    """
    src = df.where(X.is_named_corridor("corridor") & F.col("hour_of_day").isNotNull())
    day = src.groupBy("corridor", "day_of_week", "date").agg(
        *(F.count_if(F.col("hour_of_day") == h).alias(f"_h{h}") for h in range(24)))
    back = lambda h, k: reduce(add, (F.col(f"_h{i}") for i in range(max(0, h - k), h + 1)))
    slots = F.array(*(F.struct(*(back(h, k).alias(f"k{k}") for k in hours)) for h in range(24)))
    each = day.select("corridor", "day_of_week", F.posexplode(slots).alias("hour", "s")).where(F.col(f"s.k{max(hours)}") > 0)
    mean = lambda k: F.ceil(F.avg(F.when(F.col(f"s.k{k}") > 0, F.col(f"s.k{k}"))))
    return each.groupBy("corridor", "day_of_week", F.col("hour").cast("long").alias("hour")).agg(
        *(F.coalesce(mean(k).cast("long"), F.lit(0).cast("long")).alias(f"events_{k}h") for k in hours))


def seeds_by_corridor(df: DataFrame, keep_empty: bool = True) -> DataFrame:
    """K8: seeds and their secondary incidents per named corridor.

    ``keep_empty`` keeps corridors without any seed (zero counts).
    """
    src = df.where(X.is_named_corridor("corridor"))
    if not keep_empty:
        src = src.where("is_cascade_seed")
    out = src.groupBy("corridor").agg(
        F.count_if("is_cascade_seed").alias("seed_count"),
        F.coalesce(F.sum(F.when(F.col("is_cascade_seed"), F.col("secondary_count"))), F.lit(0))
        .cast("long").alias("total_secondary_events"))
    return out.orderBy(F.col("seed_count").desc(), "corridor")


def seeds_by_cause(df: DataFrame) -> DataFrame:
    """K9: seeds per grouped cause."""
    return (df.where("is_cascade_seed").groupBy("event_cause_grouped")
              .agg(_n().alias("seeds")).orderBy(F.col("seeds").desc(), "event_cause_grouped"))


def cascade_kpis(df: DataFrame) -> DataFrame:
    """Seeds, secondary incidents, worst cascade (and where/when/why),
    mean followers per seed, corridors affected."""
    s = df.where("is_cascade_seed")
    worst = F.max_by(F.struct("corridor", "date", "event_cause_grouped", "id"),
                     F.struct(F.col("secondary_count"), -F.col("id")))
    return s.agg(
        _n().alias("seeds"),
        F.coalesce(F.sum("secondary_count"), F.lit(0)).cast("long").alias("secondary_events"),
        F.max("secondary_count").alias("worst_cascade"),
        worst.alias("_w"),
        F.avg("secondary_count").alias("mean_per_seed"),
        F.count_distinct("corridor").alias("affected_corridors"),
    ).select("seeds", "secondary_events", "worst_cascade",
             F.col("_w.corridor").alias("worst_corridor"), F.col("_w.date").alias("worst_date"),
             F.col("_w.event_cause_grouped").alias("worst_cause"), "mean_per_seed",
             "affected_corridors")


def time_split(df: DataFrame, cutoff: str = K.SPLIT_CUTOFF, ts: str = "start_local"):
    """train = before ``cutoff`` (local) or no timestamp; test = the rest."""
    is_train = F.col(ts).isNull() | (F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    return df.where(is_train), df.where(~is_train)


def split_summary(df: DataFrame, cutoff: str = K.SPLIT_CUTOFF, ts: str = "start_local") -> DataFrame:
    """K11 as a table: rows and seed share on each side of the split."""
    side = F.when(F.col(ts).isNull() | (F.col(ts) < F.lit(cutoff).cast("timestamp_ntz")),
                  F.lit("train")).otherwise(F.lit("test"))
    return df.groupBy(side.alias("split")).agg(
        _n().alias("n"), F.count_if("is_cascade_seed").alias("seeds"),
        F.avg(F.col("is_cascade_seed").cast("double")).alias("seed_rate"))


def replay_slice(df: DataFrame, date=None, corridor=None, hour: int = 24) -> DataFrame:
    """Incidents of corridor-days in time order, cut at local hour <= ``hour``.

    Without ``date``/``corridor`` every corridor-day is replayed at once and
    ``seq`` is the position inside its own slice.
    """
    src = df.where(F.col("start_local").isNotNull() & (F.col("hour_of_day") <= hour))
    if date is not None:
        src = src.where(F.col("date") == F.lit(date).cast("date"))
    if corridor is not None:
        src = src.where(F.col("corridor") == corridor)
    from ripple.operators.prefix import blocked_rank, hour_block
    src = src.select("corridor", "date", "id", "start_local", "clock", "event_cause_grouped",
                     "priority", "requires_road_closure")
    return blocked_rank(src, ["corridor", "date"], hour_block("start_local"), ["start_local", "id"])
