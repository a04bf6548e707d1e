"""Model metrics (M3, M4, M9) and the what-if scenario grid.

Threshold sweeps never join rows with a threshold grid: each row gets the
number of thresholds its score passes (a column expression), rows are
counted per ``(bucket, label)`` (a handful of groups, combined map-side),
and a reverse running sum over those few groups gives every threshold's
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X

COARSE_PCT = tuple(range(10, 100, 10))     # 0.1 .. 0.9, 9 points
FINE_PCT = tuple(range(10, 91))            # 0.10 .. 0.90, 81 points


def threshold_sweep(scored: DataFrame, score: str = "risk_pct", label: str = "is_cascade_seed",
                    thresholds=COARSE_PCT, scale: float = 100.0) -> DataFrame:
    """M3: precision and recall at each threshold (``score >= t`` predicts 1)."""
    ts = sorted(thresholds)
    passed = None
    for t in ts:
        term = F.when(F.col(score) >= F.lit(t), 1).otherwise(0)
        passed = term if passed is None else passed + term
    counts = (scored.select(passed.alias("k"), F.coalesce(F.col(label).cast("boolean"), F.lit(False)).alias("y"))
                    .groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")))
    spark = scored.sparkSession
    thr = F.element_at(F.array(*[F.lit(t) for t in ts]), F.col("k").cast("int"))
    # k = 0 .. len(ts); k = 0 (below every threshold) only feeds the positives total
    spine = spark.range(0, len(ts) + 1).select(F.col("id").alias("k"))
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (spine.join(F.broadcast(counts), "k", "left").fillna(0, ["n", "pos"])
                .withColumns({"tp": F.sum("pos").over(w).cast("long"),
                              "predicted": F.sum("n").over(w).cast("long"),
                              "positives": F.sum("pos").over(Window.partitionBy()).cast("long")})
                .where(F.col("k") >= 1))
    return out.select(
        (thr.cast("double") / F.lit(scale)).alias("threshold"), "tp", "predicted",
        F.when(F.col("predicted") > 0, F.col("tp").cast("double") / F.col("predicted"))
         .otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("positives") > 0, F.col("tp").cast("double") / F.col("positives").cast("double"))
         .otherwise(F.lit(0.0)).alias("recall"))


def choose_threshold(scored: DataFrame, score: str = "risk_pct", label: str = "is_cascade_seed",
                     coarse=COARSE_PCT, fine=FINE_PCT, scale: float = 100.0,
                     target: float = K.RECALL_TARGET) -> DataFrame:
    """M3 rule: the lowest coarse threshold whose recall reaches ``target``;
    otherwise the fine-grid threshold with recall closest to it (ties -> lowest)."""
    grid = sorted(set(coarse) | set(fine))
    sw = threshold_sweep(scored, score, label, grid, scale)
    coarse_set = F.array(*[F.lit(t / scale) for t in coarse])
    ok = F.array_contains(coarse_set, F.col("threshold")) & (F.col("recall") >= target)
    ranked = sw.where(F.array_contains(coarse_set, F.col("threshold"))
                      | F.array_contains(F.array(*[F.lit(t / scale) for t in fine]), F.col("threshold")))
    return (ranked.withColumn("_rule", F.when(ok, 0).otherwise(1))
                  .orderBy("_rule", F.when(ok, F.col("threshold")),
                           F.abs(F.col("recall") - target), "threshold")
                  .limit(1)
                  .select(F.col("threshold").alias("chosen_threshold"), "recall"))


def confusion(scored: DataFrame, threshold: float, prob: str = "cascade_probability",
              label: str = "is_cascade_seed") -> DataFrame:
    """M4: confusion matrix as (label, prediction, n)."""
    return (scored.select(F.col(label).cast("long").alias("label"),
                          (F.col(prob) >= threshold).cast("long").alias("prediction"))
                  .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))


def class_report(scored: DataFrame, threshold: float, prob: str = "cascade_probability",
                 label: str = "is_cascade_seed", classes=(0, 1)) -> DataFrame:
    """M4: per-class precision, recall, F1 and support (undefined -> 0)."""
    y = F.col(label).cast("long")
    p = (F.col(prob) >= threshold).cast("long")
    aggs = []
    for c in classes:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"pp{c}"),
                 F.count_if(y == c).alias(f"sup{c}")]
    wide = scored.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("class"), F.col(f"tp{c}").alias("tp"),
                                        F.col(f"pp{c}").alias("pp"), F.col(f"sup{c}").alias("support"))
                               for c in classes])).alias("r")
    return per_class_scores(wide.select(rows).select("r.*"))


def per_class_scores(t: DataFrame) -> DataFrame:
    """precision / recall / F1 from per-class tp, predicted and support counts."""
    return t.select(
        "class",
        F.when(F.col("pp") > 0, F.col("tp").cast("double") / F.col("pp")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp").cast("double") / F.col("support")).otherwise(0.0)
         .alias("recall"),
        F.when(F.col("pp") + F.col("support") > 0,
               (F.col("tp") * 2).cast("double") / (F.col("pp") + F.col("support")).cast("double"))
         .otherwise(0.0).alias("f1"),
        F.col("support").cast("long").alias("support"))


def regression_errors(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """M9: n, MAE and RMSE."""
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                  F.sqrt(F.avg(e * e)).alias("rmse"))


def scenario_grid(eng: DataFrame, hours=(2, 6)) -> DataFrame:
    """M12 inputs + stand-in score for every corridor x weekday x hour x cause.

    The grid is generated by exploding sequences per corridor row (no cross
    join); the history features are the slot intensities (A20) joined on
    ``(corridor, weekday, hour)``.
    """
    from ripple.operators import decisions, reports
    named = eng.where(X.is_named_corridor("corridor"))
    # one risk value per corridor: its mean is its max (exact, order-free)
    prof = named.groupBy("corridor").agg(F.max("corridor_risk_score").alias("corridor_risk_score"))
    # the cause vocabulary (a handful of values; partial sets are merged map-side)
    causes = eng.select(F.array_sort(F.collect_set("event_cause_grouped"))).scalar()
    grid = (prof.select("corridor", "corridor_risk_score",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("day_of_week"))
                .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
                .select("*", F.explode(causes).alias("cause")))
    slots = reports.slot_intensity(eng, hours)
    g = grid.join(slots, ["corridor", "day_of_week", "hour"], "left").fillna(0, ["events_2h", "events_6h"])
    g = g.withColumnsRenamed({"events_2h": "corridor_events_2h", "events_6h": "corridor_events_6h"})
    g = decisions.whatif_flags(g, "cause").withColumn("is_peak_hour", X.is_peak("hour").cast("long"))
    return decisions.standin_score(g)
