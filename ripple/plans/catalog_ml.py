"""Registered model queries (step 5): rows-only checks (no SQL oracle).

Models have the library defaults, the original 300 trees of depth 6.  They are
trained once for each input and kept in a registry in the shared folder; every
query loads them from there (S7, S8).  The registry's key is a fingerprint of
the input's rows and the models' sizes, so a folder that is written anew is trained anew.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.operators import boosting, cascade, decisions, metrics, ml, reports, timeseries
from ripple.operators.joins import checked_small, lookup_join
from ripple.plans import flows
from ripple.plans.catalog import query
from ripple.plans.catalog_reports import DATA_CUTOFF
from ripple.session import checkpoint_dir, scratch_path

COARSE = tuple(round(x, 10) for x in np.linspace(0.1, 0.9, 9))
FINE = tuple(round(x, 10) for x in np.linspace(0.1, 0.9, 81))
# names what the models were trained with: other sizes or another version train anew
VERSION = 3
SETTINGS = f"{zlib.crc32(repr((VERSION, ml.FOLDS, ml.specs(boosting.N_TREES, boosting.DEPTH, boosting.RATE))).encode()):08x}"
_LOADED: dict = {}


@dataclass
class Inputs:
    """The stored tables that models train on and score."""
    labelled: DataFrame
    grid: DataFrame

    @property
    def train(self):
        return reports.time_split(self.labelled, DATA_CUTOFF)[0]

    @property
    def test(self):
        return reports.time_split(self.labelled, DATA_CUTOFF)[1]

    def hours(self, before: bool):
        cut = F.col("hourly_bucket") < F.lit(DATA_CUTOFF).cast("timestamp_ntz")
        return self.grid.where(cut if before else ~cut)


def fingerprint(df: DataFrame) -> str:
    """A name of the rows of ``df``, whatever their order: their number and a sum of their hashes."""
    x = F.xxhash64(*df.columns).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(x)).first()
    return f"{n}-{int(total or 0) % (1 << 64):016x}"


def _stored(path: str, make) -> DataFrame:
    """The table at ``path``; made and written where it isn't there."""
    spark = SparkSession.active()
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def trained(spark, sf) -> tuple[ml.Models, Inputs]:
    """The models of an input folder and its stored tables, from the registry or trained now."""
    path = os.path.join(checkpoint_dir(spark), "models", f"{fingerprint(flows.raw(spark, sf))}-{SETTINGS}")
    key = (spark.sparkContext.applicationId, path)
    if key in _LOADED:
        return _LOADED[key]
    inputs = Inputs(_stored(os.path.join(path, "labelled"), lambda: flows.labelled(spark, sf)),
                    _stored(os.path.join(path, "grid"), lambda: timeseries.add_lags(timeseries.hourly_grid(
                        timeseries.hourly_counts(flows.light(spark, sf))))))
    try:
        models = ml.load_models(path, spark)
    except AnalysisException:                # not trained yet, or not to the end
        enc = ml.fit_encoders(inputs.labelled)
        models = ml.fit_models(inputs.train, inputs.hours(before=True), enc)
        # threshold tuned on the training side (not on the test set)
        choice = _train_choice(models, inputs).first()
        models.seed.threshold = float(choice["chosen_threshold"]) if choice else 0.5
        ml.save_models(models, path, spark)
    _LOADED[key] = models, inputs
    return _LOADED[key]


def _train_choice(models, inputs) -> DataFrame:
    scored = models.seed.score(models.enc.apply(inputs.train))
    return metrics.choose_threshold(scored, "cascade_probability", "is_cascade_seed", COARSE, FINE, 1.0)


def _scored_test(spark, sf):
    models, inputs = trained(spark, sf)
    return ml.score(inputs.test, models, inputs.grid), models


@query("ml_seed_scores")
def q_ml_seed_scores(spark, sf):
    s, _ = _scored_test(spark, sf)
    return s.select("id", "corridor", "is_cascade_seed", "cascade_probability", "predicted_seed")


@query("ml_threshold")
def q_ml_threshold(spark, sf):
    return _train_choice(*trained(spark, sf))


@query("ml_threshold_sweep")
def q_ml_threshold_sweep(spark, sf):
    s, _ = _scored_test(spark, sf)
    return metrics.threshold_sweep(s, "cascade_probability", "is_cascade_seed", COARSE, 1.0)


@query("ml_seed_report")
def q_ml_seed_report(spark, sf):
    s, models = _scored_test(spark, sf)
    return metrics.class_report(s, models.seed.threshold)


@query("ml_seed_importances")
def q_ml_importances(spark, sf):
    models, _ = trained(spark, sf)
    return ml.importances(models)


@query("ml_severity_report")
def q_ml_severity_report(spark, sf):
    models, inputs = trained(spark, sf)
    p = ml.predict_severity(models.severity, inputs.test, models.enc)
    truth, guess = F.col("congestion_severity"), F.col("severity")
    of = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (truth == c).alias("t"), (guess == c).alias("p"))
                             for c in ml.SEVERITY_CLASSES))).alias("x")
    per = p.select(of).groupBy("x.class").agg(
        F.count_if(F.col("x.t") & F.col("x.p")).alias("tp"), F.count_if("x.p").alias("pp"),
        F.count_if("x.t").alias("support"))
    return metrics.per_class_scores(per)


@query("ml_count_errors")
def q_ml_count_errors(spark, sf):
    models, inputs = trained(spark, sf)
    rows = models.enc.apply(ml._with_cause(inputs.hours(before=False)))
    return metrics.regression_errors(ml.predict_counts(models.counts, rows), "event_count", "pred_count")


@query("ml_forecast_2h")
def q_ml_forecast_2h(spark, sf):
    s, _ = _scored_test(spark, sf)
    return s.select("id", "corridor", "hour_of_day", "count_lag_1", "count_lag_24", "count_lag_168",
                    "predicted_secondary_count", "severity")


@query("ml_contributions")
def q_ml_contributions(spark, sf):
    models, inputs = trained(spark, sf)
    found = ml.with_drivers(models.enc.apply(inputs.test), models.seed)
    return found.select("id", "driver_top3", "driver_values3")


@query("ml_attributions")
def q_ml_attributions(spark, sf):
    """M6, one row for each incident of the test side and feature; base plus contributions is the raw score."""
    models, inputs = trained(spark, sf)
    found = ml.attributions(models.enc.apply(inputs.test), models.seed)
    return found.select("id", "base", F.posexplode("contributions").alias("i", "contribution")).select(
        "id", F.get(F.array(*map(F.lit, K.FEATURES_A)), F.col("i")).alias("feature"), "contribution", "base")


@query("ml_saved_scores")
def q_ml_saved_scores(spark, sf):
    """Scores of the test side before and after the models are written to another folder and read back."""
    models, inputs = trained(spark, sf)
    path = scratch_path(spark, "models")
    ml.save_models(models, path, spark)
    back = ml.load_models(path, spark)
    rows = models.enc.apply(inputs.test)
    return back.seed.score(models.seed.score(rows), "saved_probability").select(
        "id", "cascade_probability", "saved_probability",
        (F.col("cascade_probability") >= models.seed.threshold).alias("predicted_seed"),
        (F.col("saved_probability") >= back.seed.threshold).alias("saved_seed"))


@query("ml_alerts")
def q_ml_alerts(spark, sf):
    """D14 with the trained models: every corridor-day replayed at once, alerts with their three main drivers."""
    models, inputs = trained(spark, sf)
    s = ml.score(inputs.labelled, models, inputs.grid)
    seeds = s.where((F.col("cascade_probability") >= models.seed.threshold) & F.col("start_local").isNotNull())
    # read more than once by the alert numbers: scored and attributed once
    return decisions.build_alerts(checked_small(ml.with_drivers(seeds, models.seed)), threshold=models.seed.threshold)


@query("ml_plan")
def q_ml_plan(spark, sf):
    return decisions.plan_columns(decisions.allocate(q_ml_alerts(spark, sf)))


@query("ml_score_scenarios")
def q_ml_score_scenarios(spark, sf):
    """M12 with the trained seed model: every corridor x weekday x hour x cause."""
    models, inputs = trained(spark, sf)
    eng = inputs.labelled
    grid = metrics.scenario_grid(eng).drop("cascade_probability")
    grid = grid.withColumnsRenamed({"hour": "hour_of_day", "cause": "event_cause_grouped"})
    # what-if density: the corridor's share of all incidents
    share = cascade.corridor_totals(eng).withColumn(
        "cascade_density", F.col("corridor_total") / F.sum("corridor_total").over(Window.partitionBy()))
    feats = lookup_join(grid, share.select("corridor", "cascade_density"), "corridor").withColumns({
        "is_weekend": F.col("day_of_week").isin(5, 6).cast("long"),
        "cascade_density": F.coalesce("cascade_density", F.lit(0.0))})
    # M11 on a scenario: the slot's usual 2 h count stands for the last hour's, the others are unknown
    feats = feats.withColumns({"count_lag_1": F.col("corridor_events_2h"), "count_lag_24": F.lit(0.0),
                               "count_lag_168": F.lit(0.0)})
    scored = ml.forecast_2h(models.counts, models.seed.score(models.enc.apply(feats)))
    scored = scored.withColumn("secondary_count", F.col("predicted_secondary_count"))
    scored = ml.predict_severity(models.severity, scored, models.enc)
    alert = decisions.request(scored.withColumn("hour_of_day", F.col("hour_of_day").cast("int")))
    return decisions.tiers(alert).select(
        "corridor", "day_of_week", "hour_of_day", "event_cause_grouped", "cascade_probability",
        (F.col("cascade_probability") >= models.seed.threshold).alias("predicted_seed"), "predicted_secondary_count",
        "severity", "confidence_band", "tier", "police_needed", "breakdown_needed", "barricades_needed")
