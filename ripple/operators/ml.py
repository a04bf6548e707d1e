"""Model training and scoring.

* Seed classifier (M1/M2): class-weighted boosted trees, calibrated by isotonic
  regression in a 5-fold ensemble: fold ``k``'s trees are fit on the other
  folds and its calibrator on fold ``k``; the score is the mean of the five
  calibrated scores.  Folds come from a hash of ``id``.
* Severity (M7): boosted trees over the three classes (softmax).
* Count forecaster (M8): boosted trees with the Poisson deviance on the lagged
  hourly grid, as many (300 at most) as held-out hours ask for.
* Contributions (M6): path-dependent Shapley values of the raw score, the mean
  over the folds' trees.

All trees grow side by side in one Spark job (``boosting``).  A trained set is a
table of nodes, a table of calibration points and a row of meta data (S7, S8);
scoring passes the feature array of a row through Arrow, everything else stays
in Spark columns.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ripple import constants as K
from ripple.operators import boosting
from ripple.operators.joins import checked_small

SEVERITY_CLASSES = ("high", "low", "medium")      # alphabetical label codes
FOLDS = 5
CALIBRATION_RANGES = 16


@dataclass
class Encoders:
    """alphabetical label codes; unseen values map to a fallback label."""
    cause_labels: list
    corridor_labels: list

    def apply(self, df: DataFrame, cause="event_cause_grouped", corridor="corridor") -> DataFrame:
        def code(col, labels, fallback):
            arr = F.array(*[F.lit(x) for x in labels])
            v = F.when(F.col(col).isin(*labels), F.col(col)).otherwise(F.lit(fallback))
            return (F.array_position(arr, v) - 1).cast("double")
        return df.withColumns({
            "event_cause_encoded": code(cause, self.cause_labels, K.DEFAULT_CAUSE),
            "corridor_encoded": code(corridor, self.corridor_labels, K.DEFAULT_CORRIDOR),
        })


def fit_encoders(df: DataFrame) -> Encoders:
    """Label sets (bounded by the category vocabularies) learned by StringIndexer."""
    idx = StringIndexer(inputCols=["event_cause_grouped", "corridor"],
                        outputCols=["_c", "_k"], stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    causes, corridors = idx.labelsArray
    causes = sorted(set(causes) | {K.DEFAULT_CAUSE})
    corridors = sorted(set(corridors) | {K.DEFAULT_CORRIDOR})
    return Encoders(list(causes), list(corridors))


def _numeric(df: DataFrame, features) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def _vector(features) -> "F.Column":
    return F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))


@dataclass
class SeedModel:
    folds: list                                   # [(trees, (scores, calibrated))]
    threshold: float = 0.5
    features: tuple = K.FEATURES_A

    def score(self, df: DataFrame, out: str = "cascade_probability") -> DataFrame:
        """Mean of the fold-wise calibrated probabilities (M2)."""
        each = boosting.scores([t for t, _ in self.folds], [c for _, c in self.folds])
        mean = F.aggregate(each(_vector(self.features)), F.lit(0.0), lambda a, x: a + x) / float(len(self.folds))
        return df.withColumn(out, F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))


@dataclass
class Models:
    enc: Encoders
    seed: SeedModel
    severity: boosting.Trees
    counts: boosting.Trees
    nodes: DataFrame                              # the stored tables all of these were made from
    calibration: DataFrame


# ---- training ---------------------------------------------------------------

def specs(n_trees: int, depth: int, rate: float) -> dict[str, boosting.Spec]:
    size = dict(n_trees=n_trees, depth=depth, rate=rate)
    return {"seed": boosting.Spec(K.FEATURES_A, "binary", **size),
            "severity": boosting.Spec(K.FEATURES_B, "classes", len(SEVERITY_CLASSES), **size),
            "counts": boosting.Spec(K.FEATURES_C, "poisson", min_hessian=20.0, stop=True, **size)}


def seed_rows(train: DataFrame, enc: Encoders, folds: int = FOLDS) -> DataFrame:
    """Features, ``label`` and ``_fold`` of the seed classifier's training rows."""
    return _numeric(enc.apply(train), K.FEATURES_A).select(
        *K.FEATURES_A, F.col("is_cascade_seed").cast("double").alias("label"),
        F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("_fold"))


def fit_models(train: DataFrame, grid: DataFrame, enc: Encoders, folds: int = FOLDS, n_trees: int = boosting.N_TREES,
               depth: int = boosting.DEPTH, rate: float = boosting.RATE) -> Models:
    """M1, M2, M7, M8 on ``train`` (engineered rows with cascade features) and ``grid`` (hourly, with lags).

    All fits (one for each fold, the classes, the counts) are one job.  A fit takes
    all its rows, those that share their bins as one vector.
    """
    spec = specs(n_trees, depth, rate)
    seeds = seed_rows(train, enc, folds)
    label = F.col("congestion_severity")
    severity = _numeric(enc.apply(train), K.FEATURES_B).where(label.isin(*SEVERITY_CLASSES))
    counts = _numeric(enc.apply(_with_cause(grid)), K.FEATURES_C).withColumn("event_count", F.col("event_count").cast("double"))
    cuts = {kind: boosting.cut_points(df, spec[kind].features)
            for kind, df in (("seed", seeds), ("severity", severity), ("counts", counts))}
    # positives weigh as much as negatives over all training rows
    n = seeds.agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos")).first()
    weight = n["neg"] / n["pos"] if n["pos"] else 1.0
    v = boosting.vectors(seeds, K.FEATURES_A, cuts["seed"],
                         {"neg": 1 - F.col("label"), "pos": F.col("label") * weight}, ["_fold"])
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("_fold"))
    table = v.select(F.explode(others).alias("k"), "bins", "stats").select(
        F.concat(F.lit("seed-"), "k").alias("fit"), F.lit("seed").alias("kind"), "bins", "stats")
    table = table.unionByName(boosting.vectors(severity, K.FEATURES_B, cuts["severity"], {
        c: (label == c).cast("double") for c in SEVERITY_CLASSES}).select(
            F.lit("severity").alias("fit"), F.lit("severity").alias("kind"), "bins", "stats"))
    table = table.unionByName(boosting.vectors(counts, K.FEATURES_C, cuts["counts"], {
        "rows": F.lit(1.0), "events": F.col("event_count")}).select(
            F.lit("counts").alias("fit"), F.lit("counts").alias("kind"), "bins", "stats"))
    nodes = checked_small(boosting.train(checked_small(table), spec, cuts))
    trees = trees_of(nodes, spec, folds)
    held = seeds.withColumn("score", _own_fold(trees["seed"])(_vector(K.FEATURES_A), F.col("_fold")))
    calibration = checked_small(boosting.isotonic(held, "_fold", "score", "label", CALIBRATION_RANGES))
    return Models(enc, SeedModel(list(zip(trees["seed"], points_of(calibration, folds)))), trees["severity"],
                  trees["counts"], nodes, calibration)


def _with_cause(grid: DataFrame) -> DataFrame:
    """The grid has corridors but no causes; encoding needs a column of that name."""
    return grid if "event_cause_grouped" in grid.columns else grid.withColumn("event_cause_grouped", F.lit(K.DEFAULT_CAUSE))


def _own_fold(fits: list[boosting.Trees]):
    """The score of each row by the trees of its own fold, which have not seen it."""
    def run(x: pa.Array, fold: pa.Array) -> pa.Array:
        rows, k = boosting.matrix(x, len(fits[0].features)), fold.to_numpy(zero_copy_only=False)
        out = np.zeros(len(rows))
        for i, trees in enumerate(fits):
            out[k == i] = trees.predict(rows[k == i])[:, 0]
        return pa.array(out)

    return F.arrow_udf(run, DoubleType())


def trees_of(nodes: DataFrame, spec: dict[str, boosting.Spec], folds: int) -> dict:
    """The arrays of every fit; their size is bounded by trees and depth."""
    rows = nodes.toArrow()
    names = rows.column("fit").to_numpy()
    of = lambda fit, kind: boosting.Trees.of(rows.filter(pa.array(names == fit)), spec[kind])
    return {"seed": [of(f"seed-{k}", "seed") for k in range(folds)], "severity": of("severity", "severity"),
            "counts": of("counts", "counts")}


def points_of(calibration: DataFrame, folds: int) -> list[tuple[list, list]]:
    """Calibration of each fold as points to interpolate between (a fold without rows keeps its scores)."""
    rows = calibration.orderBy("_fold", "low").collect()       # bounded by the calibrators' finest step
    out = []
    for k in range(folds):
        own = [r for r in rows if r["_fold"] == k]
        x = [v for r in own for v in (r["low"], r["high"])]
        y = [v for r in own for v in (r["mean"], r["mean"])]
        out.append((x, y) if own else ([0.0, 1.0], [0.0, 1.0]))
    return out


def importances(models: Models, top: int = 10) -> DataFrame:
    """M5: mean gain of a feature's splits as a share of all features', averaged over the folds, top ``top``."""
    gains = (models.nodes.where(F.col("fit").startswith("seed-") & (F.col("feature") >= 0))
             .groupBy("fit", "feature").agg(F.avg("gain").alias("gain")))
    names = F.array(*map(F.lit, K.FEATURES_A))
    total = gains.groupBy(F.col("fit").alias("_fit")).agg(F.sum("gain").alias("total"))
    share = gains.join(total, F.col("fit") == F.col("_fit")).groupBy("feature").agg(
        (F.sum(F.col("gain") / F.col("total")) / float(len(models.seed.folds))).alias("importance"))
    every = models.nodes.sparkSession.range(len(K.FEATURES_A)).select(F.col("id").cast("int").alias("feature"))
    return (every.join(share, "feature", "left")
            .select(F.get(names, F.col("feature")).alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature").limit(top))


# ---- scoring ----------------------------------------------------------------

def predict_severity(model: boosting.Trees, df: DataFrame, enc: Encoders) -> DataFrame:
    """M7: the most likely class (ties: the first in label order)."""
    p = boosting.scores([model])(_vector(K.FEATURES_B))
    out = enc.apply(df).withColumn("_classes", p)
    labels = F.array(*map(F.lit, SEVERITY_CLASSES))
    best = F.array_position(F.col("_classes"), F.array_max("_classes"))
    return out.withColumn("severity", F.element_at(labels, best.cast("int"))).drop("_classes")


def predict_counts(model: boosting.Trees, df: DataFrame, out: str = "pred_count") -> DataFrame:
    """M8: the expected count of an hour from rows with the features of the grid (encoded corridor)."""
    return df.withColumn(out, F.element_at(boosting.scores([model])(_vector(K.FEATURES_C)), 1))


def forecast_2h(model: boosting.Trees, df: DataFrame) -> DataFrame:
    """Predict hour h, feed it back as lag-1 for hour h+1, sum both,
    round half-even, floor 0.  Midnight advances the weekday."""
    one = boosting.scores([model])
    first = df.withColumn("_p1", F.element_at(one(_vector(K.FEATURES_C)), 1))
    nxt = F.pmod(F.col("hour_of_day").cast("double") + 1, F.lit(24.0))
    day = F.col("day_of_week").cast("double")
    ahead = {"hour_of_day": nxt, "day_of_week": F.when(nxt == 0, F.pmod(day + 1, F.lit(7.0))).otherwise(day),
             "count_lag_1": F.col("_p1")}
    second = F.array(*(F.coalesce(ahead.get(f, F.col(f).cast("double")), F.lit(0.0)) for f in K.FEATURES_C))
    both = first.withColumn("_p2", F.element_at(one(second), 1))
    return both.withColumn("predicted_secondary_count", F.greatest(
        F.bround(F.col("_p1") + F.col("_p2"), 0), F.lit(0.0)).cast("long")).drop("_p1", "_p2")


def fit_counts_glm(grid: DataFrame, max_iter: int = 50, reg: float = 1e-4) -> PipelineModel:
    """A Poisson GLM (log link) on the lagged hourly grid: the yardstick of M8."""
    stages = [
        StringIndexer(inputCol="corridor", outputCol="_corr_idx", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_corr_idx", "hour_of_day", "day_of_week"],
                      outputCols=["_corr_oh", "_hour_oh", "_dow_oh"], handleInvalid="keep"),
        VectorAssembler(handleInvalid="keep", outputCol="features", inputCols=["_corr_oh", "_hour_oh", "_dow_oh", "count_lag_1", "count_lag_24", "count_lag_168"]),
        GeneralizedLinearRegression(family="poisson", link="log", labelCol="event_count",
                                    maxIter=max_iter, regParam=reg, predictionCol="pred_count"),
    ]
    data = grid.withColumns({c: F.col(c).cast("double") for c in
                             ("event_count", "count_lag_1", "count_lag_24", "count_lag_168")})
    return Pipeline(stages=stages).fit(data)


def lags_at_incident(df: DataFrame, grid_with_lags: DataFrame) -> DataFrame:
    """Real lags (K7) of each incident's corridor-hour: the counts 1, 24 and
    168 hours before its hour (0 off the grid)."""
    g = grid_with_lags.select("corridor", F.col("hourly_bucket").alias("_hb"),
                              "count_lag_1", "count_lag_24", "count_lag_168")
    d = df.withColumn("_hb", F.date_trunc("hour", "start_local").cast("timestamp_ntz"))
    out = d.join(g, ["corridor", "_hb"], "left").drop("_hb")
    return out.fillna(0, ["count_lag_1", "count_lag_24", "count_lag_168"])


def score(df: DataFrame, models: Models, grid_with_lags: DataFrame) -> DataFrame:
    """Seed probability -> flag; 2 h count forecast; severity."""
    x = models.seed.score(models.enc.apply(df))
    x = x.withColumn("predicted_seed", F.col("cascade_probability") >= models.seed.threshold)
    x = forecast_2h(models.counts, lags_at_incident(x, grid_with_lags))
    x = x.withColumn("secondary_count", F.col("predicted_secondary_count"))
    return predict_severity(models.severity, x, models.enc)


def attributions(df: DataFrame, model: SeedModel) -> DataFrame:
    """M6: ``df`` (encoded) with ``contributions`` (one Shapley value for each feature) and ``base``.

    They are the mean over the folds' trees; base plus contributions is the mean raw score.
    """
    n = len(model.features)
    found = df.withColumn("_shapley", boosting.shapley_values([t for t, _ in model.folds])(_vector(model.features)))
    return found.withColumns({"contributions": F.slice("_shapley", 1, n), "base": F.element_at("_shapley", n + 1)}).drop("_shapley")


def with_drivers(df: DataFrame, model: SeedModel, top: int = 3) -> DataFrame:
    """``df`` (encoded) with ``driver_top3`` and ``driver_values3``: the features that raise the score most.

    Values are floored at 0.001; equal ones keep the features' order.
    """
    labels = F.array(*(F.lit(K.FEATURE_LABELS.get(f, f)) for f in model.features))
    order = F.array_sort(F.transform("contributions", lambda c, i: F.struct((-c).alias("v"), i.alias("i"))))
    ranked = F.slice(order, 1, top)
    return attributions(df, model).withColumns({
        "driver_top3": F.transform(ranked, lambda s: F.get(labels, s["i"])),
        "driver_values3": F.transform(ranked, lambda s: F.greatest(-s["v"], F.lit(K.CONTRIBUTION_FLOOR))),
    }).drop("contributions", "base")


# ---- S7 / S8: persistence --------------------------------------------------
def save_models(models: Models, path: str, spark: SparkSession) -> None:
    """The tables, then the row of meta data: a set without that row is not complete."""
    models.nodes.write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    models.calibration.write.mode("overwrite").parquet(os.path.join(path, "calibration"))
    t = models.seed.folds[0][0]
    meta = spark.createDataFrame(
        [(float(models.seed.threshold), len(models.seed.folds), t.depth, models.enc.cause_labels,
          models.enc.corridor_labels)],
        "threshold double, folds int, depth int, cause_labels array<string>, corridor_labels array<string>")
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def load_models(path: str, spark: SparkSession) -> Models:
    meta = spark.read.parquet(os.path.join(path, "meta")).first()
    nodes = spark.read.parquet(os.path.join(path, "nodes"))
    calibration = spark.read.parquet(os.path.join(path, "calibration"))
    trees = trees_of(nodes, specs(0, meta["depth"], 0.0), meta["folds"])
    seed = SeedModel(list(zip(trees["seed"], points_of(calibration, meta["folds"]))), meta["threshold"])
    return Models(Encoders(list(meta["cause_labels"]), list(meta["corridor_labels"])), seed, trees["severity"],
                  trees["counts"], nodes, calibration)
