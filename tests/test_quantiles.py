"""Bracket-and-select quantiles equal Spark's exact percentile bit for bit."""

import random

import pytest
from pyspark.sql import functions as F

from ripple.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, "c"]), float(rnd.choice([rnd.random() * 100, rnd.randint(0, 5)])))
            for _ in range(20000)]
    rows += [("d", 1.0), ("d", 2.0), ("d", 3.0), ("d", 10.0)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("accuracy", [100, 100000])
def test_linear_matches_percentile(data, accuracy):
    # accuracy=100 forces the bracket path on the big groups, 100000 ranks them whole
    mine = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))]
            for r in exact_quantiles(data, "v", PROBS, ["g"], accuracy=accuracy).collect()}
    ref = {r["g"]: r["p"] for r in data.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("p")).collect()}
    assert mine == ref
    assert mine["d"][4] == pytest.approx(9.79)


@pytest.mark.parametrize("accuracy", [100, 100000])
def test_upper_median_and_global(data, accuracy):
    up = {r["g"]: r["q0"] for r in exact_quantiles(data, "v", [0.5], ["g"], "upper", accuracy).collect()}
    ref = {r["g"]: r["m"] for r in data.groupBy("g").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").alias("m")).collect()}
    assert up == ref and up["d"] == 3.0
    ref99 = data.select(F.percentile("v", 0.99)).first()[0]
    g = exact_quantiles(data, "v", [0.99], accuracy=accuracy).first()
    assert g["q0"] == ref99
