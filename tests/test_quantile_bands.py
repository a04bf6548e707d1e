"""Quantiles rank few rows: ties count once, small groups are bracketed too."""

import random

import pytest
from pyspark.sql import functions as F

from ripple.operators import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _reference(df, keys=("g",)):
    return {r["g"]: r["p"] for r in df.groupBy(*keys).agg(
        F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("p")).collect()}


@pytest.mark.parametrize("accuracy", [20, 100, 100000])
def test_groups_of_every_small_size(spark, accuracy):
    r = random.Random(4)
    rows = [(n, float(r.choice([r.randint(-3, 3), r.random()]))) for n in [*range(1, 61), 200, 1000, 3000]
            for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {x["g"]: [x[f"q{i}"] for i in range(len(PROBS))]
           for x in quantiles.exact_quantiles(df, "v", PROBS, ["g"], accuracy=accuracy).collect()}
    assert got == _reference(df)
    values = {}
    for g, v in rows:
        values.setdefault(g, []).append(v)
    upper = {x["g"]: x["q0"] for x in quantiles.exact_quantiles(df, "v", [0.5], ["g"], "upper", accuracy).collect()}
    assert upper == {g: sorted(v)[len(v) // 2] for g, v in values.items()}


def test_few_rows_are_ranked(spark, monkeypatch):
    seen, whole = [], quantiles._band

    def band(*args):
        seen.append(whole(*args))
        return seen[-1]
    monkeypatch.setattr(quantiles, "_band", band)
    # group 0: 20,000 distinct values; group 1: 60 % of its rows have one value
    df = spark.range(40000).select((F.col("id") % 2).alias("g"), F.when(
        (F.col("id") % 2 == 0) | (F.col("id") % 10 < 4), F.col("id").cast("double")).otherwise(7.0).alias("v"))
    got = {x["g"]: [x[f"q{i}"] for i in range(len(PROBS))]
           for x in quantiles.exact_quantiles(df, "v", PROBS, ["g"]).collect()}
    assert got == _reference(df)
    ranked = seen[0].groupBy("g", "_i").count().agg(F.max("count")).first()[0]
    assert ranked <= 32 * 20000 / quantiles.DEFAULT_ACCURACY + 30
