"""Boosted trees, Shapley values and isotonic calibration against brute force; the registered models."""

import itertools
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from conftest import SF01
from ripple import constants as K
from ripple.operators import boosting, metrics, ml
from ripple.plans import catalog_ml

NAMES = tuple("abcd")


def sample(n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 9, (n, 4)).astype(float)
    y = (x[:, 0] * 0.7 - x[:, 1] + 0.4 * x[:, 2] * (x[:, 3] > 4) + r.normal(0, 1, n) > 0).astype(float)
    return x, y


def table_of(rows):
    return pa.table([pa.array([q[i] for q in rows]) for i in range(9)], names=[c.split()[0] for c in boosting.NODE_SCHEMA.split(", ")])


def fitted(spec, x, stats):
    cuts = {f: [float(c) for c in range(8)] for f in spec.features}
    bins = x[:, :len(spec.features)].astype(int)
    return boosting.Trees.of(table_of(boosting.fit("m", spec, cuts, bins, stats)), spec)


def plain_tree(x, g, h, depth):
    """A tree by trying every split of every node: the value each row gets."""
    def node(rows, d):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, None)
        if d < depth:
            for j in range(x.shape[1]):
                for c in range(8):
                    left = rows & (x[:, j] <= c)
                    right = rows & ~left
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        s = sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in (left, right)) - gs ** 2 / (hs + 1)
                        if s > best[0] + 1e-12:
                            best = (s, (left, right))
        if best[1] is None:
            out[rows] = -0.3 * gs / (hs + 1)
        else:
            for part in best[1]:
                node(part, d + 1)

    out = np.zeros(len(x))
    node(np.ones(len(x), bool), 0)
    return out


def test_trees_equal_exhaustive_search():
    x, y = sample()
    trees = fitted(boosting.Spec(NAMES, "binary", 1, 4, 3, 0.3), x, np.c_[1 - y, y])
    f = np.zeros(len(x))
    for _ in range(4):
        p = 1 / (1 + np.exp(-f))
        f += plain_tree(x, p - y, p * (1 - p), 3)
    assert np.abs(trees.raw(x)[:, 0] - f).max() < 1e-9


def test_sums_of_equal_rows_give_the_same_trees():
    x, y = sample()
    spec = boosting.Spec(NAMES, "binary", 1, 20, 4, 0.1)
    each = fitted(spec, x, np.c_[1 - y, y])
    distinct, at = np.unique(x, axis=0, return_inverse=True)
    sums = np.c_[np.bincount(at, 1 - y), np.bincount(at, y)]
    assert np.abs(each.raw(x) - fitted(spec, distinct, sums).raw(x)).max() < 1e-9


def test_classes_and_counts_learn():
    x, y = sample(600)
    label = (y + (x[:, 1] > 6)).astype(int)
    p = fitted(boosting.Spec(NAMES, "classes", 3, 30, 3, 0.3), x, np.eye(3)[label]).predict(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == label).mean() > 0.9
    counts = np.random.default_rng(1).poisson(np.exp(0.2 * x[:, 0] - 0.1 * x[:, 1]))
    mu = fitted(boosting.Spec(NAMES, "poisson", 1, 60, 3, 0.2), x, np.c_[np.ones(600), counts]).predict(x)[:, 0]
    assert abs(mu.sum() - counts.sum()) < 0.03 * counts.sum()
    deviance = lambda m: 2 * np.sum(np.where(counts > 0, counts * np.log(np.maximum(counts, 1) / m), 0) - counts + m)
    assert deviance(mu) < 0.7 * deviance(np.full(600, counts.mean()))


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_shapley_values_equal_all_subsets(depth):
    x, y = sample()
    trees = fitted(boosting.Spec(NAMES, "binary", 1, 6, depth, 0.3), x, np.c_[1 - y, y])

    def value(t, node, row, known):
        f, cover = trees.feature[0, t, node], trees.cover[0, t]
        if f < 0:
            return trees.value[0, t, node]
        a, b = 2 * node + 1, 2 * node + 2
        if f in known:
            return value(t, a if row[f] <= trees.cut[0, t, node] else b, row, known)
        return (cover[a] * value(t, a, row, known) + cover[b] * value(t, b, row, known)) / cover[node]

    whole = lambda row, known: sum(value(t, 0, row, known) for t in range(6))
    values, base = trees.shapley(x[:25])
    for row, got in zip(x[:25], values):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (whole(row, {*s, i}) - whole(row, set(s)))
                       for k in range(4) for s in itertools.combinations(rest, k))
            assert got[i] == pytest.approx(want, abs=1e-12)
    assert np.abs(values.sum(axis=1) + base - trees.raw(x[:25])[:, 0]).max() < 1e-12


@pytest.mark.parametrize("depth", [1, 3, 6, 9])
def test_shapley_tables_of_low_subtrees(monkeypatch, depth):
    """One lookup for each low subtree, not for each leaf; batches share the tables of a tree; no bit of a pattern is lost."""
    x, y = sample(900)
    trees = fitted(boosting.Spec(NAMES, "binary", 1, 5, depth, 0.3, 0.1), x, np.c_[1 - y, y])
    for t in range(5):
        slots, leaves, table, _ = trees._leaf_tables(t)
        _, lower = trees._lower_tables(slots, dict(zip(leaves, table)))
        assert len(lower) <= 2 ** max(depth - boosting.LOWER, 0) and (depth < 3 or len(lower) < len(leaves))
    values, base = trees.shapley(x)
    assert np.abs(values.sum(axis=1) + base - trees.raw(x)[:, 0]).max() < 1e-12
    made, make = [], boosting.Trees._leaf_tables
    monkeypatch.setattr(boosting.Trees, "_leaf_tables", lambda self, t: made.append(t) or make(self, t))
    parts = [pa.array(list(map(list, x[a:a + 100]))) for a in range(0, 900, 100)]
    found = np.vstack([boosting.matrix(b, 5) for b in boosting.shapley_values([trees]).func(iter(parts))])
    assert made == [*range(5)] and np.abs(found - np.c_[values, np.full(900, base)]).max() < 1e-12
    monkeypatch.setattr(boosting, "SHAP_BATCH", 250)
    found = np.vstack([boosting.matrix(b, 5) for b in boosting.shapley_values([trees]).func(iter(parts))])
    assert np.abs(found - np.c_[values, np.full(900, base)]).max() < 1e-12


def test_only_the_smaller_child_is_added_up(monkeypatch):
    x, y = sample(2000)
    added, add = [], boosting._bin_sums
    monkeypatch.setattr(boosting, "_bin_sums", lambda code, offset, own, *rest: added.append(len(own)) or add(code, offset, own, *rest))
    offset = np.arange(0, 37, 9)
    code = np.asfortranarray(x.astype(int) + offset[:-1])
    g, h = 0.5 - y, np.full(len(x), 0.25)
    feature, cut, value, cover, gain, at = boosting._grow(code, offset, g, h, 4, 0.3)
    assert added[0] == 2000 and len(added) == 4 and max(added[1:]) <= 1000
    for node in np.flatnonzero(feature >= 0):                           # each split is the best of its node, by sums of its own rows
        rows = [i for i in range(2000) if node in {(at[i] + 1 >> k) - 1 for k in range(5)}]
        best = 0.0
        for j, c in itertools.product(range(4), range(8)):
            left = x[rows, j] <= c
            s = [(g[rows][p].sum(), h[rows][p].sum()) for p in (left, ~left, left | ~left)]
            if min(s[0][1], s[1][1]) >= 1:
                best = max(best, sum(k * a * a / (b + 1) for k, (a, b) in zip((1, 1, -1), s)))
        assert gain[node] == pytest.approx(best, rel=1e-9)


def test_each_fit_has_a_task_of_its_own(spark):
    x, y = sample(300)
    rows = [(f"fit-{k}", "m", [int(v) for v in a], [1 - b, b]) for k in range(7) for a, b in zip(x, y.tolist())]
    table = spark.createDataFrame(rows, "fit string, kind string, bins array<int>, stats array<double>")
    cuts = {"m": {f: [float(c) for c in range(8)] for f in NAMES}}
    nodes = boosting.train(table, {"m": boosting.Spec(NAMES, "binary", 1, 2, 2, 0.3)}, cuts)
    tasks = nodes.select("fit", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 7 and len({r["task"] for r in tasks}) == 7


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_isotonic_equals_the_library(spark, ranges):
    r = np.random.default_rng(ranges)
    score = np.round(r.uniform(0, 1, 600) ** 3, 3)                      # skewed, with ties
    rows = [(k, float(s), float(r.uniform() < s + 0.2 * k)) for k in (0, 1) for s in score]
    df = spark.createDataFrame(rows, "fold int, score double, label double")
    points = boosting.isotonic(df, "fold", "score", "label", ranges, finest=10 ** 9).orderBy("fold", "low").collect()
    for k in (0, 1):
        own = [p for p in points if p["fold"] == k]
        assert [p["mean"] for p in own] == sorted(p["mean"] for p in own)
        model = IsotonicRegression(featuresCol="score", labelCol="label").fit(df.where(F.col("fold") == k))
        at = [p[0] for p in df.where(F.col("fold") == k).select("score").collect()]
        want = np.interp(at, model.boundaries.toArray(), model.predictions.toArray())
        got = np.interp(at, [v for p in own for v in (p["low"], p["high"])], [v for p in own for v in (p["mean"],) * 2])
        assert np.abs(got - want).max() < 1e-12
    few = boosting.isotonic(df, "fold", "score", "label", ranges, finest=4).groupBy("fold").count().collect()
    assert all(r["count"] <= 5 for r in few)


def test_bounded_vectors_and_empty_features(spark):
    x, y = sample(3000)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    cuts = boosting.cut_points(df, NAMES)
    assert all(cuts[f] == [float(v) for v in range(9)] for f in NAMES)
    v = boosting.vectors(df, NAMES, cuts, {"n": 1 - F.col("y"), "p": F.col("y")})
    assert v.count() == len(np.unique(x, axis=0)) and v.agg(F.sum(F.expr("stats[0] + stats[1]"))).first()[0] == 3000
    table = v.select(F.lit("m").alias("fit"), F.lit("m").alias("kind"), "bins", "stats")
    spec = {"m": boosting.Spec(NAMES, "binary", 1, 3, 3, 0.3)}
    all_rows = boosting.train(table, spec, {"m": cuts}).where("tree = 0 and node = 0").first()["cover"]
    some = boosting.train(table, spec, {"m": cuts}, max_vectors=200).where("tree = 0 and node = 0").first()["cover"]
    assert all_rows == 750.0 and 0 < some < 150                         # a quarter of the rows' weight
    assert boosting.train(table.where("fit = 'x'"), spec, {"m": cuts}).collect() == []
    none = df.select(*(F.lit(None).cast("double").alias(f) for f in NAMES), "y")
    assert boosting.cut_points(none, NAMES) == {f: [] for f in NAMES}


@pytest.fixture(scope="module")
def models(spark):
    return catalog_ml.trained(spark, SF01)


def test_registered_models_have_300_trees_of_depth_6(models):
    found, _ = models
    fits = [t for t, _ in found.seed.folds] + [found.severity]
    assert 1 <= found.counts.feature.shape[1] <= 300
    assert len(found.seed.folds) == 5 and all(t.feature.shape[1:] == (300, 127) for t in fits)
    assert found.severity.outputs == 3


def test_registry_is_read_back(spark, models, monkeypatch):
    found, inputs = models
    monkeypatch.setattr(catalog_ml, "_LOADED", {})
    monkeypatch.setattr(ml, "fit_models", None)                         # must not train again
    again, _ = catalog_ml.trained(spark, SF01)
    assert again.seed.threshold == found.seed.threshold
    rows = catalog_ml.q_ml_saved_scores(spark, SF01).collect()
    assert rows and all(r["cascade_probability"] == r["saved_probability"] and r["predicted_seed"] == r["saved_seed"] for r in rows)
    assert all(0.0 <= r["cascade_probability"] <= 1.0 for r in rows)


def test_attributions_add_up(spark, models):
    found, inputs = models
    rows = ml.attributions(found.enc.apply(inputs.test.limit(300)), found.seed)
    vector = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in K.FEATURES_A))
    for r in rows.select("contributions", "base", vector.alias("x")).collect():
        raw = np.mean([t.raw(np.array([r["x"]]))[0, 0] for t, _ in found.seed.folds])
        assert sum(r["contributions"]) + r["base"] == pytest.approx(raw, abs=1e-9)
    top = ml.with_drivers(found.enc.apply(inputs.test.limit(50)), found.seed).select("driver_top3", "driver_values3").collect()
    assert all(len(set(r[0])) == 3 and r[1] == sorted(r[1], reverse=True) and min(r[1]) >= 0.001 for r in top)


def test_counts_beat_the_glm(spark, models):
    found, inputs = models
    test = found.enc.apply(ml._with_cause(inputs.hours(before=False)))
    glm = ml.fit_counts_glm(inputs.hours(before=True))
    y, boosted = F.col("event_count").cast("double"), F.col("pred_count")
    deviance = F.sum(2 * (F.when(y > 0, y * F.log(y / boosted)).otherwise(0.0) - y + boosted)).alias("d")
    ours = ml.predict_counts(found.counts, test).agg(deviance).first()["d"]
    lags = {c: F.col(c).cast("double") for c in ("event_count", "count_lag_1", "count_lag_24", "count_lag_168")}
    theirs = glm.transform(inputs.hours(before=False).withColumns(lags)).agg(deviance).first()["d"]
    print("test deviance: boosted", ours, "GLM", theirs)
    assert ours <= theirs


def test_scores_and_alerts(spark, models):
    found, inputs = models
    scored = ml.score(inputs.test, found, inputs.grid)
    assert scored.where("predicted_secondary_count < 0 or cascade_probability is null").count() == 0
    assert {r[0] for r in scored.select("severity").distinct().collect()} <= set(ml.SEVERITY_CLASSES)
    sweep = metrics.threshold_sweep(scored, "cascade_probability", "is_cascade_seed", (0.1, 0.5, 0.9), 1.0)
    recall = [r["recall"] for r in sweep.orderBy("threshold").collect()]
    assert recall == sorted(recall, reverse=True)
    alerts = catalog_ml.q_ml_alerts(spark, SF01)
    assert {"driver_top3", "driver_values3"} <= set(alerts.columns)
    assert alerts.where("size(driver_top3) <> 3").count() == 0 and alerts.count() > 0
    grid = catalog_ml.q_ml_score_scenarios(spark, SF01)
    assert grid.where("severity is null or tier is null or predicted_secondary_count is null").count() == 0


def test_a_replaced_input_is_trained_anew(spark, tmp_path):
    events = spark.read.parquet(os.path.join(SF01, "events.parquet"))
    one = catalog_ml.fingerprint(events)
    assert catalog_ml.fingerprint(events.repartition(7)) == one
    assert catalog_ml.fingerprint(events.where("event_id > 3")) != one
    assert catalog_ml.fingerprint(events.limit(0)) == "0-0000000000000000"


def test_rows_between_the_same_cuts_are_scored_once(monkeypatch):
    x, y = sample()
    m = fitted(boosting.Spec(NAMES, "binary", n_trees=5, depth=3), x, np.c_[1 - y, y])
    r = np.random.default_rng(1)
    rows = np.repeat(x[:60], 40, axis=0) - r.uniform(0, 0.9, (2400, 4))       # the same cuts below each value
    rows[7, 2], rows[8, 0] = np.nan, np.inf
    want, (values, base) = m._raw(rows), m._shapley(rows)
    seen = []
    for name in ("_raw", "_shapley"):
        plain = getattr(boosting.Trees, name)
        monkeypatch.setattr(boosting.Trees, name, lambda self, x, plain=plain: seen.append(len(x)) or plain(self, x))
    assert (m.raw(rows) == want).all()
    got, same_base = m.shapley(rows)
    assert (got == values).all() and same_base == base
    assert max(seen) <= 62 and len(m.raw(rows[:0])) == 0


def test_scores_walk_the_places_of_values_among_the_cuts():
    x, y = sample()
    trees = fitted(boosting.Spec(NAMES, "binary", n_trees=7, depth=4), x, np.c_[1 - y, y])
    odd = np.r_[x, x + 0.5, np.where(x > 6, np.nan, x), np.where(x > 6, np.inf, -np.inf)]
    want = []
    for row in odd:
        ends = []
        for t in range(trees.feature.shape[1]):
            node = 0
            while (f := trees.feature[0, t, node]) >= 0:
                node = 2 * node + 1 + int(row[f] > trees.cut[0, t, node])
            ends.append(trees.value[0, t, node])
        want.append(trees.start + np.sum(ends))
    assert np.allclose(trees.raw(odd)[:, 0], want, rtol=0, atol=1e-12)
    # a leaf stays where it is, whatever the row
    feature, cut, child, _ = trees._steps[0]
    leaf = trees.feature[0].ravel() < 0
    assert (child[leaf] == np.flatnonzero(leaf)).all() and (cut[leaf] == np.iinfo(np.int64).max).all()


def test_a_large_fit_takes_every_vector_over_many_tasks(spark, monkeypatch):
    """Vectors dealt over the tasks of a stage give the trees of one task that holds them all."""
    x, y = sample(4000, seed=3)
    counts = np.random.default_rng(1).poisson(np.exp(0.2 * x[:, 0] - 0.1 * x[:, 1])).astype(float)
    label = np.eye(3)[(y + (x[:, 1] > 6)).astype(int)]
    specs = {"b": boosting.Spec(NAMES, "binary", 1, 4, 3, 0.3), "c": boosting.Spec(NAMES, "classes", 3, 3, 3, 0.3),
             "p": boosting.Spec(NAMES, "poisson", 1, 4, 3, 0.3)}
    cuts = {kind: {f: [float(c) for c in range(8)] for f in NAMES} for kind in specs}
    stats = {"b": np.c_[1 - y, y], "c": label, "p": np.c_[np.ones(4000), counts]}
    distinct, at = np.unique(x.astype(int), axis=0, return_inverse=True)
    rows = []
    for kind, s in stats.items():
        sums = np.stack([np.bincount(at, column) for column in s.T], axis=1)
        rows += [(f"fit-{kind}", kind, a.tolist(), b.tolist()) for a, b in zip(distinct, sums)]
    rows += [("few", "b", [0, 0, 0, k], [1.0, float(k)]) for k in range(3)]       # some tasks hold none of its vectors
    table = spark.createDataFrame(rows, "fit string, kind string, bins array<int>, stats array<double>")
    monkeypatch.setattr(boosting, "SHARE_VECTORS", 100)
    monkeypatch.setattr(boosting, "SLICED", 50)
    order = ["fit", "output", "tree", "node"]
    one = boosting.train(table, specs, cuts).orderBy(order).collect()
    many = boosting.train(table, specs, cuts, task_vectors=1000).orderBy(order).collect()
    root = [r["cover"] for r in many if r["fit"] == "fit-c" and r["tree"] == -1]
    assert root == [4000.0] * 3                                          # every row weighs in
    assert len(many) == len(one) > 100
    for a, b in zip(one, many):
        assert (*a[:5], a["cut"]) == (*b[:5], b["cut"])
        assert a["value"] == pytest.approx(b["value"], abs=1e-9) and a["cover"] == pytest.approx(b["cover"], rel=1e-9)


def test_no_query_samples_its_training_rows(spark, monkeypatch):
    """Beyond the vectors of one task a fit goes on with all of them."""
    x, y = sample(3000)
    table = spark.createDataFrame([("m", "m", [int(v) for v in a], [1 - b, b]) for a, b in zip(x, y.tolist())],
                                  "fit string, kind string, bins array<int>, stats array<double>")
    cuts = {"m": {f: [float(c) for c in range(8)] for f in NAMES}}
    monkeypatch.setattr(boosting, "SHARE_VECTORS", 1000)
    stop = {"m": boosting.Spec(NAMES, "poisson", n_trees=3, depth=2, stop=True)}
    nodes = boosting.train(table, stop, cuts, task_vectors=200).where("tree = -1").collect()
    assert [r["cover"] for r in nodes] == [3000.0]
    held = boosting._hashed_fifth(x.astype(int))
    assert (held == boosting._hashed_fifth(x.astype(np.int32))).all() and 0.1 < held.mean() < 0.3


def test_sums_over_tasks_without_shared_files(spark, monkeypatch):
    x, y = sample(300)
    table = spark.createDataFrame([("m", "m", [int(v) for v in a], [1 - b, b]) for a, b in zip(x, y.tolist())],
                                  "fit string, kind string, bins array<int>, stats array<double>")
    cuts = {"m": {f: [float(c) for c in range(8)] for f in NAMES}}
    spec = {"m": boosting.Spec(NAMES, "binary", 1, 1, 1, 0.3)}
    monkeypatch.setattr(boosting, "SHARE_VECTORS", 150)
    one = boosting.train(table, spec, cuts).orderBy("tree", "node").collect()
    monkeypatch.setattr(boosting, "scratch_path", lambda spark, name: f"onlyspark://store/{name}")
    many = boosting.train(table, spec, cuts, task_vectors=100).orderBy("tree", "node").collect()
    assert [r["cover"] for r in many] == pytest.approx([r["cover"] for r in one], rel=1e-9)
