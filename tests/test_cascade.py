"""Cascade labels and look-back windows: hand-made edge cases and properties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ripple.operators import cascade
from ripple.plans import flows

T0 = dt.datetime(2024, 3, 7, 0, 0, 0)
SCHEMA = "id long, corridor string, start_datetime timestamp_ntz, event_cause_grouped string"


def _rows(spark, hours, corridor="Corridor A", causes=None):
    causes = causes or ["others"] * len(hours)
    rows = [(i, corridor, None if h is None else T0 + dt.timedelta(hours=h), c)
            for i, (h, c) in enumerate(zip(hours, causes))]
    return spark.createDataFrame(rows, SCHEMA)


def _by_id(df, col):
    return [r[col] for r in df.orderBy("id").collect()]


def test_lookback_ties_follow_sorted_search(spark):
    # FIXTURES §6.1: ts 0,1,1,1,3,3,9 with W = 2 -> 0,1,2,3,3,4,0
    df = _rows(spark, [0, 1, 1, 1, 3, 3, 9])
    out = cascade.cascade_features(df, lookback_hours=(2, 6), with_density=False)
    assert _by_id(out, "corridor_events_2h") == [0, 1, 2, 3, 3, 4, 0]


def test_null_timestamp_gets_zero(spark):
    df = _rows(spark, [0, None, 1, None])
    out = cascade.cascade_features(df, with_density=False)
    got = {r["id"]: (r["corridor_events_2h"], r["secondary_count"]) for r in out.collect()}
    assert got[1] == (0, 0) and got[3] == (0, 0)
    assert got[2][0] == 1


def _brute(hours, ids, w_back, w_fwd):
    order = sorted(range(len(hours)), key=lambda i: (hours[i], ids[i]))
    pos = {i: p for p, i in enumerate(order)}
    ts = np.array([hours[i] for i in order], dtype=float)
    back, fwd = {}, {}
    for i in range(len(hours)):
        p = pos[i]
        back[ids[i]] = p - int(np.searchsorted(ts, hours[i] - w_back, side="left"))
        fwd[ids[i]] = sum(1 for h in hours if hours[i] < h <= hours[i] + w_fwd)
    return back, fwd


def test_bucketing_is_exact_for_any_bucket_width(spark):
    rnd = random.Random(7)
    hours = [round(rnd.uniform(0, 200), 1) for _ in range(300)] + [10.0, 10.0, 10.0, 48.0, 48.0]
    df = _rows(spark, hours)
    back, fwd = _brute(hours, list(range(len(hours))), 2, 2)
    for bucket in (None, 360, 720, 6000):
        out = cascade.cascade_features(df, follow_minutes=120, lookback_hours=(2, 6),
                                       bucket_minutes=bucket, with_density=False)
        rows = {r["id"]: r for r in out.collect()}
        assert len(rows) == len(hours)
        assert all(rows[i]["corridor_events_2h"] == back[i] for i in rows)
        assert all(rows[i]["secondary_count"] == fwd[i] for i in rows)


def test_lookback_ignores_future_rows(spark):
    df = _rows(spark, [0, 0.5, 1, 1.5, 2])
    more = _rows(spark, [0, 0.5, 1, 1.5, 2, 2.5, 3, 30])
    a = _by_id(cascade.cascade_features(df, with_density=False), "corridor_events_6h")
    b = _by_id(cascade.cascade_features(more, with_density=False), "corridor_events_6h")[:5]
    assert a == b


def test_seed_present_counts_only_earlier_seed_causes(spark):
    df = _rows(spark, [0, 1, 2.5, 5], causes=["water_logging", "others", "others", "others"])
    out = _by_id(cascade.cascade_features(df, with_density=False), "seed_event_present_3h")
    assert out == [0, 1, 1, 0]


def test_follow_counts_sum_to_pair_count(spark):
    eng = flows.engineered(spark, SF01)
    pairs = cascade.cascade_pairs(eng, 120).count()
    total = cascade.follow_count(eng, 120).agg(F.sum("secondary_count")).first()[0]
    assert pairs == total > 0


def test_catch_all_corridor_never_seeds(spark):
    df = _rows(spark, [0, 0.1, 0.2, 0.3, 0.4], corridor="Non-corridor")
    out = cascade.cascade_features(df, with_density=False)
    assert _by_id(out, "secondary_count") == [0] * 5
    assert _by_id(out, "corridor_events_2h") == [0, 1, 2, 3, 4]


def test_all_features_match_brute_force_on_mixed_corridors(spark):
    rnd = random.Random(11)
    corridors = ["Corridor A", "Corridor B", "Non-corridor"]
    causes = ["water_logging", "others", "accident", "tree_fall"]
    rows = []
    for i in range(400):
        h = None if rnd.random() < 0.05 else rnd.choice([round(rnd.uniform(0, 72), 2), float(rnd.randint(0, 72))])
        rows.append((i, rnd.choice(corridors), None if h is None else T0 + dt.timedelta(hours=h),
                     rnd.choice(causes)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in cascade.cascade_features(df).collect()}
    total = {c: sum(1 for r in rows if r[1] == c) for c in corridors}
    for i, c, t, cause in rows:
        g = got[i]
        if t is None:
            assert (g["corridor_events_2h"], g["corridor_events_6h"], g["seed_event_present_3h"],
                    g["secondary_count"]) == (0, 0, 0, 0)
            continue
        earlier = [r for r in rows if r[1] == c and r[2] is not None and (r[2], r[0]) < (t, i)]
        e2 = sum(1 for r in earlier if r[2] >= t - dt.timedelta(hours=2))
        e6 = sum(1 for r in earlier if r[2] >= t - dt.timedelta(hours=6))
        s3 = int(any(r[2] >= t - dt.timedelta(hours=3) and r[3] in ("water_logging", "tree_fall")
                     for r in earlier))
        fol = 0 if c == "Non-corridor" else sum(
            1 for r in rows if r[1] == c and r[2] is not None and t < r[2] <= t + dt.timedelta(hours=2))
        assert (g["corridor_events_2h"], g["corridor_events_6h"], g["seed_event_present_3h"],
                g["secondary_count"]) == (e2, e6, s3, fol), i
        assert g["cascade_density"] == pytest.approx(e2 / total[c])
        assert g["is_cascade_seed"] == (fol >= 3)


def test_frames_only_take_in_rows(spark):
    # a frame with two moving ends is added up anew for each row: the square of a dense corridor
    df = _rows(spark, [0, 1, 1, 2])
    for out in (cascade.cascade_features(df, with_density=False), cascade.follow_count(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        frames = plan.split("specifiedwindowframe(")[1:]
        assert frames and all(f.split(", ")[1].startswith("unboundedpreceding") for f in frames)


def test_a_dense_corridor_equals_brute_force(spark):
    rng = random.Random(5)
    hours = [round(rng.uniform(0, 30) * 4) / 4 for _ in range(400)]                  # many ties and bucket edges
    causes = [rng.choice(["others", "accident", "water_logging"]) for _ in hours]
    out = cascade.cascade_features(_rows(spark, hours, causes=causes), with_density=False).collect()
    assert len(out) == len(hours)
    seeds = [c in cascade.K.SEED_CAUSES for c in causes]
    for r in out:
        i, t = r["id"], hours[r["id"]]
        before = [j for j, h in enumerate(hours) if (h, j) < (t, i)]
        assert r["secondary_count"] == sum(t < h <= t + 2 for h in hours)
        assert r["corridor_events_2h"] == sum(hours[j] >= t - 2 for j in before)
        assert r["corridor_events_6h"] == sum(hours[j] >= t - 6 for j in before)
        assert r["seed_event_present_3h"] == any(hours[j] >= t - 3 and seeds[j] for j in before)


def test_wall_clock_columns_come_after_the_windows(spark):
    out = flows.labelled(spark, SF01, ())
    plan = out.select("id", "date_str", "corridor_events_2h")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan[plan.rindex("Window ["):]
    light = [c for c in flows.light(spark, SF01).columns]
    assert out.columns[:len(light)] == light
    assert out.select(light).exceptAll(flows.light(spark, SF01)).count() == 0


def test_a_cycle_reads_its_key_once(spark):
    from ripple.sources import adapter
    got = adapter._cycle(F.col("key"), ("a", "b", None), "z")
    assert str(got).count("key") == 1
    rows = spark.createDataFrame([(0,), (4,), (-1,), (None,)], "key int").select(adapter._cycle(
        F.col("key"), ("a", "b"), "z")).collect()
    assert [r[0] for r in rows] == ["a", "a", "z", "z"]
