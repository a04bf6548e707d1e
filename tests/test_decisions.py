"""Alerts and the greedy plan: golden 11-row replay plan and a property test."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ripple.functions import columns as X
from ripple.operators import decisions

# Golden plan of one corridor-day (FIXTURES §3): seq, local time, cause, risk,
# closure, then the allocated police / breakdown / barricades, flag, and the
# clearance text prefix.
GOLDEN = [
    (4, "10:51:22", "water_logging", 0.99, False, 4, 3, 3, "ALLOCATED", "2024-03-10 11:29:22 IST"),
    (7, "11:12:37", "tree_fall", 0.99, False, 4, 2, 3, "ALLOCATED", "2024-03-09 03:39:37 IST"),
    (8, "11:17:53", "water_logging", 0.98, False, 4, 3, 3, "ALLOCATED", "2024-03-10 11:55:53 IST"),
    (5, "11:10:09", "water_logging", 0.92, False, 4, 0, 3, "SHORTFALL", "2024-03-10 11:48:09 IST"),
    (9, "11:26:34", "water_logging", 0.66, True, 3, 0, 4, "SHORTFALL", "2024-03-10 12:04:34 IST"),
    (2, "02:48:52", "road_conditions", 0.64, True, 3, 0, 4, "SHORTFALL", "2024-03-11 06:37:52 IST"),
    (6, "11:10:59", "others", 0.60, False, 3, 0, 0, "SHORTFALL", "2024-03-09 00:17:59 IST"),
    (11, "11:45:54", "water_logging", 0.56, False, 3, 0, 0, "SHORTFALL", "2024-03-10 12:23:54 IST"),
    (10, "11:44:19", "water_logging", 0.54, False, 3, 0, 0, "SHORTFALL", "2024-03-10 12:22:19 IST"),
    (1, "02:10:43", "vehicle_breakdown", 0.41, False, 3, 0, 0, "SHORTFALL", "2024-03-07 03:08:43 IST"),
    (3, "05:37:28", "vehicle_breakdown", 0.10, False, 2, 0, 0, "SHORTFALL", "2024-03-07 06:35:28 IST"),
]


def _golden_input(spark):
    rows = []
    for seq, clock, cause, risk, closure, *_ in GOLDEN:
        local = dt.datetime.fromisoformat(f"2024-03-07T{clock}")
        rows.append((seq, "Mysore Road", local, local - dt.timedelta(hours=5, minutes=30), cause, closure,
                     risk, local.hour, "Zone 1", "PS 1", 0))
    df = spark.createDataFrame(rows, "id long, corridor string, start_local timestamp_ntz, "
                                     "start_datetime timestamp_ntz, event_cause_grouped string, "
                                     "requires_road_closure boolean, cascade_probability double, "
                                     "hour_of_day long, zone string, police_station string, "
                                     "predicted_secondary_count long")
    return df.withColumns({"date": F.to_date("start_local"),
                           "time_label": F.concat(F.date_format("start_local", "HH:mm"), F.lit(" IST"))})


def test_golden_plan(spark):
    alerts = decisions.build_alerts(_golden_input(spark), threshold=0.0)
    plan = decisions.allocate(alerts).collect()
    got = {r["seq"]: r for r in plan}
    for seq, clock, cause, risk, closure, pol, bd, barr, flag, clear in GOLDEN:
        r = got[seq]
        assert r["alert_id"] == f"ALERT-20240307-MRX-{seq:03d}"
        assert (r["deploy_police"], r["deploy_breakdown"], r["deploy_barricades"]) == (pol, bd, barr), seq
        assert r["resource_flag"].startswith("ALLOCATED" if flag == "ALLOCATED" else "RESOURCE SHORTFALL")
        assert r["estimated_clearance_ist"].startswith(clear)
        assert r["time_ist"] == clock[:5] + " IST"
    water = got[4]
    assert water["deploy_now"] == ("Deploy 4 traffic police, 3 breakdown units, 3 barricades -> Mysore Road, "
                                   "ETA: subject to fleet positioning")
    assert water["confidence_band"] == "HIGH" and water["prio_flag"] == "PRIORITY DEPLOYMENT"
    assert water["estimated_clearance_ist"].endswith("(clears in ~72h 38m)")


def _python_greedy(reqs, cap):
    left, out = cap, []
    for r in reqs:
        a = min(r, left)
        left -= a
        out.append(a)
    return out


def test_closed_form_allocation_equals_greedy_loop(spark):
    rnd = random.Random(3)
    rows = []
    for plan in range(6):
        for seq in range(1, rnd.randint(1, 25)):
            rows.append(("P%d" % plan, dt.date(2024, 1, 1), seq, round(rnd.choice([0.1, 0.4, 0.5, 0.7, 0.9]), 2),
                         rnd.randint(0, 6), rnd.randint(0, 3), rnd.randint(0, 5)))
    df = spark.createDataFrame(rows, "corridor string, date date, seq long, risk_score double, "
                                     "police_needed long, breakdown_needed long, barricades_needed long")
    got = decisions.allocate(df).collect()
    by_plan = {}
    for r in got:
        by_plan.setdefault(r["corridor"], []).append(r)
    for plan, rs in by_plan.items():
        rs.sort(key=lambda r: (-r["risk_score"], r["seq"]))
        for col, cap in (("police", 50), ("breakdown", 8), ("barricades", 20)):
            want = _python_greedy([r[f"{col}_needed"] for r in rs], cap)
            assert [r[f"deploy_{col}"] for r in rs] == want
            assert sum(want) <= cap


def test_deploy_message_and_durations(spark):
    df = spark.createDataFrame([(0, 0, 0, 59), (2, 0, 1, 120), (0, 3, 0, 4358)],
                               "p int, b int, r int, m int")
    rows = df.select(X.deploy_message("p", "b", "r", F.lit("X Road")).alias("msg"),
                     X.relative_duration("m").alias("rel")).collect()
    assert rows[0]["msg"] == "Monitor X Road - no immediate deployment required"
    assert rows[1]["msg"].startswith("Deploy 2 traffic police, 1 barricades -> X Road")
    assert [r["rel"] for r in rows] == ["~59 min", "~2h", "~72h 38m"]


def test_bands_and_tiers(spark):
    df = spark.createDataFrame([(0.75,), (0.65,), (0.45,), (0.35,), (0.05,)], "risk_score double")
    rows = df.select(X.band("risk_score").alias("b"),
                     X.band("risk_score", (((0.60, "RED"), (0.30, "AMBER"))), "GREEN").alias("t")).collect()
    assert [r["b"] for r in rows] == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]
    assert [r["t"] for r in rows] == ["RED", "RED", "AMBER", "AMBER", "GREEN"]


def test_nested_alert_document(spark):
    import json

    import __spark_entry__ as E
    from conftest import SF001
    doc = json.loads(E.queries()["alerts_nested"](spark, SF001).first()["alert_json"])
    assert set(doc) == {"alert_id", "trigger", "cascade_prediction", "deployment",
                        "estimated_clearance_ist", "driver_top3", "driver_values3"}
    assert set(doc["deployment"]) == {"DEPLOY_NOW", "ALERT_STATIONS", "STANDBY", "police_needed",
                                      "breakdown_needed", "barricades_needed", "police_flag", "prio_flag"}
    assert len(doc["driver_top3"]) == 3 and min(doc["driver_values3"]) >= 0.001


def test_ranks_store_only_what_an_alert_shows(spark, monkeypatch):
    from ripple.operators import prefix
    kept, store = [], prefix.checked_small
    monkeypatch.setattr(prefix, "checked_small", lambda df: kept.append(df.columns) or store(df))
    wide = _golden_input(spark).withColumns({"day_name": F.date_format("date", "EEEE"), "latitude": F.lit(1.0)})
    out = decisions.build_alerts(wide)
    assert out.count() == len(GOLDEN) and "latitude" not in out.columns
    assert len(kept) == 1 and {"day_name", "latitude"}.isdisjoint(kept[0])
