"""Cleaning and feature expressions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF001
from ripple.functions import columns as X
from ripple.operators import clean, features, reports


def test_mode_tie_takes_smallest_zone(spark):
    df = spark.createDataFrame(
        [("PS 1", "Zone B"), ("PS 1", "Zone A"), ("PS 1", None), ("PS 2", "Zone C")],
        "police_station string, zone string")
    out = clean.impute_mode(df)
    got = sorted((r["police_station"], r["zone"]) for r in out.collect())
    assert got == [("PS 1", "Zone A"), ("PS 1", "Zone A"), ("PS 1", "Zone B"), ("PS 2", "Zone C")]


def test_resolution_quantiles_and_upper_median(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0, t0 + dt.timedelta(minutes=m), "x") for i, m in enumerate([1, 2, 3, 10])]
    df = spark.createDataFrame(rows, "id long, start_datetime timestamp_ntz, closed_datetime timestamp_ntz, "
                                     "event_cause string")
    r = features.add_resolution(df, floor=None)
    caps = sorted(x["resolution_minutes_capped"] for x in r.collect())
    assert abs(caps[-1] - 9.79) < 1e-9
    s = reports.summary(r.withColumns({"is_open": F.lit(0), "is_peak_hour": F.lit(0),
                                       "is_weekend": F.lit(0), "is_heavy_vehicle": F.lit(0)})).first()
    assert s["median_resolution"] == 2.5
    upper = reports.resolution_by_cause(df).first()
    assert upper["upper_median_minutes"] == 3.0 and upper["n"] == 4


def test_local_hour_crosses_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 6, 20, 40, 10),)], "start_datetime timestamp_ntz")
    r = features.add_time_features(clean.to_local(df)).first()
    assert r["start_local"] == dt.datetime(2024, 3, 7, 2, 10, 10)
    assert r["hour_of_day"] == 2 and r["day_of_week"] == 3 and r["day_name"] == "Thursday"
    assert r["time_label"] == "02:10 IST" and r["is_peak_hour"] == 0


def test_corridor_codes(spark):
    df = spark.createDataFrame([("Mysore Road",), ("ORR East 1",), ("Corridor 07",), ("",)], "c string")
    got = [r[0] for r in df.select(X.corridor_code("c")).collect()]
    assert got == ["MRX", "OEX", "CXX", "XXX"]


def test_flags_vehicle_and_severity(spark):
    df = spark.createDataFrame(
        [(" true ", "High", " BMTC_bus ", 20), ("NULL", "High", "0", 5), ("FALSE", "Low", None, 12),
         ("TRUE", None, "lcv", None)],
        "requires_road_closure string, priority string, veh_type string, hour int")
    df = clean.fill_defaults(clean.null_sentinels(df.withColumn("corridor", F.lit(None).cast("string"))))
    df = features.add_vehicle_features(features.add_severity(df))
    rows = df.select("requires_road_closure", "congestion_severity", "veh_type", "veh_category",
                     "is_heavy_vehicle", X.is_peak("hour").alias("peak"), "corridor", "priority").collect()
    assert [r[0] for r in rows] == [True, False, False, True]
    assert [r[1] for r in rows] == ["high", "medium", "low", "medium"]
    assert [r[2] for r in rows] == ["bmtc_bus", "unknown", "unknown", "lcv"]
    assert [r[3] for r in rows] == ["public_transit", "unknown", "unknown", "freight"]
    assert [r[4] for r in rows] == [1, 0, 0, 0]
    assert [r[5] for r in rows] == [1, 1, 0, 0]
    assert {r[6] for r in rows} == {"Non-corridor"} and rows[3][7] == "Low"


def test_equal_high_counts_give_zero_risk(spark):
    df = spark.createDataFrame([("A", "High"), ("B", "High"), ("C", "Low")], "corridor string, priority string")
    risk = {r["corridor"]: r["corridor_risk_score"] for r in features.corridor_risk(df).collect()}
    assert risk == {"A": 0.0, "B": 0.0}
    out = features.add_corridor_risk(df, features.corridor_risk(df))
    assert {r["corridor"]: r["corridor_risk_score"] for r in out.collect()}["C"] == 0.0


def test_noise_drop_is_null_safe(spark):
    df = spark.createDataFrame([("test_demo",), (" TEST_DEMO",), (None,), ("accident",)], "event_cause string")
    assert clean.drop_noise(df).count() == 2


def test_parse_text_timestamps(spark):
    df = spark.createDataFrame([("2024-03-07 05:21:10.5+00",), ("NULL",), ("garbage",)], "start_datetime string")
    got = [r[0] for r in clean.parse_ts(clean.null_sentinels(df)).collect()]
    assert got[0] == dt.datetime(2024, 3, 7, 5, 21, 10, 500000) and got[1] is None and got[2] is None


def test_timestamp_texts(spark):
    texts = ["2024-03-07", "2024-03-07 10:20:30+00", "2024-03-07T10:20:30Z", "2024-03-07 10:20:30.5+05:30",
             "2024-03-07 10:20:30.25-03", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "start_datetime string")
    got = [str(r[0]) for r in clean.parse_ts(df, ["start_datetime"]).collect()]
    assert got == ["2024-03-07 00:00:00", "2024-03-07 10:20:30", "2024-03-07 10:20:30", "2024-03-07 04:50:30.500000",
                   "2024-03-07 13:20:30.250000", "None", "None"]


def test_a_replaced_input_is_read_anew(spark, tmp_path):
    import os
    from ripple.plans import flows
    schema = spark.read.parquet(os.path.join(SF001, "events.parquet")).schema
    events = spark.read.parquet(os.path.join(SF001, "events.parquet")).collect()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        return {r["id"]: r["corridor_risk_score"] for r in flows.engineered(spark, str(tmp_path)).collect()}

    first = put(events)
    half = put(events[: len(events) // 2])
    spark.catalog.clearCache()
    again = {r["id"]: r["corridor_risk_score"] for r in flows.engineered(spark, str(tmp_path)).collect()}
    assert half == again and any(first[i] != x for i, x in half.items())
