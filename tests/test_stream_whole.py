"""Streams that give a row for every incident, the newest ones too."""

import os

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SF001
from ripple.plans import catalog, catalog_stream, flows
from ripple.streaming import jobs

LOOKBACK = ["id", "corridor", "corridor_events_2h", "corridor_events_6h", "seed_event_present_3h"]


def _sql(name, folder):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    return con.execute(catalog.REGISTRY[name][1]).fetchall()


def _newest(spark, folder, hours):
    """A table of the events of the last hours of sf0.001."""
    events = spark.read.parquet(os.path.join(SF001, "events.parquet"))
    latest = events.agg(F.max("ts")).first()[0]
    rows = events.where(F.col("ts") >= F.lit(latest) - F.expr(f"INTERVAL {hours} HOURS"))
    rows.toPandas().to_parquet(os.path.join(folder, "events.parquet"), coerce_timestamps="us")


def test_lookback_of_every_incident(spark):
    got = sorted(map(tuple, catalog_stream.q_stream_lookback_all(spark, SF001).select(LOOKBACK).collect()))
    batch = flows.labelled(spark, SF001).where(F.col("start_datetime").isNotNull())
    assert got == sorted(map(tuple, batch.select(LOOKBACK).collect()))
    assert got == sorted(_sql("stream_lookback_all", SF001))


def test_lookback_of_a_table_shorter_than_the_windows(spark, tmp_path):
    _newest(spark, str(tmp_path), 5)
    got = sorted(map(tuple, catalog_stream.q_stream_lookback_all(spark, str(tmp_path)).select(LOOKBACK).collect()))
    assert got and got == sorted(_sql("stream_lookback_all", str(tmp_path)))


def _alerts(df):
    return sorted(map(tuple, df.select(alert_columns()).collect()))


def alert_columns():
    return ["corridor", "alert_id", "id", "date", "seq", "start_local", "cascade_probability", "deploy_now",
            "police_needed", "estimated_clearance_ist"]


def test_stream_alerts_are_the_batch_alerts(spark):
    got = catalog_stream.q_stream_alerts(spark, SF001)
    batch = flows.alerts_standin(spark, SF001)
    assert got.columns == batch.columns
    assert _alerts(got) == _alerts(batch) and got.count() > 0
    cols = ", ".join(alert_columns())
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{SF001}/events.parquet')")
    assert len(_alerts(got)) == len(con.execute(
        f"select {cols} from ({catalog.REGISTRY['stream_alerts'][1]})").fetchall())


def _in_parts(spark, folder, parts, order="ts"):
    """sf0.001's events as that many files, read one at a time."""
    events = spark.read.parquet(os.path.join(SF001, "events.parquet")).orderBy(order).toPandas()
    n, folder = len(events), folder / "in"
    folder.mkdir()
    for i in range(parts):
        target = folder / f"events{i}.parquet"
        events.iloc[i * n // parts:(i + 1) * n // parts].to_parquet(target, coerce_timestamps="us")
        os.utime(target, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    schema = spark.read.parquet(os.path.join(SF001, "events.parquet")).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events?.parquet").option("maxFilesPerTrigger", 1)
    return jobs.cleaned(raw.parquet(str(folder)))


class Stopped(Exception):
    pass


def test_alerts_over_batches_and_a_run_that_is_stopped(spark, tmp_path, monkeypatch):
    # a batch stops between two of its writes; a new run goes on from its checkpoint and gives the same alerts
    want = _alerts(flows.alerts_standin(spark, SF001))
    eng, sdf, base = flows.engineered(spark, SF001), _in_parts(spark, tmp_path, 4), str(tmp_path / "run")
    whole = jobs.scored_alert_sink

    def stopping(path, engineered):
        write = whole(path, engineered)

        def run(batch_df, batch_id):
            write(batch_df, batch_id)
            if batch_id == 2:                # as if stopped before the manifest: half the alerts are on disk
                os.rename(os.path.join(path, "manifest", "batch_id=2"), str(tmp_path / "torn"))
                raise Stopped
        return run

    monkeypatch.setattr(jobs, "scored_alert_sink", stopping)
    with pytest.raises(StreamingQueryException):
        jobs.run_alerts(sdf, eng, "t_alerts", base)
    out = os.path.join(base, "out")
    assert jobs.manifests(spark, out) == [0, 1]
    assert set(_alerts(jobs.committed_alerts(spark, out))) < set(want)
    monkeypatch.setattr(jobs, "scored_alert_sink", whole)
    assert _alerts(jobs.run_alerts(sdf, eng, "t_alerts", base)) == want and want
    done = jobs.manifests(spark, out)
    assert len(done) >= 4
    again = spark.read.parquet(os.path.join(out, "rows", f"batch_id={done[-1]}"))
    whole(out, eng)(spark.createDataFrame(again.collect(), again.schema), done[-1])
    assert _alerts(jobs.committed_alerts(spark, out)) == want
    last = spark.read.parquet(os.path.join(out, "last", f"batch_id={done[-1]}"))
    assert 0 < last.select("date").distinct().count() <= 4      # old days are dropped


def test_arrival_rows_leave_with_their_batch(spark, tmp_path):
    seen = []
    q = (jobs.arrival_lookback(_in_parts(spark, tmp_path, 3)).writeStream
         .foreachBatch(lambda df, i: seen.append({r["id"]: tuple(r)[2:] for r in df.collect()}))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = {r["id"]: (r["corridor_events_2h"], r["corridor_events_6h"], r["seed_event_present_3h"])
             for r in flows.labelled(spark, SF001).where(F.col("start_datetime").isNotNull()).collect()}
    events = spark.read.parquet(os.path.join(SF001, "events.parquet")).orderBy("ts").collect()
    of = {r["event_id"]: i for i in range(3) for r in events[i * len(events) // 3:(i + 1) * len(events) // 3]}
    filled = [s for s in seen if s]
    assert len(filled) == 3 and all(of[i] == k for k, s in enumerate(filled) for i in s)
    assert {i: v for s in filled for i, v in s.items()} == batch


def test_arrival_out_of_order(spark, tmp_path):
    # rows within the delay count what has arrived; a row behind the watermark is dropped
    day = "2024-01-05 "
    times = {1: "10:00:00", 2: "10:50:00", 3: "10:20:00", 4: "11:40:00", 5: "09:00:00", 6: "11:50:00"}
    (tmp_path / "in").mkdir()
    for i, ids in enumerate([(1, 2), (3,), (4,), (5, 6)]):
        rows = spark.createDataFrame([(k, day + times[k]) for k in ids], "id long, t string").select(
            "id", F.col("t").cast("timestamp").alias("event_time"), F.col("t").cast("timestamp_ntz").alias("start_datetime"),
            F.lit("A").alias("corridor"), F.lit("others").alias("event_cause_grouped"))
        rows.toPandas().to_parquet(tmp_path / "in" / f"in{i}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "in" / f"in{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    schema = "id long, event_time timestamp, start_datetime timestamp_ntz, corridor string, event_cause_grouped string"
    sdf = spark.readStream.schema(schema).option("pathGlobFilter", "in?.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["id"]: r["corridor_events_2h"] for r in jobs.run_available(jobs.arrival_lookback(sdf), "t_order").collect()}
    # 2 was given out before 3 came; 3 counts 1; 4 counts 1, 2, 3; 5 is too late; 6 counts 1 to 4
    assert got == {1: 0, 2: 1, 3: 1, 4: 3, 6: 4}


@pytest.mark.parametrize("name", ["stream_seed_labels", "stream_hourly", "stream_lookback", "stream_arrival", "stream_alert_sink"])
def test_streams_give_every_row(spark, tmp_path, name):
    _newest(spark, str(tmp_path), 5)                            # shorter than all windows
    for folder in (SF001, str(tmp_path)):
        df = catalog.REGISTRY[name][0](spark, folder)
        con = duckdb.connect()
        con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
        want = con.execute(f"select {', '.join(df.columns)} from ({catalog.REGISTRY[name][1]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want) and want


@pytest.mark.parametrize("make", [jobs.stream_seed_labels, jobs.window_lookback])
def test_final_counts_build_no_pairs(spark, make):
    # a join of a corridor's rows with each other grows with the square of its density
    plan = make(jobs.incident_stream(spark, SF001))._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_final_counts_of_repeated_and_missing_ids(spark, tmp_path):
    day = "2024-01-05 "
    rows = [(1, "10:00:00"), (1, "10:00:00"), (2, "10:30:00"), (None, "11:00:00"), (2, "11:30:00"), (3, "11:30:00"),
            (None, "23:00:00")]
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(i, day + t) for i, t in rows], "id long, t string").select(
        "id", F.col("t").cast("timestamp").alias("event_time"), F.col("t").cast("timestamp_ntz").alias("start_datetime"),
        F.lit("A").alias("corridor"), F.lit("others").alias("event_cause_grouped")).coalesce(1).write.parquet(str(tmp_path / "in" / "x"))
    schema = "id long, event_time timestamp, start_datetime timestamp_ntz, corridor string, event_cause_grouped string"
    sdf = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "x"))
    got = {(r["seed_id"], r["seed_time"].strftime("%H:%M")): r["secondary_count"]
           for r in jobs.run_to_end(jobs.stream_seed_labels, sdf, "t_odd").collect()}
    # the two rows 1 count 2, 2 and 3 each; followers without an id are not counted
    assert got == {(1, "10:00"): 6, (2, "10:30"): 2, (None, "11:00"): 2, (2, "11:30"): 0, (3, "11:30"): 0, (None, "23:00"): 0}
    back = {(r["id"], r["corridor_events_2h"], r["corridor_events_6h"], r["seed_event_present_3h"])
            for r in jobs.run_to_end(jobs.window_lookback, sdf, "t_odd").collect()}
    # rows of one id never count each other; the row without an id at 23:00 has nothing before it and no row
    assert back == {(1, 0, 0, 0), (2, 2, 2, 0), (None, 0, 0, 0), (2, 2, 2, 0), (3, 4, 4, 0)}
