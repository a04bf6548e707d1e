"""Streams equal their batch counterparts."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from ripple.operators import cascade, timeseries
from ripple.plans import flows
from ripple.streaming import jobs


def test_stream_lookback_equals_batch(spark):
    batch = flows.labelled(spark, SF001).where(F.col("start_datetime").isNotNull())
    cols = ["id", "corridor_events_2h", "corridor_events_6h", "seed_event_present_3h"]
    latest = batch.agg(F.max("start_datetime")).first()[0]
    final = batch.where(F.col("start_datetime") <= F.lit(latest) - F.expr("INTERVAL 420 MINUTES"))
    want = sorted(map(tuple, final.select(cols).collect()))
    stream = jobs.run_available(jobs.stream_lookback(jobs.incident_stream(spark, SF001)), "t_lb")
    assert sorted(map(tuple, stream.select(cols).collect())) == want


def test_stream_lookback_over_several_files_counts_late_rows(spark, tmp_path):
    # four files in time order and one row that comes far too late
    events = spark.read.parquet(os.path.join(SF001, "events.parquet")).orderBy("ts").collect()
    late, rows = events[10], events[:10] + events[11:]
    parts = [rows[i * len(rows) // 4:(i + 1) * len(rows) // 4] for i in range(4)] + [[late]]
    schema = spark.read.parquet(os.path.join(SF001, "events.parquet")).schema
    for i, part in enumerate(parts):
        folder = str(tmp_path / f"part{i}")
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(folder)
        name = next(x for x in os.listdir(folder) if x.endswith(".parquet"))
        target = tmp_path / f"events{i}.parquet"
        target.write_bytes((tmp_path / f"part{i}" / name).read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    (tmp_path / "one").mkdir()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events?.parquet").option("maxFilesPerTrigger", 1)
    stream = jobs.cleaned(raw.parquet(str(tmp_path)))
    got = jobs.run_available(jobs.stream_lookback(stream), "t_files")
    batch = flows.labelled(spark, str(tmp_path / "one")).where(F.col("start_datetime").isNotNull())
    want = {r["id"]: (r["corridor_events_2h"], r["corridor_events_6h"], r["seed_event_present_3h"])
            for r in batch.collect()}
    rows = {r["id"]: (r["corridor_events_2h"], r["corridor_events_6h"], r["seed_event_present_3h"])
            for r in got.collect()}
    assert len(rows) > 0.9 * len(want) and late["event_id"] not in rows
    assert all(want[i] == x for i, x in rows.items())


def test_stream_seed_labels_subset_of_batch(spark):
    # while the input is open the newest seeds wait for the watermark
    out = jobs.run_available(jobs.stream_seed_labels(jobs.incident_stream(spark, SF001)), "t_seeds")
    lab = cascade.follow_count(flows.label_input(spark, SF001))
    batch = {r["id"]: r["secondary_count"] for r in lab.collect()}
    rows = out.collect()
    assert rows and all(batch[r["seed_id"]] == r["secondary_count"] for r in rows)


def test_stream_hourly_subset_of_batch(spark):
    out = jobs.run_available(jobs.stream_hourly(jobs.incident_stream(spark, SF001)), "t_hourly")
    batch = {(r["corridor"], r["hourly_bucket"]): r["event_count"]
             for r in timeseries.hourly_counts(flows.engineered(spark, SF001)).collect()}
    rows = out.collect()
    assert rows and all(batch[(r["corridor"], r["hourly_bucket"])] == r["event_count"] for r in rows)
