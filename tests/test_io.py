"""Sources and sinks: text round trip, month-partitioned export with pruning."""

import contextlib
import io as sio

from pyspark.sql import functions as F

from conftest import SF001
from ripple.operators import clean
from ripple.plans import flows
from ripple.session import scratch_path
from ripple.sources import io


def test_raw_text_round_trip_keeps_cells(spark):
    q = __import__("__spark_entry__").queries()["raw_csv_roundtrip"](spark, SF001)
    raw = flows.raw(spark, SF001)
    cols = ["id", "start_datetime", "closed_datetime", "veh_type", "requires_road_closure", "event_cause"]
    assert q.select(cols).exceptAll(raw.select(cols)).count() == 0
    assert q.where(F.col("veh_type") == "").count() == raw.where(F.col("veh_type") == "").count() > 0


def test_engineered_export_prunes_partitions(spark):
    path = scratch_path(spark, "t_export")
    io.write_engineered(flows.engineered(spark, SF001), path)
    back = io.read_engineered(spark, path)
    assert "date" not in back.columns and "month" in back.columns
    jan = back.where(F.col("month") == 1)
    buf = sio.StringIO()
    with contextlib.redirect_stdout(buf):
        jan.explain(mode="formatted")
    assert "PartitionFilters: [isnotnull(month" in buf.getvalue()
    assert jan.count() == back.count() > 0


def test_valid_resolution_bounds(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (43200.0,), (43201.0,), (None,)], "resolution_minutes double")
    assert clean.valid_resolution(df, 0, 43200).count() == 2
    assert clean.valid_resolution(df, 0, 43200, hi_inclusive=False).count() == 1
