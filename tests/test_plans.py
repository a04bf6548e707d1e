"""Plan-shape rules that make the queries scale (checked on the physical plans)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from ripple.operators import cascade
from ripple.plans import flows

SKIP = ("ml_", "stream_")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_no_cartesian_or_nested_loop_joins(spark):
    bad = []
    for name, fn in E.queries().items():
        if name.startswith(SKIP) or "roundtrip" in name or name == "engineered_export":
            continue
        txt = _plan(fn(spark, SF001))
        if "CartesianProduct" in txt or "NestedLoopJoin" in txt:
            bad.append(name)
    assert not bad, bad


def test_cascade_windows_share_one_shuffle(spark):
    txt = _plan(E.queries()["cascade_features"](spark, SF001))
    nodes = re.split(r"\n(?=\(\d+\) )", txt)
    windows = [n for n in nodes if re.match(r"\(\d+\) Window\n", n) and "_part#" in n]
    exchanges = [n for n in nodes if re.match(r"\(\d+\) Exchange\n", n) and "_part#" in n]
    assert len(windows) == 2            # RANGE frames + peer ranks over (corridor, bucket)
    assert len(exchanges) == 1          # one exchange feeds both


def test_scan_reads_only_needed_columns(spark):
    txt = _plan(E.queries()["seeds_by_corridor"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
    assert schemas and all("event_type" not in s and "value" not in s for s in schemas)


def test_hot_corridor_spreads_over_buckets(spark):
    # every incident on one corridor: the window partitions are (corridor, bucket)
    one = flows.label_input(spark, SF001).withColumn("corridor", F.lit("Corridor 01"))
    t = cascade._bucketed(one, "start_datetime", "corridor", 120 * 60_000_000, 0, None)
    sizes = t.groupBy("corridor", "_nul", "_part").count()
    total, biggest, parts = sizes.agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert parts > 50 and biggest < total / 20
    out = cascade.follow_count(one)
    assert out.count() == one.count()
