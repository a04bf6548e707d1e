"""Driver contract: entry(), queries() / oracle_sql() consistency, oracle matches."""

import os
import subprocess
import sys

import duckdb

import __spark_entry__ as E
from conftest import SF001
from tools.oracle_check import TABLES, rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_lists_every_named_corridor(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["corridor", "seed_count", "total_secondary_events"]
    assert len(rows) == 14 and all(r["seed_count"] == 0 for r in rows)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 70


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def test_sql_checked_queries_match_at_smoke_scale(spark):
    con = _duck(SF001)
    qs, sql = E.queries(), E.oracle_sql()
    bad = []
    for name in sorted(sql):
        if name.startswith("stream_"):
            continue
        sdf = qs[name](spark, SF001)
        res = con.execute(sql[name])
        dcols = [d[0] for d in res.description]
        if sorted(sdf.columns) != sorted(dcols):
            bad.append((name, "columns"))
            continue
        if rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) != rows_of(dcols, res.fetchall()):
            bad.append((name, "values"))
    assert not bad, bad


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_REPEAT="1", BENCH_CPUS="2",
               BENCH_QUERIES="seeds_by_corridor,heatmap")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600)
    lines = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert len(lines) == 1 and '"queries"' in lines[0]
