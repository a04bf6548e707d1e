"""Joins against small derived tables (lookups, per-key aggregates).

A derived lookup (station -> modal zone, corridor -> risk, corridor ->
total) has one row per key of a dimension.  It is written once to the shared
checkpoint folder, under a name of its own, and read back: Catalyst then knows
its size in bytes and broadcasts it below
``spark.sql.autoBroadcastJoinThreshold``; beyond that the join is a shuffle
join with AQE's skew handling.  Nothing is kept in the session's cache, so a
later read of a replaced input never meets an older lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ripple.session import scratch_path


def checked_small(dim: DataFrame) -> DataFrame:
    """``dim`` stored in the shared folder, with its size known to the optimizer."""
    spark = dim.sparkSession
    path = scratch_path(spark, "lookup")
    dim.write.parquet(path)
    return spark.read.schema(dim.schema).parquet(path)


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """``df`` joined with a derived lookup, broadcast by its measured size."""
    return df.join(checked_small(dim), on=on, how=how)
