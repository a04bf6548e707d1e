"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripple.session import checkpoint_dir, scratch_path

# rows of one Arrow batch that a Python task works on at once
SLICE_ROWS = 256


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    It cuts the lineage and survives lost executors; every reader gets the
    same rows, so row numbers made before it are stable after it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, which bounds a task's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session plans with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_crc32(col):
    """CRC-32 of the UTF-8 bytes, 0 to 2**32-1 (null stays null)."""
    return F.crc32(col.cast("binary"))


def positions(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (stored ones) with ``pos``, from 0, in each group by ``order`` (nulls first), stored.

    A group of any size is spread over range partitions: a place is a rank inside
    the partition plus the rows of the group in the partitions before it.  Rows
    equal in all these columns follow in any order.
    """
    spark = rows.sparkSession
    by = [*group, *order, "_uid"]
    ranged = stored(rows.withColumn("_uid", F.monotonically_increasing_id())
                    .repartitionByRange(partitions(spark), *by).withColumn("_part", F.spark_partition_id()), name)
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_own")).select(
        F.col("_part").alias("_at"), *(F.col(g).alias(f"_g_{g}") for g in group),
        F.coalesce(F.sum("_own").over(upto), F.lit(0)).alias("_before")), f"{name}-offsets")
    same = F.col("_part") == F.col("_at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order, "_uid")) - 1
    return (ranged.withColumn("_inside", inside).join(before, same)
            .select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias("pos")))
