"""Readers and writers for incident tables and plans.

Schemas are explicit (no inference pass over the data).  Writers are
plain DataFrameWriter calls, so they run in parallel on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripple.operators import clean

# Numeric columns of the raw export; every other column is read as text.
NUMERIC_COLUMNS = ("latitude", "longitude")
# Keep cell text exactly as written (Spark's CSV writer trims by default).
CSV_OPTS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Columns dropped from the engineered export (raw/intermediate ones).
EXPORT_DROP = ("start_datetime", "closed_datetime", "resolved_datetime", "day_name", "month_name", "date")


def _header_schema(spark: SparkSession, path: str, numeric=()) -> T.StructType:
    """Schema from the header line only (no inference pass over the data)."""
    header = spark.read.options(**CSV_OPTS).csv(path).columns
    return T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType(), True)
                         for c in header])


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_token: str | None = None) -> DataFrame:
    """Header CSV, every column read as text (no inference).

    An empty cell is NULL; with ``null_token`` only that token is NULL and a
    quoted empty cell stays an empty string.
    """
    schema = schema or _header_schema(spark, path)
    r = spark.read.schema(schema).options(**CSV_OPTS).option("mode", "PERMISSIVE")
    if null_token is not None:
        r = r.option("nullValue", null_token)
    return r.csv(path)


def read_incidents(spark: SparkSession, path: str, fmt: str = "csv",
                   null_token: str | None = None) -> DataFrame:
    """Incident table, text columns by header name, coordinates as
    doubles; timestamps parsed to UTC wall clock (``+00`` offsets honoured,
    unparsable or ``NULL`` -> NULL)."""
    if fmt == "csv":
        df = read_raw(spark, path, _header_schema(spark, path, NUMERIC_COLUMNS), null_token)
    else:
        df = spark.read.format(fmt).load(path)
    df = df.withColumn("id", F.col("id").cast("long")) if dict(df.dtypes).get("id") == "string" else df
    return clean.parse_ts(df)


def read_engineered(spark: SparkSession, path: str) -> DataFrame:
    """S3: the exported engineered table (Parquet), local time parsed."""
    df = spark.read.parquet(path)
    if "start_local" in df.columns:
        df = df.withColumn("start_local", F.col("start_local").cast("timestamp_ntz"))
    return df


def write_engineered(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("month",)) -> None:
    """Export the engineered table without raw/intermediate columns,
    partitioned by month (partition pruning for date filters)."""
    out = df.drop(*[c for c in EXPORT_DROP if c in df.columns])
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTS).csv(path)
    else:
        w.format(fmt).save(path)


def write_raw(df: DataFrame, path: str, null_token: str | None = None) -> None:
    """Raw incidents as header CSV text (cells kept verbatim)."""
    w = df.write.mode("overwrite").options(**CSV_OPTS)
    if null_token is not None:
        w = w.option("nullValue", null_token)
    w.csv(path)


def write_plan(plan: DataFrame, path: str, fmt: str = "csv") -> None:
    """Plan as header CSV or JSON Lines (one record per line)."""
    w = plan.write.mode("overwrite")
    if fmt == "csv":
        w.options(**CSV_OPTS).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def read_plan(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    schema = ("alert_id string, corridor string, time_ist string, seed_cause string, risk_score double, "
              "deploy_police bigint, deploy_breakdown bigint, deploy_barricades bigint, "
              "estimated_clearance string, resource_flag string")
    r = spark.read.schema(schema)
    return r.options(**CSV_OPTS).csv(path) if fmt == "csv" else r.json(path)
