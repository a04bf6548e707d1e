"""Structured Streaming jobs on an incident stream.

* T1 ``stream_seed_labels``: overlapping event-time windows of a corridor's rows with a
  watermark, then a count per seed inside each window (append mode).
* T2 ``stream_hourly``: tumbling one-hour windows on local clock hours
  (``startTime`` = the +05:30 offset), append mode.
* T3 ``arrival_lookback``: look-back features at arrival, from keyed state that
  expires by event time.  ``stream_lookback`` gives final ones, by an interval
  join, and ``window_lookback`` the same, a bucket at a time, from windows as in T1; ``lookback_tail`` gives what these hold back while their input is open.
* T4 ``scored_alert_sink``: ``foreachBatch`` function that scores look-back rows
  and commits their alerts once; ``alert_sink`` writes rows, idempotent per batch.

A stream that ends is closed by ``end_marks``: a row far in the future lets the
watermark pass everything, so state that waits for time is given out
(``run_to_end``).

Event time is a TIMESTAMP (instant) derived from the UTC wall clock.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators import cascade, clean, decisions
from ripple.session import scratch_path
from ripple.sources import adapter


def incident_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Streaming incidents from the ``events`` table file(s), lightly cleaned."""
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return cleaned(r.parquet(sf_dir))


END_MARK = "(end of input)"
END_TIMES = ("9000-01-01 00:00:00", "9000-02-01 00:00:00")


def end_marks(sdf: DataFrame, folder: str) -> DataFrame:
    """``sdf`` and the end marks that are written to ``folder``: rows of a corridor of their own, without an id.

    Both sides may hold nulls in the same columns: a batch in which one side has no
    rows must have the schema of the state that other batches wrote.
    """
    spark = sdf.sparkSession
    spark.createDataFrame([], "event_time timestamp").write.mode("append").parquet(folder)
    marks = spark.readStream.schema("event_time timestamp").parquet(folder)
    given = {"event_time": F.col("event_time"), "start_datetime": F.col("event_time").cast("timestamp_ntz"),
             "corridor": F.lit(END_MARK)}
    columns = []
    for f in sdf.schema:
        value = given.get(f.name, F.lit(None) if f.nullable else F.lit("0").cast(f.dataType))
        if f.nullable and f.name in given:
            value = F.when(F.col("event_time").isNotNull(), value)
        columns.append(value.cast(f.dataType).alias(f.name))
    return sdf.unionByName(marks.select(*columns))


def incident_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents of :func:`incident_stream` as a batch."""
    return cleaned(spark.read.parquet(os.path.join(sf_dir, "events.parquet")))


def cleaned(events: DataFrame) -> DataFrame:
    """Incidents of a stream of ``events`` rows, lightly cleaned, with event and local time."""
    raw = adapter.incidents_from_events(events)
    df = clean.parse_ts(clean.null_sentinels(raw))
    df = clean.fill_defaults(df)
    df = clean.drop_noise(clean.normalise_causes(df))
    return df.withColumns({
        "event_time": F.timestamp_micros(X.epoch_micros("start_datetime")),
        "start_local": X.to_local("start_datetime"),
    })


def _gathered(sdf: DataFrame, minutes: int, delay: str, *columns) -> DataFrame:
    """``corridor, start, rows``: the rows of each corridor and window of twice ``minutes``, which start every ``minutes``.

    A window is given out, once, when the watermark has passed its end.  It holds the
    rows of one time bucket and of the bucket next to it, so all counts over spans up
    to ``minutes`` are found inside it by sorting, and no pairs are built: state,
    output and work grow with the rows, however dense a corridor is.
    """
    rows = F.collect_list(F.struct(X.epoch_micros("start_datetime").alias("us"), *columns))
    return (sdf.withWatermark("event_time", delay)
            .groupBy("corridor", F.window("event_time", f"{2 * minutes} minutes", f"{minutes} minutes").alias("w"))
            .agg(rows.alias("rows")).select("corridor", F.unix_micros("w.start").alias("start"), "rows"))


def _each_window(df: DataFrame, count, schema: str) -> DataFrame:
    """``count(corridor, start, rows)``, a table of ``schema``, for each window of :func:`_gathered`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for corridor, start, rows in zip(batch.column("corridor"), batch.column("start"), batch.column("rows")):
                yield from count(corridor.as_py(), start.as_py(), rows.values).to_batches()

    return df.mapInArrow(run, schema)


def _ranked(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ``ids`` from 1; 0 for nulls."""
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    return np.where(ids.is_valid().to_numpy(zero_copy_only=False), rank, 0).astype(np.int64)


def _groups(us: np.ndarray, rank: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row (its index) for each time and id among the rows ``own``, and the number of such rows."""
    here = np.flatnonzero(own)
    _, first, times = np.unique(np.c_[us[here], rank[here]], axis=0, return_index=True, return_counts=True)
    return here[first], times


def stream_seed_labels(sdf: DataFrame, minutes: int = K.FOLLOW_MINUTES,
                       min_followers: int = K.MIN_FOLLOWERS, delay: str | None = None) -> DataFrame:
    """The follow-on count of every incident of a named corridor, 0 included.

    Rows are gathered by (corridor, time bucket as wide as the window) together with
    the next bucket's, so a hot corridor is spread over its buckets.  A bucket's counts
    are final, and given out, once the watermark passes the end of the next bucket;
    rows whose windows have been given out are dropped by Spark.  A follower without
    an id is not counted; rows of one id and time are one row, whose counts add up.
    """
    delay = delay or f"{minutes} minutes"
    named = sdf.where(X.is_named_corridor("corridor") & F.col("event_time").isNotNull())
    kind = dict(sdf.dtypes)["id"]
    width = minutes * 60_000_000

    def count(corridor: str, start: int, rows: pa.StructArray) -> pa.Table:
        us, ids = rows.field("us").to_numpy(zero_copy_only=False), rows.field("id")
        rank = _ranked(ids)
        at, times = _groups(us, rank, us < start + width)
        follows = np.sort(us[rank > 0])
        n = np.searchsorted(follows, us[at] + width, "right") - np.searchsorted(follows, us[at], "right")
        return pa.table({"seed_id": ids.take(pa.array(at)), "corridor": pa.array([corridor] * len(at), pa.string()),
                         "us": us[at], "secondary_count": n * times})

    counts = _each_window(_gathered(named, minutes, delay, "id"), count,
                          f"seed_id {kind}, corridor string, us long, secondary_count long")
    return counts.select("seed_id", "corridor", F.timestamp_micros("us").alias("seed_time"), "secondary_count",
                         (F.col("secondary_count") >= min_followers).alias("is_cascade_seed"))


def stream_hourly(sdf: DataFrame, delay: str = "1 hour", tz_offset_minutes: int = 330) -> DataFrame:
    """Incidents per named corridor and local clock hour."""
    start = f"{tz_offset_minutes % 60} minutes"
    named = sdf.where(X.is_named_corridor("corridor") & F.col("event_time").isNotNull()) \
               .withWatermark("event_time", delay)
    agg = named.groupBy("corridor", F.window("event_time", "1 hour", startTime=start).alias("w")) \
               .agg(F.count(F.lit(1)).alias("event_count"))
    utc_wall = F.col("w.start").cast("timestamp_ntz")
    return agg.select("corridor", X.to_local(utc_wall).alias("hourly_bucket"), "event_count")


def stream_lookback(sdf: DataFrame, hours=K.LOOKBACK_HOURS, seed_hours: int = K.SEED_LOOKBACK_HOURS,
                    seed_causes=K.SEED_CAUSES, delay: str = "1 hour") -> DataFrame:
    """Look-back counts per incident by a stream-stream interval join.

    An incident meets those of its corridor that come before it, by (time,
    id), within the widest window, and itself; the counts are conditional.
    The join key holds a time bucket as wide as that window, so a hot corridor
    is spread over its buckets.  Late-row rule: rows older than the watermark
    (latest incident less ``delay``) are dropped by Spark and counted in the
    progress (``numRowsDroppedByWatermark``); an incident's row is emitted, once
    and final, when the watermark has passed it by the widest window, whatever
    the order of arrival before that.
    """
    h_short, h_long = sorted(hours)
    widest = max(h_long, seed_hours)
    width = widest * 3_600_000_000
    named = sdf.where(F.col("start_datetime").isNotNull())
    bucket = F.floor(X.epoch_micros("start_datetime") / width)
    rows = named.select("id", "corridor", F.col("event_time").alias("at"), bucket.alias("bucket")).withWatermark("at", delay)
    earlier = named.select(
        F.col("id").alias("e_id"), F.col("corridor").alias("e_corridor"), F.col("event_time").alias("e_at"),
        F.col("event_cause_grouped").isin(*seed_causes).alias("e_seed"),
        F.explode(F.array(bucket, bucket + 1)).alias("e_bucket")).withWatermark("e_at", delay)
    pairs = rows.join(earlier, F.expr(
        f"corridor = e_corridor AND bucket = e_bucket AND e_at <= at AND e_at >= at - INTERVAL {widest} HOURS"
        " AND (e_at < at OR e_id <= id)"))
    other = F.col("e_id") != F.col("id")
    within = lambda h: other & (F.col("e_at") >= F.col("at") - F.expr(f"INTERVAL {h} HOURS"))
    return pairs.groupBy("id", "corridor", "at").agg(
        F.count_if(within(h_short)).alias("corridor_events_2h"), F.count_if(within(h_long)).alias("corridor_events_6h"),
        F.max((within(seed_hours) & F.col("e_seed")).cast("long")).alias("seed_event_present_3h")).drop("at")


def window_lookback(sdf: DataFrame, hours=K.LOOKBACK_HOURS, seed_hours: int = K.SEED_LOOKBACK_HOURS,
                    seed_causes=K.SEED_CAUSES, delay: str = "1 hour") -> DataFrame:
    """Final look-back counts per incident, by event-time windows.

    An incident counts those of its corridor that come before it, by (time, id),
    within each span.  Rows are gathered by (corridor, time bucket as wide as the
    widest span) together with the bucket before, so a hot corridor is spread over
    its buckets.  An incident's row is emitted, once and final, when the watermark
    (latest incident less ``delay``) has passed the end of its bucket, whatever the
    order of arrival before that; rows whose windows have been given out are dropped
    by Spark and counted in the progress (``numRowsDroppedByWatermark``).  Rows of one
    id and time are one row, whose counts add up; rows of one id never count each
    other, and a row without an id is not counted.  It is given out without counts
    if another comes before it within the widest span.
    """
    h_short, h_long = sorted(hours)
    widest = max(h_long, seed_hours)
    hour = 3_600_000_000
    named = sdf.where(F.col("start_datetime").isNotNull())
    kind = dict(sdf.dtypes)["id"]

    def count(corridor: str, start: int, rows: pa.StructArray) -> pa.Table:
        us, ids = rows.field("us").to_numpy(zero_copy_only=False) - start, rows.field("id")
        seed = rows.field("seed").fill_null(False).to_numpy(zero_copy_only=False)
        rank = _ranked(ids)
        at, times = _groups(us, rank, us >= widest * hour)
        every = np.sort(us)
        # a row without an id
        nameless = rank[at] == 0
        keep = ~nameless | (np.searchsorted(every, us[at]) > np.searchsorted(every, us[at] - widest * hour))
        at, times, nameless = at[keep], times[keep], nameless[keep]
        t, r = us[at], rank[at]
        span, n = 2 * widest * hour, int(rank.max(initial=0)) + 1

        def before(which: np.ndarray, h: int) -> np.ndarray:
            """Rows among ``which`` with another id, within ``h`` hours before each row of ``at``."""
            u, k = us[which], rank[which]
            ordered, by_id = np.sort(u * n + k), np.sort(k * span + u)
            low = np.maximum(t - h * hour, 0)
            same = np.searchsorted(by_id, r * span + t, "right") - np.searchsorted(by_id, r * span + low)
            return np.searchsorted(ordered, t * n + r, "right") - np.searchsorted(ordered, low * n) - same

        counted = rank > 0
        short, long = (np.where(nameless, 0, before(counted, h) * times) for h in (h_short, h_long))
        found = before(counted & seed, seed_hours) > 0
        # without an id it is unknown whether others are others: 0 only if no seed can be among them
        others = np.searchsorted(every, t) - np.searchsorted(every, t - widest * hour)
        near = np.sort(us[seed])
        unknown = nameless & (np.searchsorted(near, t) - np.searchsorted(near, t - seed_hours * hour) == others)
        return pa.table({
            "id": ids.take(pa.array(at)), "corridor": pa.array([corridor] * len(at), pa.string()),
            "corridor_events_2h": short, "corridor_events_6h": long,
            "seed_event_present_3h": pa.array((found & ~nameless).astype(np.int64), mask=unknown)})

    seed = F.col("event_cause_grouped").isin(*seed_causes).alias("seed")
    return _each_window(_gathered(named, widest * 60, delay, "id", seed), count,
                        f"id {kind}, corridor string, corridor_events_2h long, corridor_events_6h long, "
                        "seed_event_present_3h long")


def lookback_tail(incidents: DataFrame, hours=K.LOOKBACK_HOURS, seed_hours: int = K.SEED_LOOKBACK_HOURS,
                  seed_causes=K.SEED_CAUSES, delay: str = "1 hour") -> DataFrame:
    """The rows :func:`window_lookback` holds back when its input ends, counted in batch.

    They are the incidents of the time buckets that end after the watermark, the latest
    incident less the delay; only these and those within the widest span before them are read.
    """
    widest = max(*hours, seed_hours)
    named = incidents.where(F.col("start_datetime").isNotNull())
    mark = named.agg((F.max("start_datetime") - F.expr(f"INTERVAL {delay}")).alias("t"))
    bucket = mark.select(F.floor(X.epoch_micros("t") / F.lit(widest * 3_600_000_000)).cast("int")).scalar()
    open_from = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=bucket * widest)
    near = named.where(F.col("start_datetime") >= open_from - F.expr(f"INTERVAL {widest} HOURS"))
    rows = cascade.cascade_features(near, lookback_hours=hours, seed_hours=seed_hours, seed_causes=seed_causes,
                                    with_density=False)
    return rows.where(F.col("start_datetime") >= open_from).select(
        "id", "corridor", *(f"corridor_events_{h}h" for h in sorted(hours)), "seed_event_present_3h")


def alert_sink(path: str):
    """T4: ``foreachBatch`` function writing each batch to its own folder.

    Re-running a batch after a failure overwrites the same folder, so the
    sink is idempotent.
    """
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


def arrival_lookback(sdf: DataFrame, hours=K.LOOKBACK_HOURS, seed_hours: int = K.SEED_LOOKBACK_HOURS,
                     seed_causes=K.SEED_CAUSES, delay: str = "1 hour") -> DataFrame:
    """Look-back counts of every incident in the batch it arrives in.

    State is keyed by (corridor, time bucket as wide as the widest window); a row
    also enters the next bucket as history, and a bucket's state is cleared when
    the watermark passes its end.  A row counts what has arrived before it or with
    it and comes before it by (time, id): for input in order, whatever the batches,
    that is the batch answer.  A row that arrives out of order but within ``delay``
    of the latest one is counted in rows that arrive with or after it; rows given
    out before it are not changed.  Later ones are dropped by Spark.
    """
    h_short, h_long = sorted(hours)
    width = max(h_long, seed_hours) * 3_600_000_000
    named = sdf.where(F.col("start_datetime").isNotNull())
    own = F.floor(X.epoch_micros("start_datetime") / width)
    rows = named.select(
        "id", "corridor", F.col("event_time"), X.epoch_micros("start_datetime").alias("us"),
        F.col("event_cause_grouped").isin(*seed_causes).cast("int").alias("seed"),
        F.explode(F.array(F.struct(own.alias("bucket"), F.lit(1).alias("own")),
                          F.struct((own + 1).alias("bucket"), F.lit(0).alias("own")))).alias("x"))
    rows = rows.select("id", "corridor", "event_time", "us", "seed", "x.bucket", "x.own").withWatermark("event_time", delay)
    kind = dict(rows.dtypes)["id"]
    schema = (f"id {kind}, corridor string, corridor_events_{h_short}h long, corridor_events_{h_long}h long, "
              "seed_event_present_3h long")
    spans = [h * 3_600_000_000 for h in (h_short, h_long, seed_hours)]

    class Lookback(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getListState("seen", f"us long, id {kind}, seed int")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows))
            if not self.seen.exists():
                self.handle.registerTimer(int((key[1] + 1) * width // 1000))     # milliseconds: the bucket's end
            old = pd.DataFrame(list(self.seen.get()), columns=["us", "id", "seed"]).assign(own=0)
            self.seen.appendList([(int(u), i, int(f)) for u, i, f in zip(new["us"], new["id"], new["seed"])])
            every = pd.concat([old, new[["us", "id", "seed", "own"]]]).sort_values(["us", "id"], kind="stable")
            at, seeds = every["us"].to_numpy(np.int64), np.r_[0, np.cumsum(every["seed"].to_numpy(np.int64))]
            here = np.flatnonzero(every["own"].to_numpy() == 1)
            first = [np.searchsorted(at, at[here] - s, "left") for s in spans]
            if len(here):
                yield pd.DataFrame({
                    "id": every["id"].to_numpy()[here], "corridor": key[0],
                    f"corridor_events_{h_short}h": here - first[0], f"corridor_events_{h_long}h": here - first[1],
                    "seed_event_present_3h": (seeds[here] > seeds[first[2]]).astype(np.int64)})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    spark = sdf.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("corridor", "bucket").transformWithStateInPandas(
        Lookback(), schema, "Append", "EventTime")


def scored_alert_sink(path: str, engineered: DataFrame, threshold: float = 0.10, keep_days: int = 3):
    """T3 scoring and T4: ``foreachBatch`` function from look-back rows to alerts under ``path``.

    A batch's look-back rows take the other columns from ``engineered`` by id (a
    batch table: its corridor risk and cap of resolution times know all its rows),
    get the stand-in score and become alerts with the key ``(corridor, alert_id)``.
    The alerts of a corridor-day go on from the number that earlier batches
    reached, which the table ``last`` keeps for the newest ``keep_days`` days (rows
    of older days are later than any watermark).

    A batch writes ``rows``, ``alerts`` and ``last`` under its id and then its
    manifest, which makes it count.  Stopped anywhere and run again, it starts from
    the ``last`` table of the manifest before it and overwrites its own folders, so
    alerts are written once; ``committed_alerts`` only reads batches with a manifest.
    """
    def write(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        folder = lambda kind, of=batch_id: os.path.join(path, kind, f"batch_id={of}")
        done = [i for i in manifests(spark, path) if i < batch_id]
        # read more than once below: a stateful batch must run only once
        batch_df.write.mode("overwrite").parquet(folder("rows"))
        rows = spark.read.schema(batch_df.schema).parquet(folder("rows"))
        alerts = decisions.build_alerts(decisions.standin_score(rows.drop("corridor").join(engineered, "id")), threshold)
        none = spark.createDataFrame([], "corridor string, date date, last long")
        last = spark.read.schema(none.schema).parquet(folder("last", done[-1])) if done else none
        before = last.withColumnRenamed("last", "_before")
        seq = F.col("seq") + F.coalesce("_before", F.lit(0))
        alerts = alerts.join(before, ["corridor", "date"], "left").withColumn("seq", seq).withColumn(
            "alert_id", F.concat(F.regexp_replace("alert_id", "[0-9]+$", ""), F.format_string("%03d", "seq"))
        ).select(*alerts.columns)
        alerts.write.mode("overwrite").parquet(folder("alerts"))
        written = spark.read.schema(alerts.schema).parquet(folder("alerts"))
        reached = written.groupBy("corridor", "date").agg(F.max("seq").cast("long").alias("last")).unionByName(last)
        newest = reached.groupBy("corridor", "date").agg(F.max("last").alias("last"))
        latest = newest.agg(F.max("date")).scalar()
        newest.where(F.col("date") > F.date_sub(latest, keep_days)).write.mode("overwrite").parquet(folder("last"))
        spark.range(1).select(F.lit(batch_id).cast("long").alias("id")).coalesce(1).write.mode("overwrite").parquet(
            folder("manifest"))
    return write


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches that are written to the end, rising (one row each)."""
    try:
        found = spark.read.schema("id long").parquet(os.path.join(path, "manifest"))
        return sorted(r["id"] for r in found.select("id").collect())
    except AnalysisException:
        return []


def committed_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all batches with a manifest."""
    done = spark.read.schema("id long").parquet(os.path.join(path, "manifest")).select(F.col("id").alias("_done"))
    alerts = spark.read.parquet(os.path.join(path, "alerts"))
    return alerts.join(done, F.col("batch_id") == F.col("_done"), "left_semi").drop("batch_id")


def run_alerts(sdf: DataFrame, engineered: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run the rows of :func:`arrival_lookback` through :func:`scored_alert_sink` and read the alerts.

    With ``base``, a folder, checkpoint and output stay there: a run that was
    stopped goes on where its last manifest left off.
    """
    spark = sdf.sparkSession
    base = base or scratch_path(spark, name)
    out = os.path.join(base, "out")
    q = (arrival_lookback(sdf).writeStream.foreachBatch(scored_alert_sink(out, engineered))
            .option("checkpointLocation", os.path.join(base, "_checkpoint"))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return committed_alerts(spark, out)


def run_to_end(make, incidents: DataFrame, name: str) -> DataFrame:
    """Run ``make(stream)`` over the incidents and the end marks behind them; all rows it ever gives.

    The marks arrive one at a time after everything else, each in a run of its own.
    """
    spark = incidents.sparkSession
    base = scratch_path(spark, name)
    ends = os.path.join(base, "ends")
    sdf = make(end_marks(incidents, ends))
    for mark in (None, *END_TIMES):
        if mark:
            spark.range(1).select(F.lit(mark).cast("timestamp").alias("event_time")).coalesce(1).write.mode("append").parquet(ends)
        q = (sdf.writeStream.outputMode("append").format("parquet")
                .option("checkpointLocation", os.path.join(base, "_checkpoint"))
                .trigger(availableNow=True).start(os.path.join(base, "out")))
        q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).where(F.col("corridor") != END_MARK)


def run_available(sdf: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available (``availableNow``)
    into a Parquet folder under the shared checkpoint folder; return it as
    a batch DataFrame."""
    spark = sdf.sparkSession
    base = scratch_path(spark, name)
    q = (sdf.writeStream.outputMode(mode).format("parquet")
            .option("checkpointLocation", os.path.join(base, "_checkpoint"))
            .trigger(availableNow=True).start(os.path.join(base, "out")))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def run_foreach(sdf: DataFrame, name: str) -> DataFrame:
    """Run a stream through :func:`alert_sink` and read the result back."""
    spark = sdf.sparkSession
    base = scratch_path(spark, name)
    q = (sdf.writeStream.foreachBatch(alert_sink(os.path.join(base, "out")))
            .option("checkpointLocation", os.path.join(base, "_checkpoint"))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))
