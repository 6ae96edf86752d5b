"""Streaming queries (S1-S9): the stream is drained, its table compared with batch SQL."""

from pyspark.sql import functions as F

from catalog.base import query, sql
from catalog.fixtures import written
from nocturne.session import work_folder
from nocturne.sources.adapters import daily_scores, table
from nocturne.streaming import live, sinks


def shaped(s):
    t = F.col("ts").cast("timestamp")
    return s.select(
        "user_id", "event_id", "event_type", t.alias("event_time"), F.floor(F.unix_micros(t) / 1_000_000).alias("timestamp"),
        (40 + F.col("value").cast("int") % 60).alias("hr"),
    )


PARTS, FILES = 3, 4
_FOLDERS = {}


def part_of(rows):
    """Third of the range of event ids; rows without an id come first."""
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    at = F.floor((F.coalesce("event_id", F.lit(low)) - F.lit(low)) * PARTS / F.lit((high or 0) - (low or 0) + 1))
    return F.least(F.lit(PARTS - 1), F.coalesce(at, F.lit(0)))


def event_parts(spark, sf):
    """A folder with ``events`` in ``PARTS`` sets of ``FILES`` files by event id, written one after the other as a device
    sends them; once per application and table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDERS:
        rows = shaped(table(spark, sf, "events"))
        part, folder = part_of(rows), work_folder(spark, "event-parts")
        for i in range(PARTS):
            rows.where(part == i).repartition(FILES).write.mode("append").parquet(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def events(spark, sf, folder=None, files=FILES):
    """The stream of events, a batch for each set of files."""
    schema = shaped(table(spark, sf, "events")).schema
    return live.read_stream(spark, folder or event_parts(spark, sf), schema, "*.parquet", files_per_batch=files)


def drained(spark, stream, name, keys=None):
    folder = work_folder(spark, name)
    if keys:
        return sinks.latest(spark, sinks.upsert(stream, folder, keys), stream.schema)
    return live.written_rows(spark, live.run_available(stream, folder), stream.schema).drop("batch")


def synced(spark, sf):
    """The insert sink after three syncs; each one also sends a fifth of the rows sent before."""
    rows = shaped(table(spark, sf, "events"))
    part, source, folder = part_of(rows), work_folder(spark, "s1-source"), work_folder(spark, "s1")
    for i in range(PARTS):
        again = (part < i) & (F.col("event_id") % 5 == 0)
        rows.where((part == i) | F.coalesce(again, F.lit(False))).write.mode("append").parquet(source)
        sinks.insert_new(events(spark, sf, source, None), folder, ["user_id", "timestamp"], ["event_id"])
    return folder


_E = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, 40 + CAST(trunc(value) AS INT) % 60 AS hr FROM events)"


@query("s1_idempotent_insert", sql(f"SELECT user_id, count(DISTINCT s) AS n_rows FROM {_E} GROUP BY 1"))
def s1(spark, sf):
    rows = sinks.inserted(spark, synced(spark, sf), shaped(table(spark, sf, "events")).schema)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s1_insert_ledger", sql("""
    SELECT b AS batch, count(*) AS offered, count(DISTINCT CASE WHEN b = first THEN (user_id, s) END) AS inserted, count(*) - count(DISTINCT CASE WHEN b = first THEN (user_id, s) END) AS ignored
    FROM (SELECT *, min(b) OVER (PARTITION BY user_id, s) AS first FROM o) GROUP BY 1""", extra=f"""
    p AS (SELECT e.*, least(2, (event_id - low) * 3 // (high - low + 1)) AS part FROM {_E} e, (SELECT min(event_id) AS low, max(event_id) AS high FROM events)),
    o AS (SELECT user_id, s, b FROM p, (SELECT unnest([0, 1, 2]) AS b) WHERE part = b OR (part < b AND event_id % 5 = 0))"""))
def s1_ledger(spark, sf):
    return sinks.ledger(spark, synced(spark, sf)).select("batch", "offered", "inserted", "ignored")


@query("s2_live_counts", sql(f"""
    SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_rows, max(s) AS last_ts, arg_max(hr, (s, event_id)) AS last_hr FROM {_E} GROUP BY 1, 2"""))
def s2(spark, sf):
    rows = drained(spark, live.live_counts(events(spark, sf)), "s2", ["user_id", "day"])
    return rows.withColumn("day", F.to_date("day"))


@query("s3_sync_progress", sql(f"SELECT user_id, min(s) AS first_ts, max(s) AS last_ts, count(*) AS n_rows FROM {_E} GROUP BY 1"))
def s3(spark, sf):
    return drained(spark, live.sync_progress(events(spark, sf)), "s3", ["user_id"])


@query("s4_incremental_export", sql(f"SELECT user_id, count(*) AS n_rows, max(s) AS last_ts FROM {_E} WHERE s > 1704844800 GROUP BY 1"))
def s4(spark, sf):
    folder = work_folder(spark, "s4")
    stream = events(spark, sf)
    live.incremental_export(stream, folder, 1704844800)
    target = live.incremental_export(stream, folder, 1704844800)  # a restart exports nothing twice
    return live.written_rows(spark, target, stream.schema).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("last_ts")
    )


@query("s5_timestamp_gate", sql(f"SELECT user_id, count(*) AS n_rows FROM {_E} WHERE s > 0 AND s < 1704844800 + 86400 GROUP BY 1"))
def s5(spark, sf):
    rows = drained(spark, live.gated(events(spark, sf), 1704844800), "s5")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s6_window_features", sql(f"""
    SELECT user_id, k * 3600 AS start_ts, count(CASE WHEN hr > 30 THEN 1 END) AS n_hr, avg(hr) AS hr_mean, stddev_pop(hr) AS hr_std, min(hr) AS hr_min, max(hr) AS hr_max
    FROM (SELECT user_id, hr, unnest([s // 3600 - 1, s // 3600]) AS k FROM {_E}) GROUP BY 1, 2""", "", "hr_mean hr_std"))
def s6(spark, sf):
    stream = live.window_features(events(spark, sf), "2 hours", "1 hour")
    return drained(spark, stream, "s6", ["user_id", "start_ts"])


@query("s7_activity_sessions", sql(f"""
    SELECT user_id, min(s) AS start_ts, max(s) AS end_ts, count(*) AS n_rows, avg(hr) AS avg_hr, max(hr) AS max_hr FROM (
      SELECT *, sum(CASE WHEN gap < 6 * 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (
        SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM {_E} WHERE hr >= 60)) GROUP BY user_id, k""", "", "avg_hr"))
def s7(spark, sf):
    source, folder = work_folder(spark, "s7-source"), work_folder(spark, "s7")
    rows = shaped(table(spark, sf, "events")).withColumn("closing", F.lit(None).cast("boolean"))
    part = part_of(rows)
    for i in range(PARTS):
        rows.where(part == i).write.mode("append").parquet(source)
        stream = live.activity_sessions(live.read_stream(spark, source, rows.schema, "*.parquet"), 60, "6 hours")
        live.run_available(stream, folder)
    # the same query goes on with the closing row, which emits the sessions still open
    live.closing_row(rows, 60, "27 days").write.mode("append").parquet(source)
    target = live.run_available(stream, folder)
    return live.written_rows(spark, target, stream.schema).drop("batch")


@written
def daily_table(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", "hrv")


@query("s8_running_baseline", sql("""
    SELECT user_id, max(date) AS date, arg_max(ema, date) AS baseline, count(*) AS days FROM ema GROUP BY 1""", "daily", "baseline", recursive=True, extra="""
    d AS (SELECT user_id, date, hrv, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM daily),
    ema AS (SELECT user_id, date, i, hrv AS ema FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.date, d.i, 0.1 * d.hrv + 0.9 * e.ema FROM ema e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1)"""))
def s8(spark, sf):
    """Days arrive in three sets, the second third last, so late days are folded in again."""
    source, folder, days = work_folder(spark, "s8-source"), work_folder(spark, "s8"), daily_table(spark, sf)
    third = F.dayofmonth(F.to_date("date")) % 3
    for k in (0, 2, 1):
        days.where(third == k).write.mode("append").parquet(source)
        stream = live.running_baseline(live.read_stream(spark, source, days.schema, "*.parquet"), "hrv")
        sinks.upsert(stream, folder, ["user_id"])
    return sinks.latest(spark, folder, stream.schema)


@query("s9_daily_counter", sql(f"SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(sum(hr) AS BIGINT) AS total FROM {_E} GROUP BY 1, 2"))
def s9(spark, sf):
    rows = drained(spark, live.daily_counter(events(spark, sf), "hr"), "s9", ["user_id", "day"])
    return rows.withColumn("day", F.to_date("day"))
