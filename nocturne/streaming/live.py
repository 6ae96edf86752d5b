"""Structured Streaming forms of the live operators.

Every function maps a streaming frame with ``event_time`` to another one;
``run_available`` drains the source into a table and can be called again with the
same folder to continue. State is bounded by the watermark, except per-user totals,
which are one row per user.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "20 days"  # the device buffers about twenty days


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def gated(stream: DataFrame, now_s: int) -> DataFrame:
    """Only timestamps after the epoch and before tomorrow; bad clocks must not move the watermark."""
    return stream.where((F.col("timestamp") > 0) & (F.col("timestamp") < now_s + 86400))


def deduplicated(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """First row per user and second within the watermark (idempotent insert)."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["user_id", "timestamp"])


def live_counts(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows per user and day with the latest row."""
    return stream.withWatermark("event_time", delay).groupBy(
        "user_id", F.window("event_time", "1 day").alias("w")
    ).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("timestamp").alias("last_ts"),
        F.max_by("hr", F.struct("timestamp", "event_id")).alias("last_hr"),
    ).select("user_id", F.col("w.start").alias("day"), "n_rows", "last_ts", "last_hr")


def sync_progress(stream: DataFrame) -> DataFrame:
    """First and last timestamp and rows per user; late rows may lower the minimum."""
    return stream.groupBy("user_id").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count(F.lit(1)).alias("n_rows")
    )


def window_features(stream: DataFrame, width: str = "2 minutes", stride: str = "1 minute",
                    delay: str = DELAY) -> DataFrame:
    """Heart-rate features of sliding event-time windows."""
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    return stream.withWatermark("event_time", delay).groupBy(
        "user_id", F.window("event_time", width, stride).alias("w")
    ).agg(
        F.count(hr).alias("n_hr"), F.avg(hr).alias("hr_mean"), F.stddev_pop(hr).alias("hr_std"),
        F.min(hr).alias("hr_min"), F.max(hr).alias("hr_max"),
    ).select("user_id", F.unix_seconds("w.start").alias("start_ts"), "n_hr", "hr_mean", "hr_std", "hr_min", "hr_max")


def activity_sessions(stream: DataFrame, above: float, gap: str = "30 seconds", min_s: int = 0,
                      delay: str = DELAY) -> DataFrame:
    """Sessions of rows at or above a heart rate, closed by a gap.

    For the append mode: a session is emitted once, when the watermark has passed it, and leaves
    the state. At the end of the data ``closing_row`` moves the watermark past the last ones; rows whose column ``closing``
    is true make no session.
    """
    closing = F.coalesce(F.col("closing"), F.lit(False)) if "closing" in stream.columns else F.lit(False)
    return stream.where(F.col("hr") >= above).withWatermark("event_time", delay).groupBy(
        "user_id", F.session_window("event_time", gap).alias("s")
    ).agg(
        F.max(closing).alias("_closing"),  # as a key the filter would be pushed below the watermark
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
        F.avg("hr").alias("avg_hr"), F.max("hr").alias("max_hr"),
    ).where((F.col("end_ts") - F.col("start_ts") >= min_s) & ~F.col("_closing")).select(
        "user_id", "start_ts", "end_ts", "n_rows", "avg_hr", "max_hr"
    )


def closing_row(rows: DataFrame, above: float, after: str) -> DataFrame:
    """One row with the columns of ``rows`` (``closing``, ``hr``, ``event_time``, ``timestamp`` and others) that lies ``after``,
    an interval longer than delay and gap together, behind the last of them."""
    last = rows.agg(F.max("event_time").alias("event_time")).where("event_time IS NOT NULL")
    row = last.select(
        F.lit(True).alias("closing"), F.lit(above).alias("hr"), (F.col("event_time") + F.expr(f"INTERVAL {after}")).alias("event_time"),
    ).withColumn("timestamp", F.unix_seconds("event_time"))
    return row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def daily_counter(stream: DataFrame, value: str, delay: str = DELAY) -> DataFrame:
    """A sum that starts again every day."""
    return stream.withWatermark("event_time", delay).groupBy(
        "user_id", F.window("event_time", "1 day").alias("w")
    ).agg(F.sum(value).alias("total")).select("user_id", F.col("w.start").alias("day"), "total")


def running_baseline(stream: DataFrame, value: str, alpha: float = 0.1) -> DataFrame:
    """Exponential baseline per user over daily rows (``date``, ``value``).

    State is the days of a user in order with their values and the baseline up to each: a late day is put in its place
    and only what follows is folded again, so any order of batches gives the batch result. The first row of a day
    counts, days without a value are left out. Bounded by the calendar.
    """
    out = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("date", T.DateType()),
        T.StructField("baseline", T.DoubleType()), T.StructField("days", T.LongType()),
    ])
    kept = T.StructType([
        T.StructField("days", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("baselines", T.ArrayType(T.DoubleType())),
    ])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, values, baselines = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).dropna(subset=["value"])
        changed = len(days)
        for day, v in zip(rows["date"].astype(str), rows["value"]):
            at = bisect_left(days, day)
            if at < len(days) and days[at] == day:
                continue
            days.insert(at, day)
            values.insert(at, float(v))
            changed = min(changed, at)
        if not days:
            return
        baselines = baselines[:changed]
        for v in values[changed:]:
            baselines.append(v if not baselines else alpha * v + (1 - alpha) * baselines[-1])
        state.update((days, values, baselines))
        yield pd.DataFrame({
            "user_id": [key[0]], "date": [pd.Timestamp(days[-1]).date()], "baseline": [baselines[-1]], "days": [len(days)],
        })

    daily = stream.select("user_id", "date", F.col(value).cast("double").alias("value"))
    return daily.groupBy("user_id").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Drain the source into ``folder/table`` and stop; progress is kept in ``folder``.

    A batch overwrites its own part, so a batch that runs twice after a failure
    leaves one copy.
    """
    target = f"{folder}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return target


def written_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(target)


def incremental_export(stream: DataFrame, folder: str, after_s: int = 0) -> str:
    """Rows after the server's high watermark, each exported once across restarts."""
    return run_available(stream.where(F.col("timestamp") > after_s), folder)
