"""Local time, night assignment and row gates.

Timestamps are whole seconds and unique per user after ``sources.sensor``'s
de-duplication, so one (user, night) holds at most 57 600 rows and one
(user, date) at most 86 400. Every window in the library is keyed by one of
the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UTC_OFFSET_S = 3600
NIGHT = ["user_id", "night"]
DAY = ["user_id", "date"]


def _local(ts: Column, offset_s: int) -> Column:
    return ts + F.lit(offset_s)


def local_date(ts: Column, offset_s: int = UTC_OFFSET_S) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_local(ts, offset_s) / 86400).cast("int"))


def local_hour(ts: Column, offset_s: int = UTC_OFFSET_S) -> Column:
    return F.floor(F.pmod(_local(ts, offset_s), F.lit(86400)) / 3600).cast("int")


def local_minute(ts: Column, offset_s: int = UTC_OFFSET_S) -> Column:
    """Minute of the local day."""
    return F.floor(F.pmod(_local(ts, offset_s), F.lit(86400)) / 60).cast("int")


def with_local_time(df: DataFrame, offset_s: int = UTC_OFFSET_S) -> DataFrame:
    ts = F.col("timestamp")
    return df.select(
        "*",
        F.timestamp_seconds(ts).alias("datetime_utc"),
        F.timestamp_seconds(_local(ts, offset_s)).alias("datetime_local"),
        local_date(ts, offset_s).alias("date"),
    )


def with_date(df: DataFrame, offset_s: int = UTC_OFFSET_S) -> DataFrame:
    return df.withColumn("date", local_date(F.col("timestamp"), offset_s))


def with_night(df: DataFrame, rule: str = "evening", offset_s: int = UTC_OFFSET_S) -> DataFrame:
    """Keep the rows of nights and label them, in one pass over the data.

    ``evening``: 20:00 of the day before until noon. ``calendar``: before 10:00
    or from 22:00 of the same date. ``trimmed``: before 11:00 of the date.
    """
    ts = F.col("timestamp")
    hour, date = local_hour(ts, offset_s), local_date(ts, offset_s)
    night = {
        "evening": F.when(hour >= 20, F.date_add(date, 1)).when(hour < 12, date),
        "calendar": F.when((hour < 10) | (hour >= 22), date),
        "trimmed": F.when(hour < 11, date),
    }[rule]
    return df.withColumn("night", night).where("night is not null")


def active_day(df: DataFrame, from_hour: int = 6, offset_s: int = UTC_OFFSET_S) -> DataFrame:
    return with_date(df, offset_s).where(local_hour(F.col("timestamp"), offset_s) >= from_hour)


def bounded_nights(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows inside official nights ``(user_id, night, start_ts, end_ts)``.

    Bounds grow with users and nights, so nothing is broadcast by hand: the
    join key is (user, UTC day) and a night repeats only on the days it touches.
    """
    day = F.explode(
        F.sequence(F.floor(F.col("start_ts") / 86400), F.floor(F.col("end_ts") / 86400))
    )
    spread = bounds.select("user_id", "night", "start_ts", "end_ts", day.alias("utc_day"))
    rows = df.withColumn("utc_day", F.floor(F.col("timestamp") / 86400))
    return (
        rows.join(spread, ["user_id", "utc_day"])
        .where("timestamp >= start_ts and timestamp <= end_ts")
        .drop("utc_day")
    )


def year_gate(df: DataFrame, first: int = 2025, last: int = 2026) -> DataFrame:
    return df.where(F.year("date").between(first, last))


def coverage_gate(df: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Groups with enough rows, counted in the same shuffle that keeps them together."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.col("_n") >= at_least).drop("_n")


def thin_dense_nights(df: DataFrame, keys: list[str] = NIGHT, below_s: float = 1.5) -> DataFrame:
    """Every other row of nights sampled faster than ``below_s`` (median of the first 200 rows)."""
    order = W.partitionBy(*keys).orderBy("timestamp")
    gap = F.col("timestamp") - F.lag("timestamp").over(order)
    ranked = df.withColumns({"_pos": F.row_number().over(order) - 1, "_gap": gap})
    group = W.partitionBy(*keys)
    head_gap = F.percentile(F.when(F.col("_pos") < 200, F.col("_gap")), F.lit(0.5)).over(group)
    many = F.count(F.lit(1)).over(group) > 10
    return (
        ranked.withColumns({"_median_gap": head_gap, "_many": many})
        .where("not (_many and _median_gap < %f) or _pos %% 2 = 0" % below_s)
        .drop("_pos", "_gap", "_median_gap", "_many")
    )
