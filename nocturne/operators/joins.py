"""Joins of sensor windows, labels, days and activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import to_number
from nocturne.operators.nights import NIGHT


def with_official(own: DataFrame, official: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Own rows with the official columns prefixed ``official_``."""
    other = official.select(
        *keys, *[F.col(c).alias(f"official_{c}") for c in official.columns if c not in keys]
    )
    return own.join(other, keys, how)


def first_best(df: DataFrame, keys: list[str], label: str, weight: Column, first: Column) -> DataFrame:
    """Label with the largest weight per key; the one seen first wins a tie."""
    per = df.groupBy(*keys, label).agg(weight.alias("_w"), first.alias("_f"))
    return per.groupBy(*keys).agg(F.max_by(label, F.struct("_w", -F.col("_f"))).alias(label))


def label_windows(windows: DataFrame, intervals: DataFrame, bucket_s: int = 3600,
                  keys: list[str] = NIGHT) -> DataFrame:
    """Dominant official label of each window by overlapping whole seconds.

    Windows and labels are inclusive ``[start_ts, end_ts]``. An hour bucket makes the
    range join an equi join; an overlap is counted only in the bucket of its first
    second. Seconds are computed, never expanded.
    """

    def bucketed(df: DataFrame) -> DataFrame:
        lo, hi = F.floor(F.col("start_ts") / bucket_s), F.floor(F.col("end_ts") / bucket_s)
        return df.withColumn("_bucket", F.explode(F.sequence(lo, hi)))

    w = bucketed(windows.select(*keys, "win", "start_ts", "end_ts"))
    lab = bucketed(intervals.select(*keys, "stage", "start_ts", "end_ts")).select(
        *keys, "_bucket", "stage", F.col("start_ts").alias("_ls"), F.col("end_ts").alias("_le")
    )
    first = F.greatest("start_ts", "_ls")
    last = F.least("end_ts", "_le")
    hits = w.join(lab, [*keys, "_bucket"]).where(
        (first <= last) & (F.floor(first / bucket_s) == F.col("_bucket"))
    )
    return first_best(hits, [*keys, "win"], "stage", F.sum(last - first + 1), F.min(first))


def label_minutes(sensor: DataFrame, labels: DataFrame, minute_of: Column, keys: list[str] = NIGHT) -> DataFrame:
    """Sensor minutes matched to clock-minute labels of the night, one row per minute."""
    minutes = sensor.withColumn("clock", minute_of).groupBy(*keys, "clock").agg(
        F.min(F.col("timestamp") - F.col("timestamp") % 60).alias("minute_ts"), F.count(F.lit(1)).alias("n_rows")
    )
    return minutes.join(labels.select(*keys, "clock", "stage"), [*keys, "clock"])


def label_neighbourhood(centres: DataFrame, minutes: DataFrame, before: int = 5, after: int = 4,
                        keys: list[str] = NIGHT) -> DataFrame:
    """Dominant minute label from ``before`` minutes before to ``after`` after a centre."""
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    around = centres.select(*keys, "win", "minute", offsets.alias("_off")).withColumn(
        "minute", F.col("minute") + F.col("_off")
    )
    hits = around.join(minutes.select(*keys, "minute", "stage"), [*keys, "minute"])
    return first_best(hits, [*keys, "win"], "stage", F.count(F.lit(1)), F.min("_off"))


def compare_daily_hr(own: DataFrame, official: DataFrame) -> DataFrame:
    """Own and official daily heart rate on shared days; close below 5 bpm."""
    joined = own.select("user_id", "date", F.col("avg_hr").alias("own_hr")).join(
        official.select("user_id", "date", F.col("avg_hr").alias("official_hr")), ["user_id", "date"]
    )
    diff = F.bround(F.col("own_hr") - F.col("official_hr"), 1)
    return joined.withColumns({"diff": diff, "close": (F.abs(diff) < 5).cast("int")})


def days_without_official(own: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    return own.join(official, keys, "left_anti")


def official_with_data(official: DataFrame, own: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Official rows of days with data, the last one per day."""
    rest = [c for c in official.columns if c not in keys]
    kept = official.join(own, keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*keys, "_r.*")


def hypnogram_agreement(a: DataFrame, b: DataFrame, keys: list[str] = NIGHT) -> DataFrame:
    """Share of equal stages over the night minutes both hypnograms have, in percent."""
    joined = a.select(*keys, "minute", F.col("stage").alias("_a")).join(
        b.select(*keys, "minute", F.col("stage").alias("_b")), [*keys, "minute"]
    )
    equal = F.sum((F.col("_a") == F.col("_b")).cast("int"))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("minutes"), F.bround(100.0 * equal / F.count(F.lit(1)), 1).alias("agreement")
    )


def next_day(df: DataFrame, columns: list[str]) -> DataFrame:
    """The following row of the user by date (adjacent rows, not calendar days)."""
    order = W.partitionBy("user_id").orderBy("date")
    return df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})


def epochs_to_windows(windows: DataFrame, epochs: DataFrame, epoch_s: int = 30,
                      keys: list[str] = NIGHT) -> DataFrame:
    """Majority of the short epochs inside each window ``[start_ts, end_ts)``."""
    lo, hi = F.floor(F.col("start_ts") / epoch_s), F.floor(F.col("end_ts") / epoch_s) - 1
    spread = windows.select(*keys, "win", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("epoch"))
    hits = spread.join(epochs.select(*keys, "epoch", "stage"), [*keys, "epoch"])
    return first_best(hits, [*keys, "win"], "stage", F.count(F.lit(1)), F.min("epoch"))


def burst_response(df: DataFrame, keys: list[str], ahead: int = 15) -> DataFrame:
    """Mean heart-rate range in the ``ahead`` rows from each gyro burst (mean + 2 sd)."""
    group = W.partitionBy(*keys)
    limit = F.avg("gyro").over(group) + 2 * F.stddev_pop("gyro").over(group)
    frame = group.orderBy("timestamp").rowsBetween(0, ahead - 1)
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    v = df.withColumns(
        {
            "_limit": limit,
            "_rise": F.when(F.count(hr).over(frame) > 2, F.max(hr).over(frame) - F.min(hr).over(frame)),
        }
    )
    return v.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("gyro") > F.col("_limit"), F.col("_rise"))), F.lit(0.0)).alias("hr_rise"),
        F.sum((F.col("gyro") > F.col("_limit")).cast("int")).alias("bursts"),
    )


def sweep(df: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Every row with every parameter set of a literal grid (thresholds, gains)."""
    if len(grid) > 1000:
        raise ValueError(f"{len(grid)} parameter sets, at most 1000 are swept at once")
    sets = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in p.items()]) for p in grid])
    return df.withColumn("_set", F.explode(sets)).select("*", "_set.*").drop("_set")


def override_with_official(own: DataFrame, official: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Official texts replace own numbers where present and not ``--``."""
    other = official.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return own.join(other, keys, "full").select(
        *keys, *[F.coalesce(to_number(F.col(f"_o_{c}")), F.col(c)).alias(c) for c in columns]
    )


def merge_calendar(documents: DataFrame, cycles: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Calendar row per user and day: cycles overwrite strain and sleep, recoveries
    overwrite recovery, documents fill the rest, 0 where nothing is known."""
    keys = ["user_id", "date"]
    c = cycles.select(
        *keys, F.coalesce("strain", F.lit(0.0)).alias("c_strain"), F.coalesce("sleep", F.lit(0.0)).alias("c_sleep")
    )
    r = recoveries.select(*keys, F.coalesce("recovery", F.lit(0.0)).alias("r_recovery"))
    zero = F.lit(0.0)
    return documents.join(c, keys, "full").join(r, keys, "full").select(
        *keys,
        F.coalesce("r_recovery", "recovery", zero).alias("recovery"),
        F.coalesce("c_strain", "strain", zero).alias("strain"),
        F.coalesce("c_sleep", "sleep", zero).alias("sleep"),
    )


def match_workouts(tracked: DataFrame, official: DataFrame, minutes: int = 15) -> DataFrame:
    """First official workout of the day whose start or end is less than ``minutes``
    whole minutes from the tracked one; ``position`` is the source order.

    Starts and ends are matched on (user, date, time bucket). Workouts that share a
    second are reduced to the first before the join.
    """
    width = minutes * 60
    keys = ["user_id", "date"]
    first = F.min(F.struct("position", "workout_id")).alias("_w")
    parts = []
    for end in ("start_ts", "end_ts"):
        o = official.where(F.col(end).isNotNull()).groupBy(*keys, F.col(end).alias("_at")).agg(first)
        o = o.withColumn("_bucket", F.floor(F.col("_at") / width))
        here = F.floor(F.col(end) / width)
        t = tracked.where(F.col(end).isNotNull()).select(
            *keys, "activity_id", F.col(end).alias("_own"), F.explode(F.array(here - 1, here, here + 1)).alias("_bucket")
        )
        parts.append(
            t.join(o, [*keys, "_bucket"]).where(F.abs(F.col("_own") - F.col("_at")) < width)
            .select(*keys, "activity_id", "_w")
        )
    best = parts[0].unionByName(parts[1]).groupBy(*keys, "activity_id").agg(F.min("_w").alias("_w"))
    return tracked.join(best, [*keys, "activity_id"], "left").withColumn("workout_id", F.col("_w.workout_id")).drop("_w")
