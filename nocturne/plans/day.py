"""Whole-day results composed from the operators (SC16, SC17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators import aggregates, nights, scores, series, spectral, stagers
from nocturne.operators.detection import activity_bouts
from nocturne.operators.nights import DAY, NIGHT
from nocturne.operators.stagers import RULE_SETS, RuleSet
from nocturne.schema import STAGES


def night_results(df: DataFrame, rules: RuleSet = RULE_SETS["fallback"], rows: int | None = None,
                  rest_rows: int = 300, rest_step: int = 30, sws_beats: int = 300,
                  min_rows: int = 300) -> DataFrame:
    """Physiology, stage summary, cycles and disturbances of every night with enough rows."""
    night = nights.coverage_gate(nights.with_night(df), NIGHT, min_rows)
    staged = stagers.stage_windows(
        night, rules, None, rows, rest_rows=rest_rows, rest_step=rest_step, carry=("start_ts", "last_ts", "rhr")
    )
    before = F.lag("phase").over(W.partitionBy(*NIGHT).orderBy("win"))
    awake = F.col("phase") == "awake"
    marked = staged.select(*NIGHT, "win", "phase", "start_ts", "rhr", before.alias("before"))
    n = {s: F.sum((F.col("phase") == s).cast("int")) for s in [*STAGES, "unknown"]}
    # one aggregation for the shares, cycles, bouts and bounds of a night
    night_row = marked.groupBy(*NIGHT).agg(
        F.count(F.lit(1)).alias("total"), *[v.alias(s) for s, v in n.items()],
        F.bround(F.first("rhr"), 1).alias("rhr"),
        F.greatest(F.sum(((F.col("phase") == "rem") & (F.col("before") == "deep")).cast("int")), F.lit(1)).alias("cycles"),
        F.sum((awake & F.coalesce(F.col("before") != "awake", F.lit(True))).cast("int")).alias("disturbances"),
        F.sum(F.col("phase").isin("deep", "rem").cast("int")).alias("restorative_min"),
        F.min("start_ts").alias("onset_ts"), F.max("start_ts").alias("wake_ts"),
    )
    asleep = F.col("total") - F.col("awake") - F.col("unknown")
    physiology = series.sws_hrv(night, NIGHT, sws_beats).join(spectral.respiratory_rate(night), NIGHT)
    return night_row.join(physiology, NIGHT, "left").select(
        *NIGHT, "rhr", F.bround("hrv", 1).alias("hrv"), F.bround("resp", 1).alias("resp"), "cycles", "disturbances",
        "restorative_min", "onset_ts", "wake_ts", F.bround(100.0 * asleep / F.col("total"), 1).alias("efficiency"),
        *[F.bround(100.0 * F.col(s) / F.col("total"), 1).alias(f"{s}_pct") for s in STAGES],
        F.bround(F.col("total") / 60.0, 2).alias("in_bed_hours"),
        F.bround((F.col("total") - F.col("awake")) / 60.0, 2).alias("sleep_hours"),
        nights.local_minute(F.col("onset_ts")).alias("onset_minute"),
    )


def day_results(df: DataFrame, max_hr: int = 200) -> DataFrame:
    """Load, strain, energy and active minutes of the hours from 06:00."""
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    day = nights.active_day(df).groupBy(*DAY).agg(
        F.bround(F.avg(hr), 1).alias("hr_mean"), F.max(hr).alias("hr_max"),
        aggregates.zone_load_column(max_hr).alias("zone_load"),
        F.count(hr).alias("n_hr30"), F.count(F.when(hr > max_hr * 0.8, 1)).alias("n_high"),
        F.bround(F.count(F.when(hr >= max_hr * 0.5, 1)) / 60.0, 1).alias("active_min"),
    )
    return day.select(
        *DAY, "hr_mean", "hr_max", F.bround("zone_load", 1).alias("zone_load"), scores.strain().alias("strain"),
        F.bround(scores.calories(), 0).alias("calories"), "active_min",
    )


def full_day(df: DataFrame, max_hr: int = 200, bouts: bool = True, bout_gap_rows: int = 30,
             bout_min_s: int = 300, **night_options) -> DataFrame:
    """One row per user and date: the night before, the day, recovery, scores and need."""
    night = night_results(df, **night_options).withColumnRenamed("night", "date")
    night = night.withColumns(
        {"hrv_base": series.last_mean("hrv", 14, 60.0), "rhr_base": series.last_mean("rhr", 14, 55.0)}
    )
    joined = day_results(df, max_hr).join(night, DAY, "left")
    if bouts:
        found = activity_bouts(nights.active_day(df), max_hr, bout_gap_rows, bout_min_s).groupBy(*DAY).agg(
            F.count(F.lit(1)).alias("n_activities"), F.sum("duration_min").alias("activity_min")
        )
        joined = joined.join(found, DAY, "left").fillna(0, ["n_activities", "activity_min"])
    recovery = scores.recovery_engine()
    sleep = scores.sleep_score_engine()
    return joined.withColumns({**recovery, **sleep, "sleep_need": scores.sleep_need()}).drop(
        "hrv_base", "rhr_base"
    )


def app_day(df: DataFrame, min_beats: int = 300, rows: int = 600, sws_beats: int = 300) -> DataFrame:
    """Scores of one calendar day as the app computes them from that day alone."""
    night = nights.with_night(df, "calendar")
    rhr = series.resting_hr_variant(night, "floor_quartile", NIGHT, min_beats)
    days = aggregates.absolute_zone_load(nights.with_date(df))
    staged = stagers.stage_windows(night, RULE_SETS["app"], rhr, rows)
    summary = aggregates.stage_summary(staged, 10.0).withColumnRenamed("night", "date")
    hrv = series.sws_hrv(night, NIGHT, sws_beats, app=True, min_beats=30).withColumnRenamed("night", "date")
    resp = spectral.respiratory_rate_crossings(night).withColumnRenamed("night", "date")
    joined = (
        days.join(rhr.withColumnRenamed("night", "date"), DAY, "left")
        .join(hrv, DAY, "left").join(resp, DAY, "left").join(summary, DAY, "left")
        .fillna({"rhr": 55.0, "hrv": 0.0, "resp": 14.0, "sleep_min": 0.0, "efficiency": 0.0, "awake_pct": 0.0})
    )
    sleep = scores.sleep_score_calibrated()
    return joined.withColumn("sleep_score", sleep).select(
        *DAY, "rhr", "hrv", "resp", "sleep_score", scores.strain_calibrated().alias("strain"),
        scores.recovery_calibrated(sleep="sleep_score").alias("recovery"), "sleep_min", "efficiency",
        F.col("n_rows").alias("records"),
    )


def forward_scores(df: DataFrame) -> DataFrame:
    """Recovery from given daily inputs with exponential baselines per user."""
    hrv = series.ema_baseline(df, "hrv", "hrv_base").drop("hrv")
    rhr = series.ema_baseline(df, "rhr", "rhr_base").drop("rhr")
    joined = df.join(hrv, DAY).join(rhr, DAY)
    recovery = scores.recovery_custom(
        resp=F.coalesce(F.col("resp"), F.lit(14.0)), hrv_base=F.col("hrv_base"), rhr_base=F.col("rhr_base")
    )
    return joined.withColumn("recovery", recovery)
