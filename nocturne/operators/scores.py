"""Daily scores and coaching rules as column expressions (SC1-SC19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import clamp, hhmm, recovery_zone, sigmoid100
from nocturne.operators.aggregates import bounded_score, coverage_scale


def _col(c) -> Column:
    return c if isinstance(c, Column) else (F.col(c) if isinstance(c, str) else F.lit(float(c)))


def _rhr_part(rhr: Column, base: Column, scale: float) -> Column:
    return clamp(50.0 + (base - rhr) * scale, 0.0, 100.0)


# The weights, bases, slopes and cut-offs in the expressions below.

# ------------------------------------------------------------------- recovery


def recovery_custom(hrv="hrv", rhr="rhr", sleep="sleep", resp="resp", hrv_base=90.0, rhr_base=55.0) -> Column:
    hrv, rhr, sleep, resp, hb, rb = map(_col, (hrv, rhr, sleep, resp, hrv_base, rhr_base))
    hrv_part = F.when(hb > 0, sigmoid100(hrv / hb, 4.0, 0.85)).otherwise(50.0)
    rhr_part = F.when(rb > 0, _rhr_part(rhr, rb, 8.0)).otherwise(clamp(100.0 - (rhr - 40) * 3, 0.0, 100.0))
    penalty = F.greatest(F.lit(0.0), (resp - 16) * 5)
    return bounded_score(0.60 * hrv_part + 0.25 * rhr_part + 0.15 * sleep - penalty)


def recovery_calibrated(hrv="hrv", rhr="rhr", sleep="sleep", resp="resp", hrv_base=90.0, rhr_base=55.0,
                        weights=(0.09, 0.43, 0.33, 0.14), slope=11.6, center=1.107, rhr_scale=8.1) -> Column:
    hrv, rhr, sleep, resp, hb, rb = map(_col, (hrv, rhr, sleep, resp, hrv_base, rhr_base))
    hb = F.when(hb <= 0, 90.0).otherwise(hb)
    rhr_part = F.when(rb > 0, _rhr_part(rhr, rb, rhr_scale)).otherwise(clamp(100.0 - (rhr - 45) * 2, 0.0, 100.0))
    penalty = F.greatest(F.lit(0.0), (resp - 16) * 3)
    w = weights
    return bounded_score(
        w[0] * sigmoid100(hrv / hb, slope, center) + w[1] * rhr_part
        + w[2] * F.least(F.lit(100.0), sleep) + w[3] * (100.0 - penalty)
    )


def recovery_engine(hrv="hrv", rhr="rhr", efficiency="efficiency", resp="resp", hrv_base="hrv_base",
                    rhr_base="rhr_base") -> dict[str, Column]:
    """Score with its parts and zone."""
    hrv, rhr, eff, resp, hb, rb = map(_col, (hrv, rhr, efficiency, resp, hrv_base, rhr_base))
    hrv_part = sigmoid100(F.when(hb > 0, hrv / hb).otherwise(1.0), 4.0, 1.0)
    rhr_part = _rhr_part(rhr, rb, 8.0)
    sleep_part = F.least(F.lit(100.0), eff)
    penalty = F.when(resp > 18, (resp - 18) * 5.0).when(resp < 10, (10 - resp) * 5.0).otherwise(0.0)
    raw = clamp(0.60 * hrv_part + 0.25 * rhr_part + 0.15 * sleep_part - penalty, 0.0, 100.0)
    return {
        "recovery": F.bround(raw, 0), "zone": recovery_zone(raw),
        "hrv_part": F.bround(hrv_part, 1), "rhr_part": F.bround(rhr_part, 1),
        "sleep_part": F.bround(sleep_part, 1), "resp_penalty": F.bround(penalty, 1),
    }


def recovery_simple(rmssd="rmssd", rhr="rhr") -> Column:
    rmssd, rhr = _col(rmssd), _col(rhr)
    raw = F.least(F.lit(100.0), rmssd / 1.5) * 0.6 + F.greatest(F.lit(0.0), 100.0 - (rhr - 40) * 3) * 0.4
    return clamp(F.floor(raw).cast("double"), 0.0, 100.0)


# ---------------------------------------------------------------------- sleep


def sleep_score_custom(sleep_min="sleep_min", efficiency="efficiency", deep="deep_pct", rem="rem_pct",
                       awake="awake_pct", need_min: float = 480.0) -> Column:
    m, eff, deep, rem, awake = map(_col, (sleep_min, efficiency, deep, rem, awake))
    hundred = F.lit(100.0)
    return bounded_score(
        0.40 * F.least(hundred, m / need_min * 100) + 0.30 * F.least(hundred, eff)
        + 0.20 * F.least(hundred, (deep + rem) * 2.5) + 0.10 * F.greatest(F.lit(0.0), 100.0 - awake * 5)
    )


def sleep_score_calibrated(sleep_min="sleep_min", efficiency="efficiency", awake="awake_pct",
                           need_min: float = 480.0, weights=(0.23, 0.34, 0.26, 0.18),
                           consistency: float = 41.5) -> Column:
    m, eff, awake = map(_col, (sleep_min, efficiency, awake))
    w, hundred = weights, F.lit(100.0)
    return bounded_score(
        w[0] * F.least(hundred, m / need_min * 100) + w[1] * consistency
        + w[2] * F.least(hundred, eff) + w[3] * F.greatest(F.lit(0.0), 100.0 - awake * 5)
    )


def sleep_score_engine(sleep_hours="sleep_hours", efficiency="efficiency", onset_minute="onset_minute",
                       need_h: float = 7.5) -> dict[str, Column]:
    """Score from hours, efficiency and the distance of the onset from 22:30 in the
    evening clock; 70 without an onset."""
    hours, eff, onset = map(_col, (sleep_hours, efficiency, onset_minute))
    hours_part = F.least(F.lit(100.0), hours / need_h * 100)
    eff_part = F.least(F.lit(100.0), eff)
    signed = onset - F.when(onset > 720, 1440).otherwise(0)
    # greatest() passes over nulls, so a missing onset is asked for
    consistency = F.when(onset.isNull(), 70.0).otherwise(F.greatest(F.lit(30.0), 100.0 - F.abs(signed + 90) * 0.5))
    raw = clamp(0.4 * hours_part + 0.3 * eff_part + 0.3 * consistency, 0.0, 100.0)
    return {
        "sleep_score": F.bround(raw, 0), "hours_part": F.bround(hours_part, 1),
        "efficiency_part": F.bround(eff_part, 1), "consistency_part": F.bround(consistency, 1),
    }


# --------------------------------------------------------------------- strain


def strain(load="zone_load", scale=1.0) -> Column:
    load = _col(load) * _col(scale)
    return F.when(load <= 0, 0.0).otherwise(
        F.least(F.lit(21.0), F.bround(5.5 * F.log1p(load / 15.0), 1))
    )


def strain_calibrated(load="zone_load", valid="n_valid", total="n_rows", k: float = 2.32, c: float = 6.3) -> Column:
    load = _col(load) * coverage_scale(_col(valid), _col(total))
    return F.when(load <= 0, 0.0).otherwise(F.least(F.lit(21.0), F.bround(k * F.log1p(load / c), 1)))


# --------------------------------------------------------------- need, energy


def sleep_need(strain="strain", debt=0.0, baseline: float = 7.5) -> Column:
    return F.bround(
        baseline + F.greatest(F.lit(0.0), (_col(strain) - 10) * 0.1) + _col(debt) * 0.2, 2
    )


def calories(valid="n_hr30", load="zone_load", high="n_high") -> Column:
    """75 kcal per valid hour, 0.15 per unit of load, 2 per minute above 80 % of maximum."""
    return 75.0 * _col(valid) / 3600.0 + 0.15 * _col(load) + _col(high) / 60.0 * 2.0


def vo2max(p99="hr_p99", rhr="rhr", valid="n_hr30") -> Column:
    p99, rhr = _col(p99), _col(rhr)
    raw = 15.3 * p99 / rhr * F.when(p99 - rhr < 40, 0.85).otherwise(1.0)
    return F.when((_col(valid) >= 100) & (rhr >= 30), F.bround(clamp(raw, 20.0, 70.0), 1))


# ------------------------------------------------------------------- coaching


def strain_target(recovery="recovery") -> dict[str, Column]:
    """Zone, range of strain for the day, and advice as a code."""
    r = _col(recovery)
    by_zone = lambda green, yellow, red: F.when(r >= 67, green).when(r >= 34, yellow).otherwise(red)
    return {
        "zone": recovery_zone(r), "target_min": by_zone(14, 8, 0), "target_max": by_zone(18, 14, 8),
        "advice": by_zone("push", "moderate", "rest"),
    }


def bedtime(need_h="need_h", wake_minute="wake_minute") -> Column:
    """``HH:mm`` to go to bed: the need and 15 minutes before waking."""
    return hhmm(_col(wake_minute) - F.floor(_col(need_h) * 60 + 0.5) - 15)


def sleep_debt_minutes(debt_h="debt_h") -> Column:
    """Sleep debt in whole minutes, 0 if there is none."""
    return F.greatest(F.floor(_col(debt_h) * 60 + 0.5), F.lit(0)).cast("int")


def weather_advice(temperature="temperature", code="weather_code", wind="wind_kmh") -> Column:
    """The first hindrance to training outdoors as a code, ``none`` without one."""
    t, k, w = _col(temperature), _col(code), _col(wind)
    checks = [(t < 5, "cold"), (t > 30, "hot"), (k.between(61, 67), "rain"), (k.between(71, 77), "snow"), (w > 40, "wind")]
    return F.coalesce(*[F.when(met, name) for met, name in checks], F.lit("none"))


# ------------------------------------------------------------------- insights


def insights(df: DataFrame) -> DataFrame:
    """Insight codes with their figure from one summary row per user: ``rmssd``, ``streak``, ``red_days``,
    ``green_days``, ``days`` and ``avg_recovery``."""
    c = F.col
    known = c("days") > 0
    found = {
        "high_hrv": (c("rmssd") > 60, c("rmssd")),
        "low_hrv": ((c("rmssd") > 0) & (c("rmssd") < 30), c("rmssd")),
        "green_streak": (known & (c("streak") >= 3), c("streak")),
        "recovery_deficit": (known & (c("red_days") > c("green_days")) & (c("days") >= 5), c("red_days")),
        "weekly_average": (known & (c("avg_recovery") > 0), F.floor(c("avg_recovery") + 0.5)),
    }
    entry = lambda code, value: F.struct(F.lit(code).alias("insight"), value.cast("double").alias("value"))
    listed = F.array_compact(F.array(*[F.when(met, entry(code, value)) for code, (met, value) in found.items()]))
    rows = F.when(F.size(listed) > 0, listed).otherwise(F.array(entry("more_data", F.lit(None))))
    return df.select("user_id", F.explode(rows).alias("i")).select("user_id", "i.*")


def stress_recovery_insight(stress="avg_stress", recovery="recovery") -> Column:
    """Whether stress and recovery point the same way, as a code."""
    s, r = F.floor(_col(stress) + 0.5), F.floor(_col(recovery) + 0.5)
    return (
        F.when((s > 66) & (r < 50), "high_stress_low_recovery").when((s < 34) & (r > 66), "low_stress_high_recovery").otherwise("watch")
    )


# ------------------------------------------------------ hydration, activities


def hydration(df: DataFrame, goal_ml: int = 2500, glass_ml: int = 250) -> DataFrame:
    """Running intake per user and date; each event adds or removes glasses, never below 0.

    A clamp at zero is the running sum minus its running minimum below zero, so no
    fold is needed. One (user, date) is bounded by the seconds of a day.
    """
    order = W.partitionBy("user_id", "date").orderBy("timestamp")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = df.withColumn("_run", F.sum(F.col("glasses") * glass_ml).over(upto))
    intake = F.col("_run") - F.least(F.lit(0), F.min("_run").over(upto))
    return run.withColumn("intake_ml", intake).select(
        "user_id", "date", "timestamp", "intake_ml",
        F.least(F.lit(1.5), F.col("intake_ml") / goal_ml).alias("progress"),
        F.floor(F.col("intake_ml") / glass_ml).alias("glasses_total"),
        (F.col("intake_ml") >= goal_ml).cast("int").alias("goal_reached"),
    )


def tracked_activities(df: DataFrame, keep: int = 50) -> DataFrame:
    """Activities from ``start`` and ``end`` events of a user (columns ``timestamp``,
    ``action``, ``sport_id``): one at a time, newest ``keep`` per user.

    Starts during an activity and ends without one are ignored. A start counts when
    the event before it is an end or there is none; it ends at the next end event.
    """
    order = W.partitionBy("user_id").orderBy("timestamp")
    before = F.lag("action").over(order)
    runs = df.withColumn("_opens", (F.col("action") == "start") & F.coalesce(before != "start", F.lit(True)))
    # read backwards, so the next end is a running value
    back = W.partitionBy("user_id").orderBy(F.desc("timestamp")).rowsBetween(W.unboundedPreceding, -1)
    next_end = F.last(F.when(F.col("action") == "end", F.col("timestamp")), True).over(back)
    opened = runs.withColumn("end_ts", next_end).where("_opens")
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("timestamp")))
    return opened.withColumn("_rank", newest).where(F.col("_rank") <= keep).select(
        "user_id", F.col("timestamp").alias("start_ts"), "end_ts", "sport_id",
        F.when(F.col("end_ts").isNull(), "active").otherwise("ended").alias("state"),
        (F.col("end_ts") - F.col("timestamp")).alias("elapsed_s"),
    )
