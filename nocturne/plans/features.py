"""Feature tables for the stage models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators import joins, positions, series, spectral
from nocturne.operators.nights import NIGHT, bounded_nights
from nocturne.operators.window_stats import NIGHT_WIN, with_beats, with_bins, window_stats

# Names of the two feature sets, in model order.
FEATURES_A = [
    "hr_mean", "hr_median", "hr_std", "hr_iqr", "hr_min", "hr_max", "hr_p10", "hr_p90", "hr_above_rhr", "hr_trend",
    "hr_range", "hr_masd", "hr_skewness", "hr_kurtosis", "hr_entropy", "hr_accel", "hr_cv", "hr_range_norm", "rmssd",
    "sdnn", "pnn50", "pnn20", "rr_mean", "rr_std", "rr_trend", "lf_hf", "hrv_available", "rr_cv", "rr_entropy",
    "mv_mean", "mv_std", "mv_max", "mv_p90", "mv_p95", "mv_energy", "mv_zcr", "mv_active_frac", "mv_burst_count",
    "acc_x_std", "acc_y_std", "acc_mag_std", "gyro_mean", "gyro_std", "spo2_mean", "spo2_min", "hours_since_onset",
    "fraction_of_night", "circadian_sin", "circadian_cos", "ultradian_sin", "ultradian_cos", "hr_mv_interaction",
    "hrv_hr_ratio", "autonomic_balance", "delta_hr", "delta_mv", "delta_hrv", "delta_lf_hf", "roll_hr_mean",
    "roll_hr_std", "roll_mv_mean", "roll_mv_std", "roll_hrv_mean", "roll10_hr_mean", "roll10_hr_std",
    "roll10_lf_hf_mean", "roll10_mv_mean", "hr_dev_from_roll", "hr_dev_from_roll10", "prev1_hr", "prev1_mv",
    "prev1_hrv", "prev2_hr", "prev2_mv", "prev3_hr", "prev1_hr_delta", "hr_trend_5win", "mv_trend_5win",
    "expected_cycle_phase", "sleep_cycle_number", "cumulative_sleep_hrs", "cumulative_deep_proxy",
    "cumulative_rem_proxy", "cumulative_awake_proxy",
]
FEATURES_B = [
    "hr_mean", "hr_median", "hr_std", "hr_min", "hr_max", "hr_p10", "hr_p90", "hr_iqr", "hr_above_rhr", "rr_mean",
    "rr_std", "rmssd", "sdnn", "pnn50", "pnn20", "lf_power", "hf_power", "lf_hf_ratio", "sd1", "sd2", "sd1_sd2_ratio",
    "cv", "hours_since_onset", "fraction_of_night", "ultradian_sin", "ultradian_cos", "circadian_sin", "circadian_cos",
    "roll5_hr_mean", "roll5_rmssd_mean", "roll10_hr_mean", "roll10_rmssd_mean", "delta_hr", "delta_rmssd",
    "delta_lf_hf", "delta_rr_mean", "accel_mag_mean", "accel_mag_std", "gyro_mean", "gyro_std", "spo2_mean",
    "gyro_max", "gyro_spikes", "acc_jerk_max", "acc_jerk_p95", "hr_range", "hr_spikes", "spo2_std", "roll3_hr_mean",
    "roll3_rmssd_mean", "roll15_hr_mean", "roll15_rmssd_mean", "acc_energy", "acc_zcr", "hr_accel", "hr_skewness",
    "hr_std_x_gyro_std", "rmssd_over_hr", "hr_std_zone", "rmssd_zone", "light_score", "deep_vs_light", "rem_vs_light",
    "hr_std_centrality", "rmssd_centrality", "not_deep_score", "not_rem_score", "probably_light",
]
FEATURES_EXTRA = [
    "acc_z_var", "gyro_max", "hr_rise_after_burst", "atonia_score", "breath_irreg", "hr_accel_var", "hr_masd_std",
    "hr_var_x_level",
]
# Features that also come as z-scores of their night.
ZSCORED = ["hr_std", "rr_std", "sdnn", "rmssd", "hr_range", "gyro_std", "gyro_mean", "hr_max", "hr_mean", "rr_cv",
           "hr_masd_std", "breath_irreg", "hr_accel_var", "atonia_score"]
NIGHT_Z = [f"{f}_zn" for f in ZSCORED]

c = F.col


def _or(value: Column, condition: Column, default: float | Column = 0.0) -> Column:
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.when(condition, value), default)


def windows_of(df: DataFrame, rows: int, stride: int | None = None, rest_rows: int = 300,
               rest_step: int = 30, tasks: int | None = None) -> DataFrame:
    """Night rows cut to windows, with the bounds and the resting heart rate of the night.

    Positions, bounds and resting heart rate are window columns of one shuffle. ``tasks`` sets how many
    tasks hold the nights, so that their memory does not grow with the number of nights; else the session does.
    """
    group = W.partitionBy(*NIGHT)
    df = df.repartition(tasks, *NIGHT) if tasks else df
    placed = series.with_resting_hr(df, NIGHT, rest_rows, rest_step).withColumns(
        {"night_start": F.min("timestamp").over(group), "night_end": F.max("timestamp").over(group)}
    )
    return positions.sliding(placed, rows, stride) if stride else positions.tumbling(placed, rows)


NIGHT_COLUMNS = ["night_start", "night_end", "rhr"]


def _base(windows: DataFrame, bins: bool) -> DataFrame:
    keys = [*NIGHT_WIN, *NIGHT_COLUMNS]
    beats = with_beats(windows, keys)
    return series.with_night_position(window_stats(with_bins(beats, keys) if bins else beats, keys))


def features_a(windows: DataFrame, min_hr: int = 3, stride_h: float = 60 / 3600, tasks: int | None = None) -> DataFrame:
    """84 features per window; windows with too few heart rates are left out first, so
    the context columns see only windows with features. ``tasks`` sets how many tasks hold the windows of the nights."""
    s = _base(windows, True).where(c("n_hr") >= min_hr)
    n_hr, n_rr, many = c("n_hr"), c("n_rr"), c("n_rr") > 3
    clean = many & (c("n_d300") > 2)
    power = spectral.band_powers(c("rr_list"), 30)
    f = s.withColumn("power", power).select(
        *NIGHT_WIN, "start_ts", "last_ts", "mid_ts", "rhr", *(["label"] if "label" in s.columns else []),
        "hr_mean", c("hr_med").alias("hr_median"), "hr_std",
        F.when(n_hr > 4, c("hr_p75") - c("hr_p25")).otherwise(c("hr_std")).alias("hr_iqr"),
        c("hr_min").cast("double").alias("hr_min"), c("hr_max").cast("double").alias("hr_max"),
        F.when(n_hr > 4, c("hr_p10")).otherwise(c("hr_min")).alias("hr_p10"),
        F.when(n_hr > 4, c("hr_p90")).otherwise(c("hr_max")).alias("hr_p90"),
        (c("hr_mean") - c("rhr")).alias("hr_above_rhr"),
        _or(c("hr_slope") * n_hr, n_hr > 10).alias("hr_trend"),
        (c("hr_max") - c("hr_min")).cast("double").alias("hr_range"),
        _or(c("hr_masd"), n_hr > 5).alias("hr_masd"), _or(c("hr_skew"), n_hr > 5).alias("hr_skewness"),
        _or(c("hr_kurt"), n_hr > 5).alias("hr_kurtosis"), _or(c("hr_entropy"), n_hr >= 20).alias("hr_entropy"),
        _or(c("hr_accel"), n_hr > 10).alias("hr_accel"), _or(c("hr_std") / c("hr_mean"), n_hr > 5).alias("hr_cv"),
        _or((c("hr_max") - c("hr_min")) / c("rhr"), c("rhr") > 30).alias("hr_range_norm"),
        _or(c("rmssd300"), clean).alias("rmssd"), _or(c("rr_std"), many).alias("sdnn"),
        _or(100.0 * c("n50") / c("n_d300"), clean).alias("pnn50"), _or(100.0 * c("n20") / c("n_d300"), clean).alias("pnn20"),
        _or(c("rr_mean"), many).alias("rr_mean"), _or(c("rr_std"), many).alias("rr_std"),
        _or(c("rr_slope") * n_rr, n_rr > 10).alias("rr_trend"), spectral.lf_hf(c("power"), 1.0).alias("lf_hf"),
        many.cast("double").alias("hrv_available"), _or(c("rr_std") / c("rr_mean"), many).alias("rr_cv"),
        _or(c("rr_entropy"), n_rr >= 10).alias("rr_entropy"),
        "mv_mean", "mv_std", "mv_max", "mv_p90", "mv_p95", "mv_energy",
        (F.coalesce("mv_changes", F.lit(0)) / c("n_rows")).alias("mv_zcr"), c("mv_active").alias("mv_active_frac"),
        F.coalesce("mv_bursts", F.lit(0)).cast("double").alias("mv_burst_count"),
        "acc_x_std", "acc_y_std", "acc_mag_std", c("gyro_abs").alias("gyro_mean"), "gyro_std",
        F.coalesce("spo2_mean", F.lit(97.0)).alias("spo2_mean"),
        F.coalesce(c("spo2_min").cast("double"), F.lit(95.0)).alias("spo2_min"),
        "hours_since_onset", "fraction_of_night", "circadian_sin", "circadian_cos", "ultradian_sin", "ultradian_cos",
        "expected_cycle_phase", "sleep_cycle_number",
        # for the augmented set
        "acc_z_var", c("gyro_max").alias("gyro_peak"), "hr_accel_var", "hr_masd_std",
    )
    return _context_a(f.repartition(tasks, *NIGHT) if tasks else f, stride_h)


def _context_a(f: DataFrame, stride_h: float) -> DataFrame:
    prev = series.previous
    full = series.trailing_full
    hr, mv, hrv, lf = c("hr_mean"), c("mv_mean"), c("rmssd"), c("lf_hf")
    zero = F.lit(0.0)
    earlier = W.partitionBy(*NIGHT).orderBy("win").rowsBetween(W.unboundedPreceding, -1)
    at = F.count(F.lit(1)).over(earlier)
    f = f.withColumns(
        {
            "hr_mv_interaction": c("hr_above_rhr") * mv, "hrv_hr_ratio": hrv / hr, "autonomic_balance": lf * mv,
            "delta_hr": hr - prev("hr_mean"), "delta_mv": mv - prev("mv_mean"), "delta_hrv": hrv - prev("rmssd"),
            "delta_lf_hf": lf - prev("lf_hf"),
            "roll_hr_mean": full(F.avg(hr), hr, 3, hr), "roll_hr_std": full(F.stddev_pop(hr), hr, 3, zero),
            "roll_mv_mean": full(F.avg(mv), mv, 3, mv), "roll_mv_std": full(F.stddev_pop(mv), mv, 3, zero),
            "roll_hrv_mean": full(F.avg(hrv), hrv, 3, hrv),
            "roll10_hr_mean": full(F.avg(hr), hr, 10, hr), "roll10_hr_std": full(F.stddev_pop(hr), hr, 10, zero),
            "roll10_lf_hf_mean": full(F.avg(lf), lf, 10, lf), "roll10_mv_mean": full(F.avg(mv), mv, 10, mv),
            "prev1_hr": prev("hr_mean"), "prev1_mv": prev("mv_mean"), "prev1_hrv": prev("rmssd"),
            "prev2_hr": prev("hr_mean", 2), "prev2_mv": prev("mv_mean", 2), "prev3_hr": prev("hr_mean", 3),
            "hr_trend_5win": series.trailing_slope5("hr_mean"), "mv_trend_5win": series.trailing_slope5("mv_mean"),
            "cumulative_sleep_hrs": at * stride_h,
            "cumulative_deep_proxy": series.share_before((c("hr_above_rhr") < 5) & (mv < 0.3)),
            "cumulative_rem_proxy": series.share_before((c("hr_iqr") > 8) & (mv < 0.5)),
            "cumulative_awake_proxy": series.share_before((mv > 0.3) | (c("hr_above_rhr") > 15)),
        }
    )
    return f.withColumns(
        {
            "hr_dev_from_roll": hr - c("roll_hr_mean"), "hr_dev_from_roll10": hr - c("roll10_hr_mean"),
            "prev1_hr_delta": c("prev1_hr") - c("prev2_hr"),
        }
    )


def features_b(windows: DataFrame, min_hr: int = 5, tasks: int | None = None) -> DataFrame:
    """68 features per minute window with trailing means and deltas; ``tasks`` as in ``features_a``."""
    s = _base(windows, False).where(c("n_hr") >= min_hr)
    rr, enough = c("n_rr") >= 5, (c("n_rr") >= 5) & (c("n_d300") >= 3)
    power = spectral.band_powers(c("rr_list"), 20)
    s = s.withColumn("power", power)
    sd1 = c("sd_d300") / F.sqrt(F.lit(2.0))
    sd2 = F.sqrt(F.greatest(2 * c("rr_std") * c("rr_std") - sd1 * sd1, F.lit(0.01)))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    f = s.select(
        *NIGHT_WIN, "start_ts", "last_ts", "mid_ts", *(["label"] if "label" in s.columns else []),
        "hr_mean", c("hr_med").alias("hr_median"), "hr_std", c("hr_min").cast("double").alias("hr_min"),
        c("hr_max").cast("double").alias("hr_max"), "hr_p10", "hr_p90", (c("hr_p75") - c("hr_p25")).alias("hr_iqr"),
        (c("hr_mean") - c("rhr")).alias("hr_above_rhr"), _or(c("rr_mean"), rr, 1000.0).alias("rr_mean"),
        _or(c("rr_std"), rr).alias("rr_std"), _or(c("rmssd300"), enough).alias("rmssd"), _or(c("rr_std"), enough).alias("sdnn"),
        _or(100.0 * c("n50") / c("n_d300"), enough).alias("pnn50"), _or(100.0 * c("n20") / c("n_d300"), enough).alias("pnn20"),
        F.coalesce(c("power.lf"), F.lit(0.0)).alias("lf_power"), F.coalesce(c("power.hf"), F.lit(0.0)).alias("hf_power"),
        spectral.lf_hf(c("power"), 1.5).alias("lf_hf_ratio"), _or(sd1, enough).alias("sd1"), _or(sd2, enough).alias("sd2"),
        _or(sd1 / sd2, enough & (sd2 > 0.01), 1.0).alias("sd1_sd2_ratio"), _or(c("rr_std") / c("rr_mean"), rr).alias("cv"),
        "hours_since_onset", "fraction_of_night", "ultradian_sin", "ultradian_cos",
        F.sin(2 * F.pi() * c("hours_since_onset") / 24).alias("circadian_sin"),
        F.cos(2 * F.pi() * c("hours_since_onset") / 24).alias("circadian_cos"),
        F.coalesce("mag_mean", F.lit(0.0)).alias("accel_mag_mean"), F.coalesce("mag_std", F.lit(0.0)).alias("accel_mag_std"),
        F.coalesce("gyro_nz_abs", F.lit(0.0)).alias("gyro_mean"), F.coalesce("gyro_nz_std", F.lit(0.0)).alias("gyro_std"),
        F.coalesce("spo2_mean", F.lit(0.0)).alias("spo2_mean"), "gyro_max", c("gyro_spikes").cast("double").alias("gyro_spikes"),
        F.coalesce("jerk_max", F.lit(0.0)).alias("acc_jerk_max"), F.coalesce("jerk_p95", F.lit(0.0)).alias("acc_jerk_p95"),
        (c("hr_max") - c("hr_min")).cast("double").alias("hr_range"),
        F.coalesce(c("hr_jumps").cast("double"), F.lit(0.0)).alias("hr_spikes"),
        _or(c("spo2_std"), c("n_spo2") > 1).alias("spo2_std"), F.coalesce("mag_energy", F.lit(0.0)).alias("acc_energy"),
        (F.coalesce("mag_crossings", F.lit(0)) / c("n_rows")).alias("acc_zcr"),
        F.coalesce("hr_accel", F.lit(0.0)).alias("hr_accel"), F.coalesce("hr_skew", F.lit(0.0)).alias("hr_skewness"),
    )
    f = f.repartition(tasks, *NIGHT) if tasks else f
    std, spikes, hrv = c("hr_std"), c("gyro_spikes"), c("rmssd")
    prev, mean = series.previous, series.trailing_mean
    return f.withColumns(
        {
            **{f"roll{k}_hr_mean": mean("hr_mean", k) for k in (3, 5, 10, 15)},
            **{f"roll{k}_rmssd_mean": mean("rmssd", k) for k in (3, 5, 10, 15)},
            "delta_hr": c("hr_mean") - prev("hr_mean"), "delta_rmssd": hrv - prev("rmssd"),
            "delta_lf_hf": c("lf_hf_ratio") - prev("lf_hf_ratio"), "delta_rr_mean": c("rr_mean") - prev("rr_mean"),
            "hr_std_x_gyro_std": std * c("gyro_std"), "rmssd_over_hr": hrv / c("hr_mean"),
            "hr_std_zone": F.when(std < 4, 0.0).when(std <= 7, 1.0).otherwise(2.0),
            "rmssd_zone": F.when(hrv < 90, 0.0).when(hrv <= 140, 1.0).otherwise(2.0),
            "light_score": (
                flag(c("pnn50") > 55) + flag((c("hr_above_rhr") > 3) & (c("hr_above_rhr") < 6))
                + flag((std > 4) & (std < 7)) + flag((spikes > 0.1) & (spikes < 1))
            ) / 4.0,
            "deep_vs_light": std / (hrv + 1.0), "rem_vs_light": spikes * c("spo2_std"),
            "hr_std_centrality": F.greatest(F.lit(0.0), 1.0 - F.abs(std - 5.5) / 5.5),
            "rmssd_centrality": F.greatest(F.lit(0.0), 1.0 - F.abs(hrv - 110.0) / 110.0),
            "not_deep_score": (flag(std > 4) + flag(hrv > 80) + flag(spikes > 0.1)) / 3.0,
            "not_rem_score": (flag(std < 7) + flag(c("spo2_std") < 2.5) + flag(spikes < 1)) / 3.0,
            "probably_light": flag(
                (c("hr_above_rhr") < 5) & (std > 3.5) & (std < 8) & (hrv > 80) & (hrv < 145)
            ),
        }
    )


def features_extra(windows: DataFrame, features: DataFrame, ahead: int = 15) -> DataFrame:
    """The augmented set and the night z-scores next to the first set."""
    rise = joins.burst_response(windows, NIGHT_WIN, ahead).select(*NIGHT_WIN, c("hr_rise").alias("hr_rise_after_burst"))
    breath = spectral.breathing_irregularity(windows, NIGHT_WIN)
    joined = features.join(rise, NIGHT_WIN, "left").join(breath, NIGHT_WIN, "left").withColumns(
        {
            "gyro_max": c("gyro_peak"), "atonia_score": c("hr_std") / (c("mv_mean") + 0.05),
            "hr_var_x_level": c("hr_std") * c("hr_mean"),
        }
    )
    filled = joined.fillna(0.0, FEATURES_EXTRA)
    return series.night_zscore(filled, ZSCORED)


def awake_before_sleep(df: DataFrame, bounds: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows of the hour before the night, labelled awake, as extra training rows."""
    before = bounds.select(
        *NIGHT, (c("start_ts") - seconds).alias("start_ts"), (c("start_ts") - 1).alias("end_ts")
    )
    return bounded_nights(df, before).drop("start_ts", "end_ts").withColumn("label", F.lit(0))

