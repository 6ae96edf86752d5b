"""Physiological aggregates (A1-A22, A25, A26) and detection."""

from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from catalog.window_queries import night_rows, window_frame
from nocturne.operators import aggregates, detection, positions
from nocturne.operators.nights import DAY, NIGHT, with_date
from nocturne.operators.window_stats import NIGHT_WIN, with_beats, with_bins, window_stats
from nocturne.sources.adapters import event_seconds, sensor


def day_rows(spark, sf, step=300):
    return with_date(sensor(spark, sf, step))


def zone_sql(above: int, max_hr: int = 100) -> str:
    b = [max_hr * x for x in (0.5, 0.6, 0.7, 0.8, 0.9)]
    parts = []
    for i, lo in enumerate(b):
        top = f" AND hr < {b[i + 1]}" if i < 4 else ""
        parts.append(f"count(CASE WHEN hr > {above} AND hr >= {lo}{top} THEN 1 END) / 60.0 AS zone{i + 1}_min")
    return ", ".join(parts)


LOAD = "zone1_min + zone2_min * 2 + zone3_min * 4 + zone4_min * 8 + zone5_min * 16"

cte("daily_row", "dayp rest_day", f"""
    SELECT f.*, r.rhr FROM (
      SELECT user_id, date, count(*) AS n_samples, count(CASE WHEN hr > 0 THEN 1 END) AS n_valid_hr,
        coalesce(avg(h), 0) AS hr_mean, coalesce(stddev_pop(h), 0) AS hr_std, coalesce(min(h), 0) AS hr_min, coalesce(max(h), 0) AS hr_max,
        coalesce(quantile_cont(h, 0.05), 0) AS hr_p5, coalesce(quantile_cont(h, 0.25), 0) AS hr_p25,
        coalesce(quantile_cont(h, 0.75), 0) AS hr_p75, coalesce(quantile_cont(h, 0.95), 0) AS hr_p95,
        CASE WHEN count(r) >= 10 THEN sqrt(avg(d * d)) ELSE 0 END AS rmssd, CASE WHEN count(r) >= 10 THEN stddev_pop(r) ELSE 0 END AS hrv_sdnn,
        CASE WHEN count(r) >= 10 THEN 100.0 * count(CASE WHEN abs(d) > 50 THEN 1 END) / count(d) ELSE 0 END AS pnn50,
        avg(mv) AS movement_mean, stddev_samp(mv) AS movement_std, max(mv) AS movement_max, quantile_cont(mv, 0.9) AS movement_p90,
        {zone_sql(0)}, count(CASE WHEN hr > 30 THEN 1 END) AS n_hr30, coalesce(avg(spo2), 97) AS spo2_mean, coalesce(min(spo2), 95) AS spo2_min
      FROM (SELECT *, r - lag(r IGNORE NULLS) OVER (PARTITION BY user_id, date ORDER BY ts) AS d FROM (
        SELECT *, CASE WHEN hr > 0 THEN hr END AS h, CASE WHEN rr > 200 AND rr < 2500 THEN rr END AS r FROM dayp)) GROUP BY 1, 2) f
    JOIN rest_day r ON r.user_id = f.user_id AND r.date = f.date""")
DAILY = ("hr_mean hr_std hr_p5 hr_p25 hr_p75 hr_p95 rmssd hrv_sdnn pnn50 movement_mean movement_std movement_max movement_p90 "
         "zone1_min zone2_min zone3_min zone4_min zone5_min spo2_mean spo2_min rhr")


def daily_row(spark, sf):
    return aggregates.daily_features(day_rows(spark, sf), DAY, 30, 3, 100)


@query("a1_daily_features", sql(f"SELECT *, {LOAD} AS zone_load FROM daily_row", "daily_row", DAILY + " zone_load"))
def a1(spark, sf):
    return daily_row(spark, sf)


@query("a2_zone_minutes", sql(f"SELECT user_id, date, {zone_sql(0)} FROM day GROUP BY 1, 2", "day",
                              "zone1_min zone2_min zone3_min zone4_min zone5_min"))
def a2(spark, sf):
    zones = aggregates.relative_zone_columns(100)
    return day_rows(spark, sf).groupBy(*DAY).agg(*[c.alias(n) for n, c in zones.items()])


cte("zone_load", "day", f"SELECT *, {LOAD} AS zone_load FROM (SELECT user_id, date, {zone_sql(30)} FROM day GROUP BY 1, 2)")


@query("a3_zone_load", sql("SELECT * FROM zone_load", "zone_load", "zone1_min zone2_min zone3_min zone4_min zone5_min zone_load"))
def a3(spark, sf):
    return aggregates.zone_load(day_rows(spark, sf), DAY, 100)


_ABS = [(0, 108, 0), (109, 135, 1), (136, 149, 2.5), (150, 162, 5), (163, 176, 10), (177, 189, 20)]
cte("absolute", "day", f"""
    SELECT *, {' + '.join(f'zone{i}_min * {w}' for i, (_, _, w) in enumerate(_ABS))} AS zone_load FROM (
      SELECT user_id, date, {', '.join(f'count(CASE WHEN hr2 > 30 AND hr2 BETWEEN {a} AND {b} THEN 1 END) / 60.0 AS zone{i}_min' for i, (a, b, _) in enumerate(_ABS))},
             count(CASE WHEN hr2 > 30 THEN 1 END) AS n_valid, count(*) AS n_rows
      FROM (SELECT *, hr * 2 AS hr2 FROM day) GROUP BY 1, 2)""")
ABSOLUTE = "zone0_min zone1_min zone2_min zone3_min zone4_min zone5_min zone_load"


def doubled(rows):
    """Twice the heart rate, so that the absolute zones up to 189 are reached."""
    return rows.withColumn("hr", F.col("hr") * 2)


@query("a4_absolute_zones", sql("SELECT * FROM absolute", "absolute", ABSOLUTE))
def a4(spark, sf):
    return aggregates.absolute_zone_load(doubled(day_rows(spark, sf)))


@query("a5_zone_histogram", sql("""
    SELECT user_id, CASE WHEN hr < 94 THEN 'rest' WHEN hr < 113 THEN 'easy' WHEN hr < 132 THEN 'moderate' WHEN hr < 151 THEN 'hard' ELSE 'max' END AS zone, count(*) AS n
    FROM (SELECT user_id, hr * 2 AS hr FROM sensor) WHERE hr > 30 GROUP BY 1, 2""", "sensor"))
def a5(spark, sf):
    return aggregates.zone_histogram(doubled(sensor(spark, sf)))


@query("a5_zone_chip", sql("""
    SELECT CASE WHEN hr < 100 THEN 0 WHEN hr < 120 THEN 1 WHEN hr < 140 THEN 2 WHEN hr < 160 THEN 3 WHEN hr < 180 THEN 4 ELSE 5 END AS chip, count(*) AS n
    FROM (SELECT hr * 2 AS hr FROM sensor) GROUP BY 1""", "sensor"))
def a5_chip(spark, sf):
    return doubled(sensor(spark, sf)).groupBy(aggregates.zone_chip(F.col("hr")).alias("chip")).agg(
        F.count(F.lit(1)).alias("n")
    )


cte("hrv", "night", """
    SELECT user_id, night, count(*) AS n_rr, CASE WHEN count(*) >= 10 THEN sqrt(avg(d * d)) ELSE 0 END AS rmssd,
      CASE WHEN count(c) >= 10 THEN sqrt(avg(c * c)) ELSE 0 END AS rmssd_clean, CASE WHEN count(*) >= 10 THEN stddev_pop(rr) ELSE 0 END AS sdnn,
      CASE WHEN count(*) >= 10 THEN 100.0 * count(CASE WHEN abs(d) > 50 THEN 1 END) / count(d) ELSE 0 END AS pnn50,
      CASE WHEN count(*) >= 10 THEN 100.0 * count(CASE WHEN abs(d) > 20 THEN 1 END) / count(d) ELSE 0 END AS pnn20,
      stddev_pop(d) / sqrt(2) AS sd1, stddev_pop(s) / sqrt(2) AS sd2,
      CASE WHEN stddev_pop(s) / sqrt(2) > 0.01 THEN stddev_pop(d) / stddev_pop(s) ELSE 1 END AS sd_ratio,
      sqrt(greatest(2 * var_pop(rr) - var_pop(c) / 2, 0.01)) AS sd2_total, stddev_pop(rr) / avg(rr) AS cv, stddev_pop(rr) / avg(rr) * 20 AS complexity
    FROM (SELECT *, CASE WHEN abs(d) < 200 THEN d END AS c, 2 * rr - d AS s FROM (
      SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, night ORDER BY ts) AS d FROM night WHERE rr > 200 AND rr < 2500)) GROUP BY 1, 2""")


def hrv(spark, sf):
    return aggregates.hrv_time_domain(night_rows(spark, sf))


for _key, _cols in {
    "a6_rmssd_all_beats": "rmssd", "a7_rmssd_without_artefacts": "rmssd_clean", "a8_sdnn": "sdnn",
    "a9_pnn50_pnn20": "pnn50 pnn20", "a12_poincare": "sd1 sd2 sd_ratio sd2_total", "a13_variation_complexity": "cv complexity",
}.items():

    def _run(spark, sf, cols=_cols):
        return hrv(spark, sf).select(*NIGHT, *cols.split())

    query(_key, sql(f"SELECT user_id, night, {', '.join(_cols.split())} FROM hrv", "hrv", _cols))(_run)


@query("a10_daily_rmssd", sql("""
    SELECT user_id, date, count(*) AS n_rr, round_even(sqrt(avg(d * d)), 1) AS rmssd FROM (
      SELECT user_id, date, rr - lag(rr) OVER (PARTITION BY user_id, date ORDER BY ts) AS d FROM (
        SELECT *, strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INT), '%Y-%m-%d') AS date FROM sensor WHERE rr > 200 AND rr < 2000))
    GROUP BY 1, 2 HAVING count(*) >= 10""", "sensor", "rmssd"))
def a10(spark, sf):
    return aggregates.daily_rmssd(sensor(spark, sf))


@query("a11_flattened_hrv", sql("""
    SELECT user_id, slice, count(*) AS n_rr, sqrt(avg(d * d)) AS rmssd, stddev_pop(beat) AS sdnn FROM (
      SELECT *, beat - lag(beat) OVER (PARTITION BY user_id, slice ORDER BY ts, k) AS d FROM (
        SELECT user_id, (1704240000 - ts - 1) // 86400 AS slice, ts, unnest([rr, rr2]) AS beat, unnest([0, 1]) AS k FROM sensor
        WHERE ts < 1704240000 AND ts >= 1704240000 - 7 * 86400) WHERE beat > 200 AND beat < 2000)
    GROUP BY 1, 2 HAVING count(*) >= 2""", "sensor", "rmssd sdnn"))
def a11(spark, sf):
    return aggregates.flattened_hrv(sensor(spark, sf), F.lit(1704240000))


@query("a14_binned_entropy", sql("""
    SELECT user_id, night, -sum(p * log2(p)) AS entropy FROM (
      SELECT user_id, night, n / sum(n) OVER (PARTITION BY user_id, night) AS p FROM (
        SELECT user_id, night, floor((hr - (lo - 2.5)) / 5.0) AS bin, count(*) AS n FROM (
          SELECT *, min(hr) OVER (PARTITION BY user_id, night) AS lo FROM night WHERE hr > 30) GROUP BY 1, 2, 3)) GROUP BY 1, 2""", "night", "entropy"))
def a14(spark, sf):
    return aggregates.binned_entropy(night_rows(spark, sf).where("hr > 30"), "hr", 5.0, NIGHT)


def shaped(spark, sf):
    cut = positions.tumbling(positions.with_position(night_rows(spark, sf)), 20)
    return window_stats(with_bins(with_beats(cut)))


@query("a14_window_entropies", sql("""
    SELECT h.user_id, h.night, h.win, hr_entropy, rr_entropy FROM hr_ent h JOIN rr_ent r ON r.user_id = h.user_id AND r.night = h.night AND r.win = h.win""",
    "hr_ent rr_ent", "hr_entropy rr_entropy"))
def a14_windows(spark, sf):
    return shaped(spark, sf).select(*NIGHT_WIN, "hr_entropy", "rr_entropy")


@query("a15_skew_kurtosis", sql("SELECT * FROM shape", "shape", "hr_skew hr_kurt"))
def a15(spark, sf):
    return window_frame(spark, sf).select(*NIGHT_WIN, "hr_skew", "hr_kurt")


@query("a16_trend_slope", sql("SELECT user_id, night, win, hr_slope * n_hr AS hr_trend, rr_slope * n_rr AS rr_trend FROM w_st", "w_st", "hr_trend rr_trend"))
def a16(spark, sf):
    return window_frame(spark, sf).select(
        *NIGHT_WIN, (F.col("hr_slope") * F.col("n_hr")).alias("hr_trend"), (F.col("rr_slope") * F.col("n_rr")).alias("rr_trend")
    )


@query("a17_successive_changes", sql("SELECT user_id, night, win, hr_masd, hr_accel, hr_jumps FROM w_st", "w_st", "hr_masd hr_accel"))
def a17(spark, sf):
    return window_frame(spark, sf).select(*NIGHT_WIN, "hr_masd", "hr_accel", "hr_jumps")


@query("a18_movement_bursts", sql("""
    SELECT user_id, night, win, mv_changes / n_rows AS mv_zcr, mv_bursts, mv_active, mv_energy, mag_crossings FROM w_st""", "w_st", "mv_zcr mv_active mv_energy"))
def a18(spark, sf):
    return window_frame(spark, sf).select(
        *NIGHT_WIN, (F.col("mv_changes") / F.col("n_rows")).alias("mv_zcr"), "mv_bursts", "mv_active", "mv_energy", "mag_crossings"
    )


@query("a19_jerk_magnitude", sql("""
    SELECT user_id, night, win, jerk_max, jerk_p95, mag_mean, mag_std, mag_energy FROM w_st""", "w_st", "jerk_max jerk_p95 mag_mean mag_std mag_energy"))
def a19(spark, sf):
    return window_frame(spark, sf).select(*NIGHT_WIN, "jerk_max", "jerk_p95", "mag_mean", "mag_std", "mag_energy")


_OVERALL = """avg(CASE WHEN hr > 0 THEN hr END) AS hr_avg, min(CASE WHEN hr > 0 THEN hr END) AS hr_min, max(CASE WHEN hr > 0 THEN hr END) AS hr_max,
    avg(CASE WHEN spo2 > 10 AND spo2 <= 100 THEN spo2 END) AS spo2_avg, count(CASE WHEN hr > 0 THEN 1 END) AS n_hr, count(CASE WHEN spo2 > 10 AND spo2 <= 100 THEN 1 END) AS n_spo2"""


@query("a20_overall_statistics", sql(f"SELECT {_OVERALL} FROM sensor", "sensor", "hr_avg spo2_avg"))
def a20(spark, sf):
    return aggregates.overall_statistics(sensor(spark, sf))


@query("a20_user_statistics", sql(f"SELECT user_id, {_OVERALL} FROM sensor GROUP BY 1", "sensor", "hr_avg spo2_avg"))
def a20_user(spark, sf):
    return aggregates.overall_statistics(sensor(spark, sf), ["user_id"])


@query("a21_table_extent", sql("""
    SELECT user_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts // 86400) AS n_days FROM event_seconds GROUP BY 1""", "event_seconds"))
def a21(spark, sf):
    return aggregates.table_extent(event_seconds(spark, sf), ["user_id"])


cte("daily_hr", "sensor", """
    SELECT user_id, strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INT), '%Y-%m-%d') AS date, round_even(avg(hr), 1) AS avg_hr FROM sensor WHERE hr > 30 GROUP BY 1, 2""")


@query("a22_daily_mean_hr", sql("SELECT * FROM daily_hr", "daily_hr", "avg_hr"))
def a22(spark, sf):
    return aggregates.daily_mean_hr(sensor(spark, sf))


@query("a25_baselines", sql("""
    SELECT r.user_id, coalesce(quantile_cont(CASE WHEN hrv > 10 THEN hrv END, 0.5), 90) AS hrv_base, coalesce(quantile_cont(rest, 0.5), 55) AS rhr_base
    FROM (SELECT user_id, night, CASE WHEN count(CASE WHEN hr > 30 THEN 1 END) > 50 THEN
            (quantile_cont(CASE WHEN hr > 30 THEN hr END, 0.25) + quantile_cont(CASE WHEN hr > 30 THEN hr END, 0.5)) / 2 END AS rest
          FROM night WHERE n >= 100 GROUP BY 1, 2) r
    LEFT JOIN sws s ON s.user_id = r.user_id AND s.night = r.night GROUP BY 1""", "sws", "hrv_base rhr_base"))
def a25(spark, sf):
    return aggregates.baselines(night_rows(spark, sf), 50, 100, 50)


@query("a26_coverage", sql("""
    SELECT user_id, date, coverage, CASE WHEN coverage > 0.1 THEN least(3.0, 1.0 / coverage) ELSE 1 END AS scale
    FROM (SELECT user_id, date, count(CASE WHEN hr > 45 THEN 1 END) / count(*) AS coverage FROM day GROUP BY 1, 2)""", "day", "coverage scale"))
def a26(spark, sf):
    return aggregates.coverage(day_rows(spark, sf), DAY, 45)


# ------------------------------------------------------------------- detection


@query("e1_sleep_bounds", sql("""
    SELECT user_id, night, onset_ts, offset_ts, first_ts, last_ts,
      CASE WHEN (offset_ts > onset_ts AND offset_ts - onset_ts >= 10800) OR (onset_ts IS NOT NULL AND NOT coalesce(offset_ts > onset_ts, false) AND last_ts - onset_ts >= 10800)
        THEN onset_ts ELSE first_ts END AS sleep_start,
      CASE WHEN (offset_ts > onset_ts AND offset_ts - onset_ts >= 10800) OR (onset_ts IS NULL AND offset_ts > first_ts AND offset_ts - first_ts >= 10800)
        THEN offset_ts ELSE last_ts END AS sleep_end
    FROM (SELECT user_id, night, min(CASE WHEN ok AND pos % 5 = 0 AND pos < n - 10 AND base - m >= 2.0 AND gmax < 0.045 THEN ts END) AS onset_ts,
                 max(CASE WHEN ok AND pos + 10 <= n - 1 AND pos > 0 AND (n - 1 - pos - 10) % 5 = 0 AND gmax > 0.045 AND m > base - 2.0 + 3 THEN ts_at END) AS offset_ts,
                 min(ts) AS first_ts, max(ts) AS last_ts
          FROM (SELECT *, base_n >= 5 AND n >= 30 AND hn >= 5 AND fn = 10 AS ok FROM (
            SELECT *, avg(h) OVER f AS m, count(h) OVER f AS hn, count(*) OVER f AS fn, max(abs(gyro)) OVER f AS gmax,
                   lead(ts, 10) OVER w AS ts_at, quantile_cont(CASE WHEN pos < least(60, n // 3) THEN h END, 0.5) OVER g AS base,
                   count(CASE WHEN pos < least(60, n // 3) THEN h END) OVER g AS base_n
            FROM (SELECT *, CASE WHEN hr > 30 THEN hr END AS h FROM night)
            WINDOW f AS (PARTITION BY user_id, night ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), w AS (PARTITION BY user_id, night ORDER BY ts), g AS (PARTITION BY user_id, night)))
          GROUP BY 1, 2)""", "night"))
def e1(spark, sf):
    return detection.sleep_bounds(night_rows(spark, sf), 10, 5, 2.0, 0.045, 60, 5, 5, 30)


_CAL = "75.0 * n_hr30 / 3600.0 + 0.15 * zone_load + n_high / 60.0 * 2.0"


@query("e2_activity_bouts", sql(f"""
    SELECT user_id, date, start_ts, end_ts, round_even((end_ts - start_ts) / 60.0, 1) AS duration_min, avg_hr, max_hr,
      CASE WHEN zone_load <= 0 THEN 0 ELSE least(21.0, round_even(5.5 * ln(1 + zone_load / 15.0), 1)) END AS strain, round_even({_CAL}, 0) AS calories
    FROM (SELECT *, {LOAD} AS zone_load FROM (
      SELECT user_id, date, bout, min(ts) AS start_ts, max(ts) AS end_ts, round_even(avg(CASE WHEN hr > 30 THEN hr END), 1) AS avg_hr,
             max(CASE WHEN hr > 30 THEN hr END) AS max_hr, {zone_sql(30, 160)}, count(CASE WHEN hr > 30 THEN 1 END) AS n_hr30, count(CASE WHEN hr > 128 THEN 1 END) AS n_high
      FROM (SELECT *, max(CASE WHEN hr >= 80 THEN pos END) OVER (PARTITION BY user_id, date, bout) AS last_above FROM (
        SELECT *, sum(CASE WHEN hr >= 80 AND coalesce(pos - prev, 99) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date ORDER BY ts) AS bout FROM (
          SELECT *, max(CASE WHEN hr >= 80 THEN pos END) OVER (PARTITION BY user_id, date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dayp)))
      WHERE bout > 0 AND pos <= last_above GROUP BY 1, 2, 3)) WHERE end_ts - start_ts >= 300""", "dayp", "duration_min avg_hr strain calories"))
def e2(spark, sf):
    return detection.activity_bouts(day_rows(spark, sf), 160, 3, 300)


@query("e3_sleep_periods", sql("""
    SELECT user_id, date, start_ts, end_ts, chunks, avg_hr, duration_min, sum(duration_min) OVER (PARTITION BY user_id, date) AS total_min
    FROM (SELECT user_id, date, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS chunks, round_even(avg(round_even(h * 10, 0)), 0) / 10 AS avg_hr,
                 round_even((max(end_ts) - min(start_ts)) / 60.0, 0) AS duration_min
          FROM (SELECT *, sum(c) OVER (PARTITION BY user_id, date ORDER BY win) AS period FROM (
            SELECT *, CASE WHEN calm = lag(calm) OVER (PARTITION BY user_id, date ORDER BY win) THEN 0 ELSE 1 END AS c FROM (
              SELECT user_id, date, pos // 6 AS win, min(ts) AS start_ts, max(ts) AS end_ts, avg(CASE WHEN hr > 30 THEN hr END) AS h,
                     avg(CASE WHEN hr > 30 THEN hr END) < 68 AND var_pop(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)) < 0.0008 AS calm
              FROM utc WHERE (pos // 6) * 6 < n - 6 GROUP BY 1, 2, 3) WHERE h IS NOT NULL)) WHERE calm GROUP BY user_id, date, period HAVING count(*) >= 2)""",
    "sensor", "avg_hr duration_min total_min", extra="""
    utc AS (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY user_id, date) AS n
            FROM (SELECT *, strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INT), '%Y-%m-%d') AS date FROM sensor))"""))
def e3(spark, sf):
    return detection.sleep_periods(sensor(spark, sf), 6, 68.0, 0.0008, 2)


