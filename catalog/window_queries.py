"""SQL pieces of windows and their statistics, and the series queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from nocturne.operators import positions, series
from nocturne.operators.nights import DAY, NIGHT, with_date, with_night
from nocturne.operators.window_stats import NIGHT_WIN, with_beats, with_bins, window_stats
from nocturne.sources.adapters import daily_scores, sensor

ROWS = 20  # rows per window in the checked queries; the library defaults are 30 to 600


def night_rows(spark, sf, step=300):
    return with_night(sensor(spark, sf, step))


# ------------------------------------------------------------------ SQL pieces


def windows_cte(name: str, rows: int, stride: int | None = None, step: str = "", hr_above: int = 30) -> None:
    """Windows of rows with the derived columns of ``with_beats``."""
    if stride:
        source = f"""SELECT s.*, CAST(k.k AS INT) AS win FROM night{step} s,
            LATERAL (SELECT unnest(range(greatest(0, CAST(floor((s.pos - {rows}) / {stride}.0) AS INT) + 1),
                                         s.pos // {stride} + 1)) AS k) k
            WHERE k.k * {stride} < s.n - {rows}"""
    else:
        source = f"""SELECT *, CAST(pos // {rows} AS INT) AS win FROM night{step} WHERE (pos // {rows}) * {rows} < n - {rows}"""
    cte(f"{name}_a", f"night{step}", f"""
        SELECT *, CASE WHEN hr > {hr_above} THEN hr END AS hr_ok,
               CASE WHEN rr > 200 AND rr < 2500 THEN rr END AS rr_ok,
               sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS mag
        FROM ({source})""")
    cte(f"{name}_b", f"{name}_a", f"""
        SELECT *, row_number() OVER w - 1 AS row_in, count(*) OVER g AS rows_in,
               CASE WHEN hr_ok IS NOT NULL THEN count(hr_ok) OVER w END AS hr_at,
               CASE WHEN rr_ok IS NOT NULL THEN count(rr_ok) OVER w END AS rr_at,
               hr_ok - lag(hr_ok IGNORE NULLS) OVER w AS d_hr,
               rr_ok - lag(rr_ok IGNORE NULLS) OVER w AS d_rr,
               rr_ok + lag(rr_ok IGNORE NULLS) OVER w AS sum_rr,
               abs(mag - lag(mag) OVER w) AS d_mag,
               sign(mag - avg(mag) OVER g) AS mag_sign,
               min(hr_ok) OVER g AS hr_low, min(rr_ok) OVER g AS rr_low,
               lag(mv > 0.1) OVER w AS was_moving, lag(mv > 0.08) OVER w AS was_burst
        FROM {name}_a
        WINDOW w AS (PARTITION BY user_id, night, win ORDER BY ts), g AS (PARTITION BY user_id, night, win)""")
    cte(f"{name}_c", f"{name}_b", f"""
        SELECT *, d_hr - lag(d_hr IGNORE NULLS) OVER w AS d2_hr,
               CASE WHEN mag_sign <> lag(mag_sign) OVER w THEN 1 ELSE 0 END AS mag_cross,
               floor((hr_ok - (hr_low - 2.5)) / 5.0) AS hr_bin, floor((rr_ok - (rr_low - 25.0)) / 50.0) AS rr_bin
        FROM {name}_b WINDOW w AS (PARTITION BY user_id, night, win ORDER BY ts)""")
    cte(f"{name}_st", f"{name}_c", f"""
        SELECT user_id, night, win, any_value(night_first) AS night_first, any_value(night_last) AS night_last,
          count(*) AS n_rows, min(ts) AS start_ts, max(ts) AS last_ts,
          max(CASE WHEN row_in = rows_in // 2 THEN ts END) AS mid_ts,
          count(hr_ok) AS n_hr, avg(hr_ok) AS hr_mean, stddev_pop(hr_ok) AS hr_std, min(hr_ok) AS hr_min, max(hr_ok) AS hr_max,
          quantile_cont(hr_ok, 0.1) AS hr_p10, quantile_cont(hr_ok, 0.25) AS hr_p25, quantile_cont(hr_ok, 0.5) AS hr_med,
          quantile_cont(hr_ok, 0.75) AS hr_p75, quantile_cont(hr_ok, 0.9) AS hr_p90,
          list_sort(list(hr_ok) FILTER (hr_ok IS NOT NULL))[CAST(floor(count(hr_ok) * 0.25) AS INT) + 1] AS hr_f25,
          list_sort(list(hr_ok) FILTER (hr_ok IS NOT NULL))[CAST(floor(count(hr_ok) * 0.75) AS INT) + 1] AS hr_f75,
          regr_slope(hr_ok, hr_at) AS hr_slope, avg(abs(d_hr)) AS hr_masd, stddev_pop(abs(d_hr)) AS hr_masd_std,
          avg(abs(d2_hr)) AS hr_accel, var_pop(d2_hr) AS hr_accel_var,
          coalesce(sum(CASE WHEN abs(d_hr) > 5 THEN 1 ELSE 0 END), 0) AS hr_jumps,
          count(rr_ok) AS n_rr, avg(rr_ok) AS rr_mean, stddev_pop(rr_ok) AS rr_std, regr_slope(rr_ok, rr_at) AS rr_slope,
          count(CASE WHEN abs(d_rr) < 300 THEN 1 END) AS n_d300,
          sqrt(avg(CASE WHEN abs(d_rr) < 300 THEN d_rr * d_rr END)) AS rmssd300,
          stddev_pop(CASE WHEN abs(d_rr) < 300 THEN d_rr END) AS sd_d300,
          count(CASE WHEN abs(d_rr) < 300 AND abs(d_rr) > 50 THEN 1 END) AS n50,
          count(CASE WHEN abs(d_rr) < 300 AND abs(d_rr) > 20 THEN 1 END) AS n20,
          count(d_rr) AS n_d, sqrt(avg(d_rr * d_rr)) AS rmssd_all, count(CASE WHEN abs(d_rr) > 50 THEN 1 END) AS n50_all,
          stddev_pop(d_rr) AS sd_d, stddev_pop(sum_rr) AS sd_sum,
          avg(mv) AS mv_mean, stddev_pop(mv) AS mv_std, max(mv) AS mv_max, quantile_cont(mv, 0.9) AS mv_p90,
          quantile_cont(mv, 0.95) AS mv_p95, sum(mv * mv) AS mv_energy,
          sum(CASE WHEN (mv > 0.1) <> was_moving THEN 1 ELSE 0 END) AS mv_changes,
          sum(CASE WHEN mv > 0.08 AND NOT was_burst THEN 1 ELSE 0 END) AS mv_bursts,
          avg(CASE WHEN mv > 0.05 THEN 1.0 ELSE 0.0 END) AS mv_active,
          stddev_pop(acc_x) AS acc_x_std, stddev_pop(acc_y) AS acc_y_std, stddev_pop(mag) AS acc_mag_std,
          var_pop(acc_z) AS acc_z_var, max(d_mag) AS jerk_max, quantile_cont(d_mag, 0.95) AS jerk_p95,
          avg(CASE WHEN mag > 0.01 THEN mag END) AS mag_mean, stddev_pop(CASE WHEN mag > 0.01 THEN mag END) AS mag_std,
          avg(CASE WHEN mag > 0.01 THEN mag * mag END) AS mag_energy, sum(mag_cross) AS mag_crossings,
          avg(abs(gyro)) AS gyro_abs, stddev_pop(gyro) AS gyro_std, max(abs(gyro)) AS gyro_max,
          avg(CASE WHEN abs(gyro) > 0.001 THEN abs(gyro) END) AS gyro_nz_abs,
          stddev_pop(CASE WHEN abs(gyro) > 0.001 THEN gyro END) AS gyro_nz_std,
          sum(CASE WHEN abs(gyro) > 0.05 THEN 1 ELSE 0 END) AS gyro_spikes,
          avg(spo2) AS spo2_mean, min(spo2) AS spo2_min, count(spo2) AS n_spo2, stddev_pop(spo2) AS spo2_std
        FROM {name}_c GROUP BY user_id, night, win""")


windows_cte("w", ROWS)
windows_cte("w0", ROWS, hr_above=0)
windows_cte("ws", ROWS, ROWS // 2)

cte("shape", "w_c", """
    SELECT c.user_id, c.night, c.win,
      CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS hr_skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS hr_kurt
    FROM (SELECT c.user_id, c.night, c.win, avg(pow(hr_ok - mu, 2)) AS m2, avg(pow(hr_ok - mu, 3)) AS m3, avg(pow(hr_ok - mu, 4)) AS m4
          FROM w_c c JOIN (SELECT user_id, night, win, avg(hr_ok) AS mu FROM w_c GROUP BY 1, 2, 3) a
            ON a.user_id = c.user_id AND a.night = c.night AND a.win = c.win GROUP BY 1, 2, 3) c""")
for _v in ("hr", "rr"):
    cte(f"{_v}_ent", "w_c", f"""
        SELECT user_id, night, win, -sum(p * log2(p)) AS {_v}_entropy FROM (
          SELECT *, n / sum(n) OVER (PARTITION BY user_id, night, win) AS p FROM (
            SELECT user_id, night, win, {_v}_bin, count(*) AS n FROM w_c WHERE {_v}_ok IS NOT NULL GROUP BY 1, 2, 3, 4))
        GROUP BY 1, 2, 3""")

REST_SQL = """
    SELECT {k}, CASE WHEN nv < {w} THEN coalesce(med, 60) ELSE coalesce(best, 60) END AS rhr FROM (
      SELECT {k}, count(CASE WHEN hr > 0 THEN 1 END) AS nv,
             quantile_cont(CASE WHEN hr > 0 THEN hr END, 0.5) AS med,
             min(CASE WHEN pos % {s} = 0 AND pos < n - {w} AND fn >= {w} * 0.5 THEN fs / fn END) AS best
      FROM (SELECT *, sum(CASE WHEN hr > 0 THEN hr END) OVER f AS fs, count(CASE WHEN hr > 0 THEN 1 END) OVER f AS fn
            FROM {t} WINDOW f AS (PARTITION BY {k} ORDER BY ts ROWS BETWEEN CURRENT ROW AND {w1} FOLLOWING))
      GROUP BY {k})"""
cte("rest", "night", REST_SQL.format(k="user_id, night", w=30, s=3, w1=29, t="night"))
cte("rest_day", "dayp", REST_SQL.format(k="user_id, date", w=30, s=3, w1=29, t="dayp"))


def rest(spark, sf):
    return series.resting_hr(night_rows(spark, sf), NIGHT, 30, 3)


def window_frame(spark, sf, rows=ROWS, hr_above=30, bins=False):
    cut = positions.tumbling(positions.with_position(night_rows(spark, sf)), rows)
    beats = with_beats(cut, NIGHT_WIN, hr_above)
    return window_stats(with_bins(beats) if bins else beats)


# -------------------------------------------------------------- resting HR, HRV


@query("w1_resting_hr", sql("SELECT * FROM rest", "rest", "rhr"))
def w1(spark, sf):
    return rest(spark, sf)


_VALID = """SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY ts) - 1 AS p,
    count(*) OVER (PARTITION BY user_id, night) AS m FROM night WHERE hr > 30"""


@query("w2_resting_hr_filtered", sql(f"""
    SELECT user_id, night, coalesce(min(CASE WHEN p % 30 = 0 AND p < m - 40 THEN f END), quantile_cont(hr, 0.1)) AS rhr
    FROM (SELECT *, avg(hr) OVER (PARTITION BY user_id, night ORDER BY ts ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS f
          FROM ({_VALID})) GROUP BY 1, 2""", "night", "rhr"))
def w2_filtered(spark, sf):
    return series.resting_hr_variant(night_rows(spark, sf), "filtered", NIGHT, 40)


@query("w2_resting_hr_median", sql(f"""
    SELECT v.user_id, v.night, CASE WHEN any_value(m) < 10 THEN 55 ELSE coalesce(any_value(b.best), quantile_cont(hr, 0.1)) END AS rhr
    FROM ({_VALID}) v LEFT JOIN (
      SELECT user_id, night, min(med) AS best FROM (
        SELECT a.user_id, a.night, k.range AS k, quantile_cont(a.hr, 0.5) AS med FROM ({_VALID}) a, range(4) k
        WHERE a.p >= k.range * 60 AND a.p < k.range * 60 + 40 AND k.range * 60 < a.m - 40 GROUP BY 1, 2, 3) GROUP BY 1, 2) b
      ON b.user_id = v.user_id AND b.night = v.night GROUP BY 1, 2""", "night", "rhr"))
def w2_median(spark, sf):
    return series.resting_hr_variant(night_rows(spark, sf), "median", NIGHT, 40)


@query("w2_resting_hr_quartile", sql("""
    SELECT user_id, night, CASE WHEN count(*) < 100 THEN quantile_cont(hr, 0.5)
      ELSE round_even((quantile_cont(hr, 0.25) + quantile_cont(hr, 0.5)) / 2, 1) END AS rhr
    FROM night WHERE hr > 30 GROUP BY 1, 2""", "night", "rhr"))
def w2_quartile(spark, sf):
    return series.resting_hr_variant(night_rows(spark, sf), "quartile", NIGHT, 100)


@query("w2_resting_hr_floor_quartile", sql(f"""
    SELECT user_id, night, CASE WHEN any_value(m) < 100 THEN quantile_cont(hr, 0.5)
      ELSE floor((max(CASE WHEN r = floor(m * 0.25) THEN hr END) + quantile_cont(hr, 0.5)) / 2 * 10 + 0.5) / 10 END AS rhr
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY hr, ts) - 1 AS r FROM ({_VALID})) GROUP BY 1, 2""",
    "night", "rhr"))
def w2_floor(spark, sf):
    return series.resting_hr_variant(night_rows(spark, sf), "floor_quartile", NIGHT, 100)


@query("w2_resting_hr_running", sql(f"""
    SELECT user_id, night, round_even(CASE WHEN any_value(m) < 40 THEN avg(CASE WHEN r <= greatest(1, m // 10) THEN hr END)
      ELSE min(CASE WHEN p <= m - 40 THEN f END) END, 1) AS rhr
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY hr, ts) AS r,
            avg(hr) OVER (PARTITION BY user_id, night ORDER BY ts ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS f
          FROM ({_VALID})) GROUP BY 1, 2""", "night", "rhr"))
def w2_running(spark, sf):
    return series.resting_hr_variant(night_rows(spark, sf), "running", NIGHT, 40)


def _sws_sql(app: bool) -> str:
    edge = "<=" if app else "<"
    return f"""
    SELECT b.user_id, b.night, CASE WHEN b.m < {30 if app else 10} THEN 0 WHEN b.m < 60 THEN b.short ELSE coalesce(c.rmssd, 0) END AS hrv
    FROM (SELECT user_id, night, any_value(m) AS m, {"coalesce(CASE WHEN count(CASE WHEN abs(d) < 200 THEN 1 END) > 5 THEN sqrt(avg(CASE WHEN abs(d) < 200 THEN d * d END)) END, 0)" if app else "sqrt(avg(d * d))"} AS short FROM beat GROUP BY 1, 2) b
    LEFT JOIN (
      SELECT user_id, night, arg_min(rmssd, score) AS rmssd FROM (
        SELECT user_id, night, k, count(CASE WHEN p > k * step AND abs(d) < 200 THEN 1 END) AS nd,
               sqrt(avg(CASE WHEN p > k * step AND abs(d) < 200 THEN d * d END)) AS rmssd,
               round(stddev_pop(rr) * 2 - avg(rr), 9) * 1000000 + k / 1000000.0 AS score
        FROM (SELECT b.*, k.range AS k FROM beat b, range(40) k
              WHERE b.m >= 60 AND b.p >= k.range * b.step AND b.p < k.range * b.step + b.w AND k.range * b.step {edge} b.m - b.w)
        GROUP BY 1, 2, 3) WHERE nd >= 10 GROUP BY 1, 2) c ON c.user_id = b.user_id AND c.night = b.night"""


cte("beat", "night", """
    SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, night ORDER BY ts) AS d,
           least(50, m // 2) AS w, greatest(1, least(50, m // 2) // 4) AS step
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY ts) - 1 AS p,
                 count(*) OVER (PARTITION BY user_id, night) AS m FROM night WHERE rr > 200 AND rr < 2500)""")


cte("sws", "beat", _sws_sql(False))


@query("w3_sws_hrv", sql("SELECT * FROM sws", "sws", "hrv"))
def w3(spark, sf):
    return series.sws_hrv(night_rows(spark, sf), NIGHT, 50)


@query("w3_sws_hrv_app", sql(_sws_sql(True), "beat", "hrv"))
def w3_app(spark, sf):
    return series.sws_hrv(night_rows(spark, sf), NIGHT, 50, app=True, min_beats=30)


# ----------------------------------------------------------------- windows

_WIN_SQL = """SELECT user_id, night, win, count(*) AS n_rows, min(ts) AS start_ts, sum(hr) AS hr_sum FROM {} GROUP BY 1, 2, 3"""


def _win(df):
    return df.groupBy(*NIGHT_WIN).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("start_ts"), F.sum("hr").alias("hr_sum")
    )


@query("w4_tumbling_windows", sql(_WIN_SQL.format("w_a"), "w_a"))
def w4(spark, sf):
    return _win(positions.tumbling(positions.with_position(night_rows(spark, sf)), ROWS))


@query("w5_sliding_windows", sql(_WIN_SQL.format("ws_a"), "ws_a"))
def w5(spark, sf):
    return _win(positions.sliding(positions.with_position(night_rows(spark, sf)), ROWS, ROWS // 2))


cte("bounds", "night", "SELECT user_id, night, min(ts) AS start_ts, max(ts) - 1000 AS end_ts FROM night GROUP BY 1, 2")


def night_bounds(rows):
    return rows.groupBy(*NIGHT).agg(
        F.min("timestamp").alias("start_ts"), (F.max("timestamp") - 1000).alias("end_ts")
    )


@query("w6_time_windows", sql("""
    SELECT s.user_id, s.night, s.win, coalesce(d.n_rows, 0) AS n_rows,
           CASE WHEN coalesce(d.n_hr, 0) >= 6 THEN d.hr_mean END AS hr_mean,
           CASE WHEN coalesce(d.n_hr, 0) >= 6 THEN 'staged' ELSE 'light' END AS placeholder
    FROM (SELECT user_id, night, start_ts, end_ts, CAST(unnest(range((end_ts - start_ts) // 2100)) AS INT) AS win FROM bounds) s
    LEFT JOIN (SELECT n.user_id, n.night, (n.ts - b.start_ts) // 2100 AS win, count(*) AS n_rows,
                      count(CASE WHEN hr > 60 THEN 1 END) AS n_hr, avg(CASE WHEN hr > 60 THEN hr END) AS hr_mean
               FROM night n JOIN bounds b ON n.user_id = b.user_id AND n.night = b.night GROUP BY 1, 2, 3) d
      ON d.user_id = s.user_id AND d.night = s.night AND d.win = s.win""", "bounds", "hr_mean"))
def w6(spark, sf):
    rows = night_rows(spark, sf)
    bounds = night_bounds(rows)
    hr = F.when(F.col("hr") > 60, F.col("hr"))
    data = positions.time_windows(rows.join(bounds, NIGHT), 2100).groupBy(*NIGHT_WIN).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(hr).alias("n_hr"), F.avg(hr).alias("hr_mean")
    )
    joined = positions.window_spine(bounds, 2100).join(data, NIGHT_WIN, "left")
    enough = F.coalesce("n_hr", F.lit(0)) >= 6
    return joined.select(
        *NIGHT_WIN, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(enough, F.col("hr_mean")).alias("hr_mean"),
        F.when(enough, "staged").otherwise("light").alias("placeholder"),
    )


@query("w7_successive_differences", sql("""
    SELECT user_id, night, win, hr_masd, hr_accel, hr_accel_var, hr_masd_std FROM w_st""", "w_st",
    "hr_masd hr_accel hr_accel_var hr_masd_std"))
def w7(spark, sf):
    return window_frame(spark, sf).select(*NIGHT_WIN, "hr_masd", "hr_accel", "hr_accel_var", "hr_masd_std")


_SEQ = "PARTITION BY user_id, night ORDER BY win"


@query("w8_trailing_means", sql(f"""
    SELECT user_id, night, win, {", ".join(f"avg(hr_mean) OVER ({_SEQ} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS roll{k}" for k in (3, 5, 10, 15))}
    FROM w_st""", "w_st", "roll3 roll5 roll10 roll15"))
def w8(spark, sf):
    w = window_frame(spark, sf)
    return w.select(*NIGHT_WIN, *[series.trailing_mean("hr_mean", k).alias(f"roll{k}") for k in (3, 5, 10, 15)])


@query("w9_full_rolling", sql(f"""
    SELECT user_id, night, win, CASE WHEN count(hr_mean) OVER f3 = 3 THEN avg(hr_mean) OVER f3 ELSE hr_mean END AS roll_mean,
      CASE WHEN count(hr_mean) OVER f3 = 3 THEN stddev_pop(hr_mean) OVER f3 ELSE 0 END AS roll_std,
      CASE WHEN count(hr_mean) OVER f5 = 5 THEN avg(hr_mean) OVER f5 ELSE hr_mean END AS roll5_mean
    FROM w_st WINDOW f3 AS ({_SEQ} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f5 AS ({_SEQ} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "w_st", "roll_mean roll_std roll5_mean"))
def w9(spark, sf):
    hr = F.col("hr_mean")
    return window_frame(spark, sf).select(
        *NIGHT_WIN,
        series.trailing_full(F.avg(hr), hr, 3, hr).alias("roll_mean"),
        series.trailing_full(F.stddev_pop(hr), hr, 3, F.lit(0.0)).alias("roll_std"),
        series.trailing_full(F.avg(hr), hr, 5, hr).alias("roll5_mean"),
    )


@query("w10_previous_windows", sql(f"""
    SELECT user_id, night, win, hr_mean - coalesce(lag(hr_mean) OVER w, hr_mean) AS delta_hr,
      coalesce(lag(hr_mean, 1) OVER w, hr_mean) AS prev1, coalesce(lag(hr_mean, 2) OVER w, hr_mean) AS prev2,
      coalesce(lag(hr_mean, 3) OVER w, hr_mean) AS prev3 FROM w_st WINDOW w AS ({_SEQ})""", "w_st", "delta_hr prev1 prev2 prev3"))
def w10(spark, sf):
    return window_frame(spark, sf).select(
        *NIGHT_WIN, (F.col("hr_mean") - series.previous("hr_mean")).alias("delta_hr"),
        *[series.previous("hr_mean", k).alias(f"prev{k}") for k in (1, 2, 3)],
    )


@query("w11_trailing_slope", sql(f"""
    SELECT user_id, night, win, CASE WHEN count(*) OVER f = 5 THEN regr_slope(hr_mean, CAST(win AS DOUBLE)) OVER f ELSE 0 END AS slope
    FROM w_st WINDOW f AS ({_SEQ} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", "w_st", "slope"))
def w11(spark, sf):
    return window_frame(spark, sf).select(*NIGHT_WIN, series.trailing_slope5("hr_mean").alias("slope"))


@query("w12_cumulative_shares", sql(f"""
    SELECT s.user_id, s.night, s.win,
      coalesce(avg(CASE WHEN hr_mean - rhr < 5 AND mv_mean < 0.3 THEN 1.0 ELSE 0.0 END) OVER b, 0) AS deep_share,
      coalesce(avg(CASE WHEN hr_p75 - hr_p25 > 8 AND mv_mean < 0.5 THEN 1.0 ELSE 0.0 END) OVER b, 0) AS rem_share,
      coalesce(avg(CASE WHEN mv_mean > 0.3 OR hr_mean - rhr > 15 THEN 1.0 ELSE 0.0 END) OVER b, 0) AS awake_share,
      (row_number() OVER (PARTITION BY s.user_id, s.night ORDER BY win) - 1) * 60 / 3600.0 AS hours
    FROM w_st s JOIN rest r ON r.user_id = s.user_id AND r.night = s.night
    WINDOW b AS (PARTITION BY s.user_id, s.night ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "w_st rest", "deep_share rem_share awake_share hours"))
def w12(spark, sf):
    w = window_frame(spark, sf).join(rest(spark, sf), NIGHT)
    above, mv, spread = F.col("hr_mean") - F.col("rhr"), F.col("mv_mean"), F.col("hr_p75") - F.col("hr_p25")
    at = F.row_number().over(W.partitionBy(*NIGHT).orderBy("win")) - 1
    return w.select(
        *NIGHT_WIN,
        series.share_before((above < 5) & (mv < 0.3)).alias("deep_share"),
        series.share_before((spread > 8) & (mv < 0.5)).alias("rem_share"),
        series.share_before((mv > 0.3) | (above > 15)).alias("awake_share"),
        (at * 60 / 3600.0).alias("hours"),
    )


cte("position", "w_st", """
    SELECT user_id, night, win, (mid_ts - night_first) / 3600.0 AS hours_since_onset,
      CASE WHEN night_last > night_first THEN greatest(0, least(1, (mid_ts - night_first) / (night_last - night_first))) ELSE 0.5 END AS fraction_of_night,
      sin(2 * pi() * ((mid_ts % 86400) / 3600.0) / 24) AS circadian_sin, cos(2 * pi() * ((mid_ts % 86400) / 3600.0) / 24) AS circadian_cos,
      sin(2 * pi() * ((mid_ts - night_first) / 60.0) / 90) AS ultradian_sin, cos(2 * pi() * ((mid_ts - night_first) / 60.0) / 90) AS ultradian_cos,
      ((mid_ts - night_first) / 60.0 % 90) / 90.0 AS expected_cycle_phase, floor((mid_ts - night_first) / 60.0 / 90) AS sleep_cycle_number
    FROM w_st""")
POSITION = ("hours_since_onset fraction_of_night circadian_sin circadian_cos ultradian_sin ultradian_cos "
            "expected_cycle_phase sleep_cycle_number")


def with_bounds(w, rows):
    bounds = rows.groupBy(*NIGHT).agg(
        F.min("timestamp").alias("night_start"), F.max("timestamp").alias("night_end")
    )
    return series.with_night_position(w.join(bounds, NIGHT))


@query("w13_night_position", sql("SELECT * FROM position", "position", POSITION))
def w13(spark, sf):
    return with_bounds(window_frame(spark, sf), night_rows(spark, sf)).select(*NIGHT_WIN, *POSITION.split())


@query("w14_night_zscore", sql("""
    SELECT user_id, night, win, (hr_mean - avg(hr_mean) OVER g) / (stddev_pop(hr_mean) OVER g + 1e-6) AS hr_mean_zn,
      (mv_mean - avg(mv_mean) OVER g) / (stddev_pop(mv_mean) OVER g + 1e-6) AS mv_mean_zn
    FROM w_st WINDOW g AS (PARTITION BY user_id, night)""", "w_st", "hr_mean_zn mv_mean_zn", digits=5), digits=5)
def w14(spark, sf):
    w = series.night_zscore(window_frame(spark, sf), ["hr_mean", "mv_mean"])
    return w.select(*NIGHT_WIN, "hr_mean_zn", "mv_mean_zn")


@query("w15_night_percentiles", sql("""
    SELECT user_id, night, max(p5) AS night_p5, max(p10) AS night_p10, max(p50) AS night_median, max(p95) AS night_p95,
           max(m) AS night_mean, max(s) AS night_std FROM (
      SELECT user_id, night, quantile_cont(h, 0.05) AS p5, quantile_cont(h, 0.1) AS p10, quantile_cont(h, 0.5) AS p50,
             quantile_cont(h, 0.95) AS p95, avg(h) AS m, stddev_pop(h) AS s
      FROM (SELECT *, CASE WHEN hr > 30 AND hr < 200 THEN hr END AS h FROM night) GROUP BY 1, 2) GROUP BY 1, 2""",
    "night", "night_p5 night_p10 night_median night_p95 night_mean night_std"))
def w15(spark, sf):
    cols = ["night_p5", "night_p10", "night_median", "night_p95", "night_mean", "night_std"]
    return series.night_percentiles(night_rows(spark, sf)).groupBy(*NIGHT).agg(*[F.max(c).alias(c) for c in cols])


@query("w16_ema_baseline", sql("""
    SELECT user_id, date, hrv, ema FROM ema""", "daily", "hrv ema", recursive=True, extra="""
    d AS (SELECT user_id, date, hrv, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM daily),
    ema AS (SELECT user_id, date, hrv, i, hrv AS ema FROM d WHERE i = 1
            UNION ALL SELECT d.user_id, d.date, d.hrv, d.i, 0.1 * d.hrv + 0.9 * e.ema FROM ema e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1)"""))
def w16(spark, sf):
    return series.ema_baseline(daily_scores(spark, sf), "hrv", "ema")


@query("w17_last_nights_mean", sql("""
    SELECT user_id, date, coalesce(avg(CASE WHEN hrv > 0 THEN hrv END) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 60) AS hrv_base
    FROM daily""", "daily", "hrv_base"))
def w17(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", series.last_mean("hrv").alias("hrv_base"))


@query("w18_centred_mean", sql("""
    SELECT user_id, date, ts AS timestamp, coalesce(avg(CASE WHEN hr > 0 THEN hr END) OVER (PARTITION BY user_id, date ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 0) AS smooth
    FROM day""", "day", "smooth"))
def w18(spark, sf):
    rows = with_date(sensor(spark, sf))
    return rows.select("user_id", "date", "timestamp", series.centred_mean("hr", 10, DAY).alias("smooth"))


@query("w19_movement_proxy", sql("""
    SELECT s.user_id, s.night, s.epoch, coalesce(p.proxy, 0.01) AS proxy
    FROM (SELECT user_id, night, CAST(unnest(range(max(epochs))) AS INT) AS epoch FROM e0 GROUP BY 1, 2) s
    LEFT JOIN (SELECT user_id, night, epoch, CASE WHEN raw IS NULL THEN 0.01 ELSE greatest(0.001, least(10.0,
        CASE WHEN raw <= p10 THEN raw / greatest(p10, 0.001) * 0.01
             WHEN raw <= p50 THEN 0.01 + (raw - p10) / greatest(p50 - p10, 0.001) * 0.04
             WHEN raw <= p90 THEN 0.05 + (raw - p50) / greatest(p90 - p50, 0.001) * 0.45
             WHEN raw <= p99 THEN 0.5 + (raw - p90) / greatest(p99 - p90, 0.001) * 4.5
             ELSE 5.0 + least(5.0, (raw - p99) / greatest(p99, 0.001) * 5.0) END)) END AS proxy
      FROM (SELECT *, quantile_cont(raw, 0.1) OVER g AS p10, quantile_cont(raw, 0.5) OVER g AS p50,
                   quantile_cont(raw, 0.9) OVER g AS p90, quantile_cont(raw, 0.99) OVER g AS p99
            FROM e2 WINDOW g AS (PARTITION BY user_id, night))) p
      ON p.user_id = s.user_id AND p.night = s.night AND p.epoch = s.epoch""", "night10", "proxy", extra="""
    e0 AS (SELECT * FROM (SELECT *, (ts - t0) // 60 AS epoch, greatest(1, (t1 - t0) // 60) AS epochs,
              CASE WHEN hr > 30 AND hr < 220 THEN hr END AS h, CASE WHEN rr > 200 AND rr < 2500 THEN rr END AS r
            FROM (SELECT *, min(ts) OVER g AS t0, max(ts) OVER g AS t1 FROM night10 WINDOW g AS (PARTITION BY user_id, night))) WHERE epoch < epochs),
    e1 AS (SELECT user_id, night, epoch, CASE WHEN count(h) >= 2 THEN avg(h) END AS mh,
              CASE WHEN count(h) >= 2 THEN coalesce(avg(dh), 0) + (max(h) - min(h)) * 0.3 + coalesce(stddev_pop(dr), 0) * 0.01 END AS raw
           FROM (SELECT *, abs(h - lag(h IGNORE NULLS) OVER w) AS dh, abs(r - lag(r IGNORE NULLS) OVER w) AS dr FROM e0
                 WINDOW w AS (PARTITION BY user_id, night, epoch ORDER BY ts)) GROUP BY 1, 2, 3),
    e2 AS (SELECT user_id, night, epoch, raw + greatest(0, mh - quantile_cont(mh, 0.25) OVER (PARTITION BY user_id, night ORDER BY epoch
              RANGE BETWEEN 30 PRECEDING AND 29 FOLLOWING)) * 0.3 AS raw FROM e1)"""))
def w19(spark, sf):
    return series.movement_proxy(night_rows(spark, sf, 10), NIGHT, 60)


@query("w20_green_streak", sql("""
    SELECT user_id, CAST(sum(still) AS BIGINT) AS streak FROM (
      SELECT user_id, min(CASE WHEN recovery >= 67 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY date DESC) AS still FROM daily)
    GROUP BY 1""", "daily"))
def w20(spark, sf):
    return series.green_streak(daily_scores(spark, sf))


@query("w22_beat_times", sql("""
    SELECT user_id, night, count(*) AS n_beats, max(beat) AS last_beat, sum(beat_s) AS sum_s, max(beat_s) AS last_s FROM (
      SELECT user_id, night, b AS beat, t - dt + (b * 120 - c0) / area * dt AS beat_s FROM (
        SELECT user_id, night, t, dt, area, c1 - area AS c0, CAST(unnest(range(CAST((c1 - area) // 120 + 1 AS BIGINT), CAST(c1 // 120 + 1 AS BIGINT))) AS DOUBLE) AS b FROM (
          SELECT *, sum(area) OVER (PARTITION BY user_id, night ORDER BY ts) AS c1 FROM (
            SELECT *, ts - min(ts) OVER g AS t, ts - lag(ts) OVER w AS dt, coalesce((hr + lag(hr) OVER w) * (ts - lag(ts) OVER w), 0) AS area
            FROM night10 WHERE hr > 30 AND hr < 200 WINDOW w AS (PARTITION BY user_id, night ORDER BY ts), g AS (PARTITION BY user_id, night)))
        WHERE area > 0))
    GROUP BY 1, 2""", "night10", "sum_s last_s", digits=3), digits=3)
def w22(spark, sf):
    return series.beat_times(night_rows(spark, sf, 10)).groupBy(*NIGHT).agg(
        F.count(F.lit(1)).alias("n_beats"), F.max("beat").cast("double").alias("last_beat"),
        F.sum("beat_s").alias("sum_s"), F.max("beat_s").alias("last_s"),
    )


cte("wl", "w_c", "SELECT user_id, night, win, arg_max(label, n * 100 - label) AS label FROM (SELECT user_id, night, win, label, count(*) AS n FROM w_c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
cte("wruns", "wl", """
    SELECT user_id, night, run, label, min(win) AS first, max(win) AS last, count(*) AS length FROM (
      SELECT *, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
        SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM wl))
    GROUP BY 1, 2, 3, 4""")


def window_labels(spark, sf, rows=ROWS):
    """Majority label of each window, the smaller class on a tie."""
    return window_frame(spark, sf, rows).select(*NIGHT_WIN, "label", "start_ts", "last_ts", "mid_ts")


@query("w23_runs", sql("SELECT user_id, night, CAST(run AS BIGINT) AS run, label, first, last, length FROM wruns", "wruns"))
def w23(spark, sf):
    return series.runs(window_labels(spark, sf), "label")


@query("w24_drop_ectopic", sql("""
    SELECT user_id, night, count(*) AS n_beats, sum(rr_ms) AS raw_sum, sum(clean) AS clean_sum,
           count(CASE WHEN rr_ms <> clean THEN 1 END) AS replaced
    FROM fold GROUP BY 1, 2""", "night", "raw_sum clean_sum", digits=4, recursive=True, extra="""
    b AS (SELECT user_id, night, ts, rr AS rr_ms, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, night) AS m
          FROM night WHERE rr > 200 AND rr < 2500 WINDOW w AS (PARTITION BY user_id, night ORDER BY ts)),
    fold AS (SELECT user_id, night, i, rr_ms, rr_ms AS clean FROM b WHERE i = 1
             UNION ALL SELECT b.user_id, b.night, b.i, b.rr_ms, CASE WHEN b.m < 30 OR abs(b.rr_ms - f.clean) / f.clean < 0.2 THEN b.rr_ms ELSE f.clean END
             FROM fold f JOIN b ON b.user_id = f.user_id AND b.night = f.night AND b.i = f.i + 1)"""), digits=4)
def w24(spark, sf):
    return series.drop_ectopic(night_rows(spark, sf)).groupBy(*NIGHT).agg(
        F.count(F.lit(1)).alias("n_beats"), F.sum("rr_ms").alias("raw_sum"), F.sum("clean_ms").alias("clean_sum"),
        F.count(F.when(F.col("rr_ms") != F.col("clean_ms"), 1)).alias("replaced"),
    )


@query("w25_rank_nights", sql("""
    SELECT user_id, night, n_rows, row_number() OVER (PARTITION BY user_id ORDER BY n_rows DESC, night) AS rank
    FROM (SELECT user_id, night, count(*) AS n_rows FROM night GROUP BY 1, 2)""", "night"))
def w25(spark, sf):
    n = night_rows(spark, sf).groupBy(*NIGHT).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n_rows"), "night")))


