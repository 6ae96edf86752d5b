"""Spectral queries (SP1-SP5) and stress windows."""

from pyspark.sql import functions as F

import catalog.spectral_sql  # noqa: F401  registers the SQL pieces
from catalog.base import cte, query, sql
from catalog.window_queries import night_rows
from nocturne.operators import detection, positions, spectral
from nocturne.operators.nights import NIGHT
from nocturne.operators.window_stats import NIGHT_WIN

cte("sp_win", "sp_b sp_t", """
    SELECT k.user_id, k.night, k.win, k.start_ts, k.m, k.dur,
           CASE WHEN k.m >= 30 AND k.dur >= 15 THEN vlf END AS vlf, CASE WHEN k.m >= 30 AND k.dur >= 15 THEN lf END AS lf,
           CASE WHEN k.m >= 30 AND k.dur >= 15 THEN hf END AS hf
    FROM (SELECT user_id, night, CAST(pos // 60 AS INT) AS win, min(ts) AS start_ts, user_id || '/' || night || '/' || (pos // 60) AS g,
                 count(CASE WHEN rr > 200 AND rr < 2500 THEN 1 END) AS m, coalesce(any_value(d.dur), 0) AS dur
          FROM night LEFT JOIN (SELECT g, max(t) AS dur FROM sp_t GROUP BY g) d ON d.g = user_id || '/' || night || '/' || (pos // 60)
          WHERE (pos // 60) * 60 < n - 60 GROUP BY 1, 2, 3, 5) k
    LEFT JOIN sp_b b ON b.g = k.g""")
RATIO = "CASE WHEN hf IS NULL THEN 1.0 WHEN hf < 1e-10 THEN 5.0 ELSE lf / hf END"


def powers(spark, sf):
    cut = positions.tumbling(positions.with_position(night_rows(spark, sf)), 60)
    beats = spectral.beat_arrays(cut, NIGHT_WIN)
    return beats.withColumn("power", spectral.band_powers(F.col("rr_list"), 30))


@query("sp1_lf_hf", sql(f"SELECT user_id, night, win, {RATIO} AS lf_hf FROM sp_win", "sp_win", "lf_hf", digits=4), digits=4)
def sp1(spark, sf):
    return powers(spark, sf).select(*NIGHT_WIN, spectral.lf_hf(F.col("power")).alias("lf_hf"))


@query("sp2_band_powers", sql("""
    SELECT user_id, night, win, vlf, lf, hf, vlf + lf + hf AS total_power,
      CASE WHEN hf IS NULL THEN 33 ELSE hf / (vlf + lf + hf) * 100 END AS hf_pct, lf / (vlf + lf + hf) * 100 AS lf_pct FROM sp_win""",
    "sp_win", "vlf lf hf total_power hf_pct lf_pct", digits=4), digits=4)
def sp2(spark, sf):
    p = F.col("power")
    total = p["vlf"] + p["lf"] + p["hf"]
    return powers(spark, sf).select(
        *NIGHT_WIN, "power.vlf", "power.lf", "power.hf", total.alias("total_power"),
        spectral.hf_percent(p, with_vlf=True).alias("hf_pct"), (p["lf"] / total * 100).alias("lf_pct"),
    )


@query("sp3_respiratory_rate", sql("""
    SELECT n.user_id, n.night, CASE WHEN n.m < 60 OR n.dur < 30 THEN 14.0 ELSE p.peak * 60 END AS resp
    FROM (SELECT user_id, night, user_id || '/' || night AS g, count(CASE WHEN rr > 200 AND rr < 2500 THEN 1 END) AS m,
                 (sum(CASE WHEN rr > 200 AND rr < 2500 THEN rr END) - arg_min(rr, CASE WHEN rr > 200 AND rr < 2500 THEN ts END)) / 1000 AS dur
          FROM night GROUP BY 1, 2) n
    LEFT JOIN (SELECT g, arg_max(freq, p) AS peak FROM spn_p WHERE freq >= 0.15 AND freq <= 0.5 GROUP BY g) p ON p.g = n.g""",
    "spn_p", "resp", digits=4), digits=4)
def sp3(spark, sf):
    return spectral.respiratory_rate(night_rows(spark, sf))


@query("sp4_respiratory_rate_crossings", sql("""
    SELECT user_id, night, CASE WHEN count(*) < 60 THEN 14.0
      ELSE greatest(8.0, least(25.0, floor(sum(CASE WHEN d * pd < 0 THEN 1 ELSE 0 END) / 2.0 / (sum(rr) / 1000) * 60 * 10 + 0.5) / 10)) END AS resp
    FROM (SELECT *, lag(d) OVER (PARTITION BY user_id, night ORDER BY ts) AS pd FROM (
      SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, night ORDER BY ts) AS d FROM night WHERE rr > 200 AND rr < 2500))
    GROUP BY 1, 2""", "night", "resp"))
def sp4(spark, sf):
    return spectral.respiratory_rate_crossings(night_rows(spark, sf))


@query("sp5_breathing_irregularity", sql("""
    SELECT user_id, night, CASE WHEN count(*) > 4 THEN stddev_pop(d) ELSE 0 END AS breath_irreg
    FROM (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, night ORDER BY ts) AS d FROM night WHERE rr > 300 AND rr < 2000)
    GROUP BY 1, 2""", "night", "breath_irreg"))
def sp5(spark, sf):
    return spectral.breathing_irregularity(night_rows(spark, sf), NIGHT)


cte("stress_win", "sp_win", f"""
    SELECT user_id, night, win, start_ts, round_even({RATIO}, 2) AS stress,
           CASE WHEN {RATIO} < 1.5 THEN 'LOW' WHEN {RATIO} < 3.0 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM sp_win""")


@query("e4_stress_windows", sql("SELECT * FROM stress_win", "stress_win", "stress", digits=2), digits=2)
def e4(spark, sf):
    return detection.stress_windows(night_rows(spark, sf), 60)


@query("e4_stress_summary", sql("""
    SELECT user_id, night, round_even(avg(stress), 2) AS stress_avg,
           round_even(100.0 * sum(CASE WHEN level = 'HIGH' THEN 1 ELSE 0 END) / count(*), 1) AS stress_high_pct
    FROM stress_win GROUP BY 1, 2""", "stress_win", "stress_avg stress_high_pct", digits=1), digits=1)
def e4_summary(spark, sf):
    return detection.stress_summary(detection.stress_windows(night_rows(spark, sf), 60))
