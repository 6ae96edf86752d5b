"""Projections, predicates and windows of interest."""

from pyspark.sql import functions as F

from catalog.base import LOCAL_HOUR, query, sql
from nocturne.functions.scalars import movement, valid_hr, valid_rr
from nocturne.operators import nights, positions
from nocturne.sources.adapters import sensor


@query("p1_valid_heart_rate", sql("""
    SELECT user_id, count(CASE WHEN hr > 0 THEN 1 END) AS above_0,
           count(CASE WHEN hr > 30 THEN 1 END) AS above_30,
           count(CASE WHEN hr > 30 AND hr < 200 THEN 1 END) AS in_30_200,
           count(CASE WHEN hr > 30 AND hr < 220 THEN 1 END) AS in_30_220
    FROM sensor GROUP BY user_id""", "sensor"))
def p1(spark, sf):
    hr = F.col("hr")
    return sensor(spark, sf).groupBy("user_id").agg(
        F.count(valid_hr(hr, 0)).alias("above_0"),
        F.count(valid_hr(hr)).alias("above_30"),
        F.count(valid_hr(hr, 30, 200)).alias("in_30_200"),
        F.count(valid_hr(hr, 30, 220)).alias("in_30_220"),
    )


@query("p2_valid_beat_interval", sql("""
    SELECT user_id, count(CASE WHEN rr > 200 AND rr < 2500 THEN 1 END) AS wide,
           count(CASE WHEN rr > 300 AND rr < 2000 THEN 1 END) AS narrow,
           count(CASE WHEN rr > 200 AND rr < 2000 THEN 1 END) AS app
    FROM sensor GROUP BY user_id""", "sensor"))
def p2(spark, sf):
    rr = F.col("rr1_ms")
    return sensor(spark, sf).groupBy("user_id").agg(
        F.count(valid_rr(rr)).alias("wide"),
        F.count(valid_rr(rr, 300, 2000)).alias("narrow"),
        F.count(valid_rr(rr, 200, 2000)).alias("app"),
    )


@query("p3_movement", sql("""
    SELECT user_id, avg(mv) AS movement,
           avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) - 1.0E0) AS signed_movement
    FROM sensor GROUP BY user_id""", "sensor", "movement signed_movement"))
def p3(spark, sf):
    x, y, z = F.col("acc_x"), F.col("acc_y"), F.col("acc_z")
    return sensor(spark, sf).groupBy("user_id").agg(
        F.avg(movement(x, y, z)).alias("movement"),
        F.avg(movement(x, y, z, signed=True)).alias("signed_movement"),
    )


def _per_night(df):
    return df.groupBy("user_id", "night").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


_NIGHT_SQL = """SELECT user_id, night, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
    FROM {} GROUP BY user_id, night"""


@query("p4_evening_night", sql(_NIGHT_SQL.format("night"), "night"))
def p4(spark, sf):
    return _per_night(nights.with_night(sensor(spark, sf)))


@query("p5_calendar_night", sql(_NIGHT_SQL.format(
    f"(SELECT *, date AS night FROM day WHERE {LOCAL_HOUR} < 10 OR {LOCAL_HOUR} >= 22)"), "day"))
def p5(spark, sf):
    return _per_night(nights.with_night(sensor(spark, sf), "calendar"))


@query("p6_active_day", sql(f"""
    SELECT user_id, date, count(*) AS n_rows, min(ts) AS first_ts FROM day
    WHERE {LOCAL_HOUR} >= 6 GROUP BY user_id, date""", "day"))
def p6(spark, sf):
    return nights.active_day(sensor(spark, sf)).groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts")
    )


@query("p7_bounded_night", sql("""
    SELECT s.user_id, b.night, count(*) AS n_rows, min(s.ts) AS first_ts, max(s.ts) AS last_ts
    FROM sensor s JOIN (SELECT user_id, night, min(ts) + 3600 AS start_ts, max(ts) - 5400 AS end_ts
                        FROM night GROUP BY user_id, night) b
      ON s.user_id = b.user_id AND s.ts >= b.start_ts AND s.ts <= b.end_ts
    GROUP BY 1, 2""", "night"))
def p7(spark, sf):
    rows = sensor(spark, sf)
    bounds = nights.with_night(rows).groupBy("user_id", "night").agg(
        (F.min("timestamp") + 3600).alias("start_ts"), (F.max("timestamp") - 5400).alias("end_ts")
    )
    return _per_night(nights.bounded_nights(rows, bounds))


@query("p8_coverage_gate", sql("""
    SELECT user_id, night, count(*) AS n_rows FROM night WHERE year(CAST(night AS DATE)) BETWEEN 2024 AND 2026
    GROUP BY user_id, night HAVING count(*) >= 150""", "night"))
def p8(spark, sf):
    kept = nights.coverage_gate(nights.with_night(sensor(spark, sf)), nights.NIGHT, 150)
    kept = nights.year_gate(kept.withColumn("date", F.col("night")), 2024, 2026)
    return kept.groupBy("user_id", "night").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p9_thin_dense_nights", sql("""
    SELECT user_id, night, count(*) AS n_rows, sum(hr) AS hr_sum FROM (
      SELECT *, quantile_cont(CASE WHEN pos < 200 THEN gap END, 0.5) OVER (PARTITION BY user_id, night) AS med
      FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, night ORDER BY ts) AS gap FROM night10))
    WHERE NOT (n > 10 AND med < 12) OR pos % 2 = 0 GROUP BY 1, 2""", "night10"))
def p9(spark, sf):
    rows = nights.with_night(sensor(spark, sf, 10))
    return nights.thin_dense_nights(rows, below_s=12).groupBy("user_id", "night").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("hr").alias("hr_sum")
    )


@query("p10_display_downsample", sql("""
    SELECT d.user_id, d.date, d.ts AS timestamp, CAST(d.hr AS BIGINT) AS hr FROM dayp d
    WHERE d.n <= 50 OR EXISTS (SELECT 1 FROM range(50) k WHERE (k.range * d.n) // 50 = d.pos)""", "dayp"))
def p10(spark, sf):
    rows = nights.with_date(sensor(spark, sf))
    return positions.downsample(rows, nights.DAY, 50).select("user_id", "date", "timestamp", "hr")


@query("p11_chart_chunks", sql("""
    SELECT user_id, date, pos // 30 AS win, min(ts) AS start_ts,
           coalesce(avg(CASE WHEN hr > 30 THEN hr END), 0) AS hr, avg(mv) AS movement,
           avg(spo2) AS spo2, avg(rr) AS rr_ms, arg_min(acc_x, ts) AS acc_x
    FROM dayp GROUP BY 1, 2, 3""", "dayp", "hr movement spo2 rr_ms acc_x"))
def p11(spark, sf):
    rows = nights.with_date(sensor(spark, sf))
    return positions.chunk_means(rows, nights.DAY, 30, 30)


@query("p12_trimmed_night", sql(_NIGHT_SQL.format(
    f"(SELECT *, date AS night FROM day WHERE {LOCAL_HOUR} < 11)"), "day"))
def p12(spark, sf):
    return _per_night(nights.with_night(sensor(spark, sf), "trimmed"))
