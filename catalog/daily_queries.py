"""Scores (SC1-SC19), joins (J1-J17), trends (A27-A37, A50-A52) and table idioms (K1-K8)."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.aggregate_queries import LOAD, day_rows, doubled
from catalog.base import cte, query, sql
from catalog.window_queries import night_rows, window_frame
from nocturne.functions.scalars import digits_number, strain_band, to_number
from nocturne.operators import aggregates, joins, nights, positions, scores, series, trends
from nocturne.operators.nights import DAY, NIGHT
from nocturne.operators.window_stats import NIGHT_WIN
from nocturne.sources.adapters import daily_scores, event_seconds, official_scores, sensor, table

SIG = "100.0E0 / (1 + exp(-{s} * ({r} - {c})))"
CLAMP = "greatest(0.0E0, least(100.0E0, {}))"
WHOLE = "greatest(0.0E0, least(100.0E0, round_even({}, 0)))"

# ---------------------------------------------------------------------- scores

_REC1 = WHOLE.format(
    f"0.60E0 * {SIG.format(s='4.0E0', r='hrv / hb', c='0.85E0')} + 0.25E0 * {CLAMP.format('50 + (rb - rhr) * 8')} + 0.15E0 * sleep - greatest(0, (resp - 16) * 5)"
)
_REC2 = WHOLE.format(
    f"0.09E0 * {SIG.format(s='11.6E0', r='hrv / hb', c='1.107E0')} + 0.43E0 * {CLAMP.format('50 + (rb - rhr) * 8.1E0')} + 0.33E0 * least(100, sleep) + 0.14E0 * (100 - greatest(0, (resp - 16) * 3))"
)
_B = "(SELECT *, 90.0E0 AS hb, 55.0E0 AS rb FROM daily)"


@query("sc1_recovery_custom", sql(f"SELECT user_id, date, {_REC1} AS recovery FROM {_B}", "daily", "recovery"))
def sc1(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", scores.recovery_custom().alias("recovery"))


@query("sc2_recovery_calibrated", sql(f"SELECT user_id, date, {_REC2} AS recovery FROM {_B}", "daily", "recovery"))
def sc2(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", scores.recovery_calibrated().alias("recovery"))


_ENGINE = f"""
    SELECT user_id, date, round_even(raw, 0) AS recovery, CASE WHEN raw >= 67 THEN 'green' WHEN raw >= 34 THEN 'yellow' ELSE 'red' END AS zone,
      round_even(hp, 1) AS hrv_part, round_even(rp, 1) AS rhr_part, round_even(sp, 1) AS sleep_part, round_even(pen, 1) AS resp_penalty FROM (
      SELECT *, {CLAMP.format('0.60E0 * hp + 0.25E0 * rp + 0.15E0 * sp - pen')} AS raw FROM (
        SELECT *, {SIG.format(s='4.0E0', r='hrv / hb', c='1.0E0')} AS hp, {CLAMP.format('50 + (rb - rhr) * 8')} AS rp, least(100, efficiency) AS sp,
          CASE WHEN resp > 18 THEN (resp - 18) * 5.0E0 WHEN resp < 10 THEN (10 - resp) * 5.0E0 ELSE 0.0E0 END AS pen FROM (
          SELECT *, avg(hrv) OVER w AS hb, avg(rhr) OVER w AS rb FROM daily
          WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))))"""
cte("engine", "daily", _ENGINE)


def engine(spark, sf):
    d = daily_scores(spark, sf).withColumns(
        {"hrv_base": series.last_mean("hrv"), "rhr_base": series.last_mean("rhr", default=55.0)}
    )
    return d.select("user_id", "date", *[c.alias(n) for n, c in scores.recovery_engine().items()])


@query("sc3_recovery_engine", sql("SELECT * FROM engine", "engine", "recovery hrv_part rhr_part sleep_part resp_penalty", digits=0), digits=0)
def sc3(spark, sf):
    return engine(spark, sf)


@query("sc4_recovery_simple", sql("""
    SELECT user_id, date, greatest(0, least(100, floor(least(100, hrv / 1.5) * 0.6E0 + greatest(0, 100 - (rhr - 40) * 3) * 0.4E0))) AS recovery FROM daily""",
    "daily", "recovery"))
def sc4(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", scores.recovery_simple("hrv").alias("recovery"))


@query("sc5_sleep_score_custom", sql(f"""
    SELECT user_id, night, {WHOLE.format('0.40E0 * least(100, sleep_min / 480 * 100) + 0.30E0 * least(100, efficiency) + 0.20E0 * least(100, (deep_pct + rem_pct) * 2.5E0) + 0.10E0 * greatest(0, 100 - awake_pct * 5)')} AS sleep_score
    FROM stage_sum""", "stage_sum", "sleep_score"))
def sc5(spark, sf):
    from catalog.stage_queries import a23

    return a23(spark, sf).select(*NIGHT, scores.sleep_score_custom().alias("sleep_score"))


@query("sc6_sleep_score_calibrated", sql(f"""
    SELECT user_id, night, {WHOLE.format('0.23E0 * least(100, sleep_min / 480 * 100) + 0.34E0 * 41.5E0 + 0.26E0 * least(100, efficiency) + 0.18E0 * greatest(0, 100 - awake_pct * 5)')} AS sleep_score
    FROM stage_sum""", "stage_sum", "sleep_score"))
def sc6(spark, sf):
    from catalog.stage_queries import a23

    return a23(spark, sf).select(*NIGHT, scores.sleep_score_calibrated().alias("sleep_score"))


@query("sc7_sleep_score_engine", sql("""
    SELECT user_id, date, round_even(greatest(0, least(100, 0.4E0 * h + 0.3E0 * e + 0.3E0 * c)), 0) AS sleep_score, round_even(h, 1) AS hours_part,
           round_even(e, 1) AS efficiency_part, round_even(c, 1) AS consistency_part
    FROM (SELECT *, least(100, sleep_hours / 7.5E0 * 100) AS h, least(100, efficiency) AS e,
                 greatest(30, 100 - abs(m - CASE WHEN m > 720 THEN 1440 ELSE 0 END + 90) * 0.5E0) AS c
          FROM (SELECT *, (n_events * 97 + CAST(sleep AS INT) * 13) % 1440 AS m FROM daily))""", "daily", "sleep_score hours_part efficiency_part consistency_part", digits=0), digits=0)
def sc7(spark, sf):
    onset = (F.col("n_events") * 97 + F.col("sleep").cast("int") * 13) % 1440
    d = daily_scores(spark, sf).withColumn("onset_minute", onset)
    return d.select("user_id", "date", *[c.alias(n) for n, c in scores.sleep_score_engine().items()])


_STRAIN = "CASE WHEN {l} <= 0 THEN 0 ELSE least(21.0, round_even({k} * ln(1 + {l} / {c}), 1)) END"


@query("sc8_strain", sql(f"SELECT user_id, date, {_STRAIN.format(l='zone_load', k='5.5', c='15.0')} AS strain FROM zone_load", "zone_load", "strain"))
def sc8(spark, sf):
    load = aggregates.zone_load(day_rows(spark, sf), DAY, 100)
    return load.select("user_id", "date", scores.strain().alias("strain"))


@query("sc9_strain_calibrated", sql(f"""
    SELECT user_id, date, {_STRAIN.format(l='l', k='2.32', c='6.3')} AS strain FROM (
      SELECT *, zone_load * CASE WHEN n_valid * 1.0 / n_rows > 0.1 THEN least(3.0, 1.0 / (n_valid * 1.0E0 / n_rows)) ELSE 1 END AS l FROM absolute)""", "absolute", "strain"))
def sc9(spark, sf):
    load = aggregates.absolute_zone_load(doubled(day_rows(spark, sf)))
    return load.select("user_id", "date", scores.strain_calibrated().alias("strain"))


@query("sc10_sleep_need", sql("""
    SELECT user_id, date, round_even(7.5E0 + greatest(0, (strain - 10) * 0.1E0) + (8 - sleep_hours) * 0.2E0, 2) AS need FROM daily""", "daily", "need", digits=2), digits=2)
def sc10(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", scores.sleep_need(debt=8 - F.col("sleep_hours")).alias("need"))


@query("sc11_calories", sql(f"""
    SELECT user_id, date, 75.0 * n_hr30 / 3600 + 0.15 * ({LOAD}) + zone_high / 60.0 * 2 AS kcal FROM (
      SELECT z.*, n_hr30, zone_high FROM zone_load z JOIN (SELECT user_id, date, count(CASE WHEN hr > 30 THEN 1 END) AS n_hr30, count(CASE WHEN hr > 80 THEN 1 END) AS zone_high FROM day GROUP BY 1, 2) c
      ON c.user_id = z.user_id AND c.date = z.date)""", "zone_load", "kcal"))
def sc11(spark, sf):
    hr = F.col("hr")
    d = day_rows(spark, sf).groupBy(*DAY).agg(
        aggregates.zone_load_column(100).alias("zone_load"), F.count(F.when(hr > 30, 1)).alias("n_hr30"),
        F.count(F.when((hr > 30) & (hr > 80), 1)).alias("n_high"),
    )
    return d.select("user_id", "date", scores.calories().alias("kcal"))


@query("sc12_vo2max", sql("""
    SELECT d.user_id, d.date, CASE WHEN nv >= 100 AND rhr >= 30 THEN round_even(greatest(20, least(70, 15.3E0 * p99 / rhr * CASE WHEN p99 - rhr < 40 THEN 0.85E0 ELSE 1 END)), 1) END AS vo2max
    FROM (SELECT user_id, date, count(CASE WHEN hr > 30 THEN 1 END) AS nv, quantile_cont(CASE WHEN hr > 30 THEN hr END, 0.99) AS p99 FROM day GROUP BY 1, 2) d
    JOIN rest_day r ON r.user_id = d.user_id AND r.date = d.date""", "rest_day", "vo2max", digits=1), digits=1)
def sc12(spark, sf):
    v = series.resting_hr_columns(day_rows(spark, sf), DAY, 30, 3)
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    d = v.groupBy(*DAY).agg(
        F.count(hr).alias("n_hr30"), F.percentile(hr, F.lit(0.99)).alias("hr_p99"), series.resting_hr_of(30).alias("rhr")
    )
    return d.select("user_id", "date", scores.vo2max().alias("vo2max"))


@query("sc13_strain_coach", sql("""
    SELECT user_id, date, CASE WHEN recovery >= 67 THEN 'green' WHEN recovery >= 34 THEN 'yellow' ELSE 'red' END AS zone,
      CASE WHEN recovery >= 67 THEN 14 WHEN recovery >= 34 THEN 8 ELSE 0 END AS target_min, CASE WHEN recovery >= 67 THEN 18 WHEN recovery >= 34 THEN 14 ELSE 8 END AS target_max,
      CASE WHEN recovery >= 67 THEN 'push' WHEN recovery >= 34 THEN 'moderate' ELSE 'rest' END AS advice
    FROM daily""", "daily"))
def sc13(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", *[c.alias(n) for n, c in scores.strain_target().items()])


@query("sc13_sleep_coach", sql("""
    SELECT user_id, date, printf('%02d:%02d', b // 60, b % 60) AS bedtime,
      CAST(greatest(floor(debt * 60 + 0.5), 0) AS BIGINT) AS debt_minutes
    FROM (SELECT *, (m - CAST(floor(sleep_hours * 60 + 0.5) AS INT) - 15 + 1440) % 1440 AS b, (v - 100) / 4.0 AS debt
          FROM (SELECT *, CAST(300 + recovery * 3 AS INT) AS m, CAST(efficiency AS INT) AS v FROM daily))""", "daily"))
def sc13_sleep(spark, sf):
    d = daily_scores(spark, sf)
    return d.select(
        "user_id", "date", scores.bedtime("sleep_hours", (300 + F.col("recovery") * 3).cast("int")).alias("bedtime"),
        scores.sleep_debt_minutes((F.col("efficiency") - 100) / 4).alias("debt_minutes"),
    )


cte("recovery7", "daily", """
    SELECT user_id, avg(recovery) AS avg_recovery, count(*) AS days, count(CASE WHEN recovery >= 67 THEN 1 END) AS green_days,
      count(CASE WHEN recovery >= 34 AND recovery < 67 THEN 1 END) AS yellow_days, count(CASE WHEN recovery < 34 THEN 1 END) AS red_days, CAST(sum(still) AS BIGINT) AS streak
    FROM (SELECT *, min(CASE WHEN recovery >= 67 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY date DESC) AS still FROM (
      SELECT *, max(CAST(date AS DATE)) OVER (PARTITION BY user_id) AS newest FROM daily) WHERE CAST(date AS DATE) > newest - 7) GROUP BY 1""")


@query("sc14_insights", sql("""
    SELECT user_id, insight, value FROM (
      SELECT user_id, 'high_hrv' AS insight, rmssd AS value FROM s WHERE rmssd > 60 UNION ALL SELECT user_id, 'low_hrv', rmssd FROM s WHERE rmssd > 0 AND rmssd < 30
      UNION ALL SELECT user_id, 'green_streak', streak FROM s WHERE streak >= 3 UNION ALL SELECT user_id, 'recovery_deficit', red_days FROM s WHERE red_days > green_days AND days >= 5
      UNION ALL SELECT user_id, 'weekly_average', floor(avg_recovery + 0.5) FROM s WHERE avg_recovery > 0
      UNION ALL SELECT user_id, 'more_data', NULL FROM s WHERE NOT (rmssd > 60 OR (rmssd > 0 AND rmssd < 30) OR streak >= 3 OR (red_days > green_days AND days >= 5) OR avg_recovery > 0))""",
    "recovery7", extra="s AS (SELECT r.*, m.rmssd FROM recovery7 r JOIN (SELECT user_id, avg(hrv) AS rmssd FROM daily GROUP BY 1) m ON m.user_id = r.user_id)", doubles="value"))
def sc14(spark, sf):
    d = daily_scores(spark, sf)
    summary = trends.recovery_analysis(d).join(d.groupBy("user_id").agg(F.avg("hrv").alias("rmssd")), "user_id")
    return scores.insights(summary)


@query("sc14_stress_recovery", sql("""
    SELECT user_id, date, CASE WHEN sleep > 66 AND recovery < 50 THEN 'high_stress_low_recovery'
      WHEN sleep < 34 AND recovery > 66 THEN 'low_stress_high_recovery' ELSE 'watch' END AS insight FROM daily""", "daily"))
def sc14_stress(spark, sf):
    return daily_scores(spark, sf).select("user_id", "date", scores.stress_recovery_insight("sleep").alias("insight"))


@query("sc15_weather_advice", sql("""
    SELECT o_orderkey, CASE WHEN t < 5 THEN 'cold' WHEN t > 30 THEN 'hot' WHEN k BETWEEN 61 AND 67 THEN 'rain'
      WHEN k BETWEEN 71 AND 77 THEN 'snow' WHEN w > 40 THEN 'wind' ELSE 'none' END AS advice
    FROM (SELECT o_orderkey, o_custkey % 40 AS t, o_orderkey % 100 AS k, o_custkey % 60 AS w FROM orders)"""))
def sc15(spark, sf):
    o = table(spark, sf, "orders")
    weather = o.select(
        "o_orderkey", (F.col("o_custkey") % 40).alias("temperature"), (F.col("o_orderkey") % 100).alias("weather_code"),
        (F.col("o_custkey") % 60).alias("wind_kmh"),
    )
    return weather.select("o_orderkey", scores.weather_advice().alias("advice"))


@query("sc16_app_day", sql(f"""
    SELECT c.user_id, c.date, c.rhr, CASE WHEN c.n_sleep = 0 THEN 14.0 ELSE coalesce(p.resp, 14.0) END AS resp, {_STRAIN.format(l='load', k='2.32', c='6.3')} AS strain
    FROM (SELECT d.user_id, d.date, d.n_sleep, d.rhr, a.zone_load * CASE WHEN a.n_valid * 1.0 / a.n_rows > 0.1 THEN least(3.0, 1.0 / (a.n_valid * 1.0E0 / a.n_rows)) ELSE 1 END AS load
      FROM (SELECT user_id, date, count(CASE WHEN z THEN 1 END) AS n_sleep, CASE WHEN count(h) < 100 THEN coalesce(quantile_cont(h, 0.5), 55)
              ELSE floor((list_sort(list(h) FILTER (h IS NOT NULL))[CAST(floor(count(h) * 0.25) AS INT) + 1] + quantile_cont(h, 0.5)) / 2 * 10 + 0.5) / 10 END AS rhr
            FROM (SELECT *, ((ts + 3600) % 86400) // 3600 < 10 OR ((ts + 3600) % 86400) // 3600 >= 22 AS z,
                    CASE WHEN (((ts + 3600) % 86400) // 3600 < 10 OR ((ts + 3600) % 86400) // 3600 >= 22) AND hr > 30 THEN hr END AS h FROM day) GROUP BY 1, 2) d
      JOIN absolute1 a ON a.user_id = d.user_id AND a.date = d.date) c
    LEFT JOIN (SELECT user_id, date, CASE WHEN count(*) < 60 THEN 14.0 ELSE greatest(8.0, least(25.0, floor(sum(CASE WHEN d * pd < 0 THEN 1 ELSE 0 END) / 2.0 / (sum(rr) / 1000) * 60 * 10 + 0.5) / 10)) END AS resp
      FROM (SELECT *, lag(d) OVER (PARTITION BY user_id, date ORDER BY ts) AS pd FROM (
        SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, date ORDER BY ts) AS d FROM day
        WHERE rr > 200 AND rr < 2500 AND (((ts + 3600) % 86400) // 3600 < 10 OR ((ts + 3600) % 86400) // 3600 >= 22))) GROUP BY 1, 2) p
    ON p.user_id = c.user_id AND p.date = c.date""", "day", "rhr resp strain", extra="""
    absolute1 AS (SELECT *, zone1 + zone2 * 2.5 AS zone_load FROM (SELECT user_id, date, count(CASE WHEN hr BETWEEN 109 AND 135 THEN 1 END) / 60.0 AS zone1,
      count(CASE WHEN hr BETWEEN 136 AND 149 THEN 1 END) / 60.0 AS zone2, count(CASE WHEN hr > 30 THEN 1 END) AS n_valid, count(*) AS n_rows FROM day GROUP BY 1, 2))"""))
def sc16_app(spark, sf):
    from nocturne.plans.day import app_day

    return app_day(sensor(spark, sf), min_beats=100).select("user_id", "date", "rhr", "resp", "strain")


@query("sc17_forward_scores", sql(f"""
    SELECT user_id, date, {_REC1} AS recovery FROM (SELECT d.*, h.ema AS hb, r.ema AS rb FROM daily d
      JOIN ema_h h ON h.user_id = d.user_id AND h.date = d.date JOIN ema_r r ON r.user_id = d.user_id AND r.date = d.date)""", "daily", "recovery", recursive=True, extra="""
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM daily),
    ema_h AS (SELECT user_id, date, i, hrv AS ema FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.date, d.i, 0.1 * d.hrv + 0.9 * e.ema FROM ema_h e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1),
    ema_r AS (SELECT user_id, date, i, rhr AS ema FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.date, d.i, 0.1 * d.rhr + 0.9 * e.ema FROM ema_r e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1)"""))
def sc17(spark, sf):
    from nocturne.plans.day import forward_scores

    return forward_scores(daily_scores(spark, sf)).select("user_id", "date", "recovery")


@query("sc18_hydration", sql("""
    SELECT user_id, date, timestamp, CAST(run - least(0, low) AS BIGINT) AS intake_ml, least(1.5, (run - least(0, low)) / 2500) AS progress,
           CAST((run - least(0, low)) // 250 AS BIGINT) AS glasses_total, CASE WHEN run - least(0, low) >= 2500 THEN 1 ELSE 0 END AS goal_reached
    FROM (SELECT *, min(run) OVER (PARTITION BY user_id, date ORDER BY timestamp) AS low FROM (
      SELECT *, sum(g * 250) OVER (PARTITION BY user_id, date ORDER BY timestamp) AS run FROM (
        SELECT user_id, strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INT), '%Y-%m-%d') AS date, ts AS timestamp,
               CASE WHEN event_type = 'error' THEN -1 ELSE 1 + event_id % 4 END AS g FROM event_seconds)))""", "event_seconds", "progress"))
def sc18(spark, sf):
    e = event_seconds(spark, sf).withColumns(
        {
            "date": F.to_date(F.timestamp_seconds("timestamp")),
            "glasses": F.when(F.col("event_type") == "error", -1).otherwise(1 + F.col("event_id") % 4),
        }
    )
    return scores.hydration(e)


cte("tracked", "event_seconds", """
    SELECT user_id, ts AS start_ts, end_ts, sport_id, state, end_ts - ts AS elapsed_s FROM (
      SELECT *, CASE WHEN end_ts IS NULL THEN 'active' ELSE 'ended' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM (
        SELECT *, lag(action) OVER w AS prev, min(CASE WHEN action = 'end' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ts
        FROM (SELECT user_id, ts, CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN 'start' ELSE 'end' END AS action, event_id % 10 AS sport_id FROM event_seconds)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE action = 'start' AND coalesce(prev <> 'start', true)) WHERE r <= 50""")


def tracked(spark, sf):
    action = F.when(F.col("event_type").isin("signup", "view", "purchase"), "start").otherwise("end")
    e = event_seconds(spark, sf).select(
        "user_id", "timestamp", action.alias("action"), (F.col("event_id") % 10).alias("sport_id")
    )
    return scores.tracked_activities(e)


@query("sc19_tracked_activities", sql("SELECT * FROM tracked", "tracked"))
def sc19(spark, sf):
    return tracked(spark, sf)


# ----------------------------------------------------------------------- joins

_PAIRS = """SELECT d.user_id, d.date, d.recovery, d.sleep, d.strain, o.recovery AS official_recovery, o.sleep AS official_sleep, o.strain AS official_strain
    FROM daily d {} JOIN official o ON o.user_id = d.user_id AND o.date = d.date"""
PAIRS = "recovery sleep strain official_recovery official_sleep official_strain"


def pairs(spark, sf, how="inner"):
    d = daily_scores(spark, sf).select("user_id", "date", "recovery", "sleep", "strain")
    o = official_scores(spark, sf).select("user_id", "date", "recovery", "sleep", "strain")
    return joins.with_official(d, o, DAY, how)


@query("j1_own_with_official", sql(_PAIRS.format("INNER"), "official", PAIRS))
def j1(spark, sf):
    return pairs(spark, sf)


@query("j2_optional_cycles", sql(_PAIRS.format("LEFT"), "official", PAIRS))
def j2(spark, sf):
    return pairs(spark, sf, "left")


_INTERVALS = "SELECT user_id, night, label AS stage, min(ts) AS ls, max(ts) + 299 AS le FROM {} GROUP BY user_id, night, run, label"
cte("labels_iv", "night", _INTERVALS.format("""(
    SELECT *, sum(c) OVER (PARTITION BY user_id, night ORDER BY ts) AS run FROM (
      SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY user_id, night ORDER BY ts) THEN 0 ELSE 1 END AS c FROM night))"""))


def label_intervals(spark, sf):
    rows = night_rows(spark, sf).withColumn("win", F.col("timestamp"))
    marked = series.islands(rows, "label")
    return marked.groupBy(*NIGHT, "run", F.col("label").alias("stage")).agg(
        F.min("timestamp").alias("start_ts"), (F.max("timestamp") + 299).alias("end_ts")
    )


@query("j3_interval_majority", sql("""
    SELECT user_id, night, win, arg_min(stage, r) AS stage FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, night, win ORDER BY secs DESC, first) AS r FROM (
        SELECT w.user_id, w.night, w.win, l.stage, sum(least(w.last_ts + 299, l.le) - greatest(w.start_ts, l.ls) + 1) AS secs, min(greatest(w.start_ts, l.ls)) AS first
        FROM w_st w JOIN labels_iv l ON l.user_id = w.user_id AND l.night = w.night AND w.start_ts <= l.le AND l.ls <= w.last_ts + 299 GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3""", "w_st labels_iv"))
def j3(spark, sf):
    w = window_frame(spark, sf).select(*NIGHT_WIN, "start_ts", (F.col("last_ts") + 299).alias("end_ts"))
    return joins.label_windows(w, label_intervals(spark, sf))


@query("j4_minute_labels", sql("""
    SELECT s.user_id, s.night, s.clock, minute_ts, n_rows, stage FROM (
      SELECT user_id, night, ((ts + 3600) % 86400) // 60 AS clock, min(ts - ts % 60) AS minute_ts, count(*) AS n_rows FROM night60 GROUP BY 1, 2, 3) s
    JOIN (SELECT user_id, night, ((ts + 3600) % 86400) // 60 AS clock, max(label) AS stage FROM night60 WHERE label > 0 GROUP BY 1, 2, 3) l
      ON l.user_id = s.user_id AND l.night = s.night AND l.clock = s.clock""", "night60"))
def j4(spark, sf):
    rows = night_rows(spark, sf, 60)
    minute = nights.local_minute(F.col("timestamp"))
    lab = rows.where("label > 0").withColumn("clock", minute).groupBy(*NIGHT, "clock").agg(F.max("label").alias("stage"))
    return joins.label_minutes(rows, lab, minute)


@query("j5_neighbourhood_labels", sql("""
    SELECT user_id, night, win, arg_min(stage, r) AS stage FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, night, win ORDER BY c DESC, f) AS r FROM (
        SELECT w.user_id, w.night, w.win, m.label AS stage, count(*) AS c, min(m.ts // 60 - w.mid_ts // 60) AS f
        FROM w_st60 w JOIN night60 m ON m.user_id = w.user_id AND m.night = w.night AND m.ts // 60 BETWEEN w.mid_ts // 60 - 5 AND w.mid_ts // 60 + 4 GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3""",
    "night60", extra="w_st60 AS (SELECT user_id, night, CAST(pos // 20 AS INT) AS win, max(CASE WHEN pos % 20 = 10 THEN ts END) AS mid_ts FROM night60 WHERE (pos // 20) * 20 < n - 20 GROUP BY 1, 2, 3)"))
def j5(spark, sf):
    rows = night_rows(spark, sf, 60)
    minute = F.floor(F.col("timestamp") / 60)
    cut = positions.tumbling(positions.with_position(rows), 20)
    centres = cut.where(F.col("pos") % 20 == 10).select(*NIGHT_WIN, minute.alias("minute"))
    return joins.label_neighbourhood(centres, rows.select(*NIGHT, minute.alias("minute"), F.col("label").alias("stage")))


def minute_stage_pairs(spark, sf):
    rows = night_rows(spark, sf, 60).withColumn("minute", F.floor(F.col("timestamp") / 60))
    a = rows.select(*NIGHT, "minute", F.col("label").alias("stage"))
    b = rows.where("hr > 50").select(*NIGHT, "minute", (F.col("hr") % 4).alias("stage"))
    return a, b


@query("j6_daily_heart_rate", sql("""
    SELECT d.user_id, d.date, d.avg_hr AS own_hr, o.avg_hr AS official_hr, round_even(d.avg_hr - o.avg_hr, 1) AS diff, CASE WHEN abs(round_even(d.avg_hr - o.avg_hr, 1)) < 5 THEN 1 ELSE 0 END AS close
    FROM daily_hr d JOIN (SELECT user_id, date, CAST(max(hr) - 20 AS DOUBLE) AS avg_hr FROM (SELECT *, strftime(DATE '1970-01-01' + CAST(ts // 86400 AS INT), '%Y-%m-%d') AS date FROM sensor) WHERE hr > 30 AND spo2 > 94 GROUP BY 1, 2) o
      ON o.user_id = d.user_id AND o.date = d.date""", "daily_hr", "own_hr official_hr diff", digits=1), digits=1)
def j6(spark, sf):
    rows = sensor(spark, sf)
    official = rows.where("hr > 30 and spo2 > 94").groupBy(
        "user_id", F.to_date(F.timestamp_seconds("timestamp")).alias("date")
    ).agg((F.max("hr") - 20).cast("double").alias("avg_hr"))
    return joins.compare_daily_hr(aggregates.daily_mean_hr(rows), official)


@query("j7_days_without_official", sql("SELECT user_id, date, recovery FROM daily d WHERE NOT EXISTS (SELECT 1 FROM official o WHERE o.user_id = d.user_id AND o.date = d.date)", "official", "recovery"))
def j7(spark, sf):
    return joins.days_without_official(daily_scores(spark, sf), official_scores(spark, sf), DAY).select("user_id", "date", "recovery")


@query("j8_official_days_with_data", sql("""
    SELECT user_id, date, arg_max(recovery, (k, recovery)) AS recovery FROM (SELECT user_id, date, recovery, 1 AS k FROM official UNION ALL SELECT user_id, date, sleep, 2 FROM official) o
    WHERE EXISTS (SELECT 1 FROM daily d WHERE d.user_id = o.user_id AND d.date = o.date AND d.has_purchase = 1) GROUP BY 1, 2""", "official", "recovery"))
def j8(spark, sf):
    o = official_scores(spark, sf)
    twice = o.select("user_id", "date", "recovery", F.lit(1).alias("k")).unionByName(
        o.select("user_id", "date", F.col("sleep").alias("recovery"), F.lit(2).alias("k")))
    own = daily_scores(spark, sf).where("has_purchase = 1")
    return joins.official_with_data(twice, own, DAY, "k").select("user_id", "date", "recovery")


@query("j9_hypnogram_agreement", sql("""
    SELECT user_id, night, count(*) AS minutes, round_even(100.0 * count(CASE WHEN label = hr % 4 THEN 1 END) / count(*), 1) AS agreement FROM night60 WHERE hr > 50 GROUP BY 1, 2""", "night60", "agreement"))
def j9(spark, sf):
    return joins.hypnogram_agreement(*minute_stage_pairs(spark, sf))


@query("j10_next_day_pairs", sql("""
    SELECT user_id, date, sleep_hours, strain, lead(recovery) OVER (PARTITION BY user_id ORDER BY date) AS next_recovery FROM daily""", "daily", "sleep_hours strain next_recovery"))
def j10(spark, sf):
    d = daily_scores(spark, sf).select("user_id", "date", "sleep_hours", "strain", "recovery")
    return joins.next_day(d, ["recovery"]).drop("recovery")


@query("j11_epochs_to_windows", sql("""
    SELECT user_id, night, win, arg_min(stage, r) AS stage FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, night, win ORDER BY c DESC, f) AS r FROM (
        SELECT e.user_id, e.night, CAST(e.pos // 20 AS INT) AS win, e.label AS stage, count(*) AS c, min(ts) AS f FROM night e WHERE (pos // 20) * 20 < n - 20 GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3""", "night"))
def j11(spark, sf):
    rows = night_rows(spark, sf)
    epochs = rows.select(*NIGHT, F.floor(F.col("timestamp") / 300).alias("epoch"), F.col("label").alias("stage"))
    w = window_frame(spark, sf).select(*NIGHT_WIN, "start_ts", (F.col("last_ts") + 300).alias("end_ts"))
    return joins.epochs_to_windows(w, epochs, 300)


BEHAVIOURS = "['Caffeine', 'Alcohol', 'Nap', 'Yoga', 'Late Meal']"
cte("journal", "daily", f"""
    SELECT user_id, date, unnest(list_distinct([{BEHAVIOURS}[CAST(1 + CAST(sleep AS INT) % 5 AS INT)], {BEHAVIOURS}[CAST(1 + n_events % 5 AS INT)]])) AS behaviour, recovery FROM daily""")


def journal(spark, sf):
    names = F.array(*[F.lit(b) for b in ("Caffeine", "Alcohol", "Nap", "Yoga", "Late Meal")])
    d = daily_scores(spark, sf)
    return d.select(
        "user_id", "date",
        F.array(
            F.element_at(names, (1 + F.col("sleep").cast("int") % 5).cast("int")),
            F.element_at(names, (1 + F.col("n_events") % 5).cast("int")),
        ).alias("behaviours"),
    )


_IMPACT = """
    SELECT user_id, behaviour, avg_with, avg_without, avg_with - avg_without AS diff, row_number() OVER (PARTITION BY user_id ORDER BY round_even(abs(avg_with - avg_without), 9) DESC, behaviour) AS rank
    FROM (SELECT j.user_id, behaviour, avg(j.recovery) AS avg_with, (any_value(t.s) - sum(j.recovery)) / (any_value(t.n) - count(*)) AS avg_without
      FROM journal j JOIN (SELECT user_id, sum(recovery) AS s, count(*) AS n FROM daily GROUP BY 1) t ON t.user_id = j.user_id GROUP BY 1, 2
      HAVING count(*) >= 3 AND any_value(t.n) - count(*) >= 3)"""


@query("j12_behaviours_by_day", sql("SELECT user_id, behaviour, count(*) AS n_days, avg(recovery) AS avg_recovery FROM journal GROUP BY 1, 2", "journal", "avg_recovery"))
def j12(spark, sf):
    days = journal(spark, sf).join(daily_scores(spark, sf).select("user_id", "date", "recovery"), DAY)
    used = days.select("user_id", "recovery", F.explode(F.array_distinct("behaviours")).alias("behaviour"))
    return used.groupBy("user_id", "behaviour").agg(F.count(F.lit(1)).alias("n_days"), F.avg("recovery").alias("avg_recovery"))


@query("a37_behaviour_impact", sql(_IMPACT, "journal", "avg_with avg_without diff"))
def a37(spark, sf):
    return trends.behaviour_impact(journal(spark, sf), daily_scores(spark, sf))


@query("j13_burst_response", sql("""
    SELECT user_id, night, win, coalesce(avg(CASE WHEN gyro > lim THEN rise END), 0) AS hr_rise, count(CASE WHEN gyro > lim THEN 1 END) AS bursts FROM (
      SELECT *, avg(gyro) OVER g + 1 * 2 * stddev_pop(gyro) OVER g AS lim, CASE WHEN count(CASE WHEN hr > 30 THEN 1 END) OVER f > 2
        THEN max(CASE WHEN hr > 30 THEN hr END) OVER f - min(CASE WHEN hr > 30 THEN hr END) OVER f END AS rise
      FROM w60_a WINDOW g AS (PARTITION BY user_id, night, win), f AS (PARTITION BY user_id, night, win ORDER BY ts ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) GROUP BY 1, 2, 3""", "w60_a", "hr_rise"))
def j13(spark, sf):
    cut = positions.tumbling(positions.with_position(night_rows(spark, sf)), 60)
    return joins.burst_response(cut, NIGHT_WIN)


_GRID = [{"awake_hr": float(h), "rem_std": float(s)} for h in (60, 65, 70, 75) for s in (13, 15)]


@query("j14_parameter_sweep", sql("""
    SELECT awake_hr, rem_std, count(*) AS n, avg(CASE WHEN (CASE WHEN hr_mean > awake_hr THEN 0 WHEN hr_std > rem_std THEN 3 ELSE 1 END) = label THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM w_st s JOIN wl l ON l.user_id = s.user_id AND l.night = s.night AND l.win = s.win,
         (SELECT CAST(unnest([60, 65, 70, 75]) AS DOUBLE) AS awake_hr) a, (SELECT CAST(unnest([13, 15]) AS DOUBLE) AS rem_std) b GROUP BY 1, 2""", "w_st wl", "accuracy"))
def j14(spark, sf):
    swept = joins.sweep(window_frame(spark, sf).select("hr_mean", "hr_std", "label"), _GRID)
    pred = F.when(F.col("hr_mean") > F.col("awake_hr"), 0).when(F.col("hr_std") > F.col("rem_std"), 3).otherwise(1)
    return swept.groupBy("awake_hr", "rem_std").agg(
        F.count(F.lit(1)).alias("n"), F.avg((pred == F.col("label")).cast("double")).alias("accuracy")
    )


@query("j15_official_override", sql("""
    SELECT d.user_id, d.date, CASE WHEN o.has_view = 1 THEN o.sleep ELSE d.recovery END AS recovery, d.hrv AS hrv FROM daily d LEFT JOIN daily o ON o.user_id = d.user_id AND o.date = d.date""", "daily", "recovery hrv"))
def j15(spark, sf):
    d = daily_scores(spark, sf)
    official = d.select(
        "user_id", "date",
        F.when(F.col("has_view") == 1, F.concat(F.col("sleep").cast("int"), F.lit("%"))).otherwise("--").alias("recovery"),
        F.lit("--").alias("hrv"),
    )
    return joins.override_with_official(d.select("user_id", "date", "recovery", "hrv"), official, ["recovery", "hrv"], DAY)


@query("j16_calendar_merge", sql("""
    SELECT coalesce(d.user_id, c.user_id, r.user_id) AS user_id, coalesce(d.date, c.date, r.date) AS date, coalesce(r.recovery, d.recovery, 0) AS recovery,
           coalesce(c.strain, d.strain, 0) AS strain, coalesce(c.sleep, d.sleep, 0) AS sleep
    FROM (SELECT * FROM daily WHERE has_view = 1) d FULL JOIN (SELECT * FROM daily WHERE has_purchase = 1) c ON c.user_id = d.user_id AND c.date = d.date
    FULL JOIN (SELECT user_id, date, sleep AS recovery FROM daily WHERE n_events > 2) r ON r.user_id = coalesce(d.user_id, c.user_id) AND r.date = coalesce(d.date, c.date)""", "daily", "recovery strain sleep"))
def j16(spark, sf):
    d = daily_scores(spark, sf)
    docs = d.where("has_view = 1").select("user_id", "date", "recovery", "strain", "sleep")
    cycles = d.where("has_purchase = 1").select("user_id", "date", "strain", "sleep")
    recoveries = d.where("n_events > 2").select("user_id", "date", F.col("sleep").alias("recovery"))
    return joins.merge_calendar(docs, cycles, recoveries)


@query("j17_match_workouts", sql("""
    SELECT t.user_id, t.date, t.activity_id, min(o.workout_id) AS workout_id FROM tk t
    LEFT JOIN (SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, event_id AS workout_id, CAST(floor(epoch(ts)) AS BIGINT) - 240 AS s, CAST(floor(epoch(ts)) AS BIGINT) + 1200 AS e FROM events WHERE event_type IN ('view', 'click')) o
      ON o.user_id = t.user_id AND o.date = t.date AND (abs(t.start_ts - o.s) // 60 < 15 OR coalesce(abs(t.end_ts - o.e) // 60 < 15, false)) GROUP BY 1, 2, 3""", "tracked",
    extra="tk AS (SELECT user_id, start_ts, end_ts, strftime(DATE '1970-01-01' + CAST(start_ts // 86400 AS INT), '%Y-%m-%d') AS date, start_ts AS activity_id FROM tracked)"))
def j17(spark, sf):
    t = tracked(spark, sf).withColumns(
        {"date": F.to_date(F.timestamp_seconds("start_ts")), "activity_id": F.col("start_ts")}
    )
    ts = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    official = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select(
        "user_id", F.to_date(F.col("ts").cast("timestamp")).alias("date"), F.col("event_id").alias("workout_id"),
        F.col("event_id").alias("position"), (ts - 240).alias("start_ts"), (ts + 1200).alias("end_ts"),
    )
    return joins.match_workouts(t, official).select("user_id", "date", "activity_id", "workout_id")


# ---------------------------------------------------------------------- trends


@query("a27_monthly_averages", sql("""
    SELECT o_custkey % 50 AS user_id, strftime(o_orderdate, '%Y-%m') AS month, round_even(avg(o_orderkey % 211), 1) AS strain, round_even(avg(o_orderkey % 101), 1) AS recovery, count(*) AS days FROM orders GROUP BY 1, 2""", "", "strain recovery"))
def a27(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(
        (F.col("o_custkey") % 50).alias("user_id"), F.col("o_orderdate").alias("date"),
        (F.col("o_orderkey") % 211).alias("strain"), (F.col("o_orderkey") % 101).alias("recovery"),
    )
    return trends.monthly_averages(d, ["strain", "recovery"])


@query("a28_weekday_pattern", sql("""
    SELECT user_id, isodow(CAST(date AS DATE)) - 1 AS weekday, round_even(avg(recovery), 1) AS recovery, round_even(avg(sleep), 1) AS sleep, round_even(avg(hrv), 1) AS hrv FROM daily GROUP BY 1, 2""",
    "daily", "recovery sleep hrv"))
def a28(spark, sf):
    return trends.weekday_pattern(daily_scores(spark, sf), ["recovery", "sleep", "hrv"])


@query("a28_best_weekday", sql("""
    SELECT user_id, arg_min(weekday, (-recovery, weekday)) AS best_recovery, arg_min(weekday, (-hrv, weekday)) AS best_hrv FROM (
      SELECT user_id, isodow(CAST(date AS DATE)) - 1 AS weekday, round_even(avg(recovery), 1) AS recovery, round_even(avg(hrv), 1) AS hrv FROM daily GROUP BY 1, 2) GROUP BY 1""", "daily"))
def a28_best(spark, sf):
    return trends.best_weekday(daily_scores(spark, sf), ["recovery", "hrv"])


@query("a29_correlations", sql("""
    SELECT user_id, r_sleep, r_strain, r_same, CASE WHEN r_strain IS NULL THEN NULL WHEN abs(r_strain) > 0.5 THEN 'strong' WHEN abs(r_strain) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM (
      SELECT user_id, CASE WHEN count(nr) >= 5 THEN round_even(corr(sleep_hours, nr), 3) END AS r_sleep, CASE WHEN count(nr) >= 5 THEN round_even(corr(strain, nr), 3) END AS r_strain,
             CASE WHEN count(*) >= 5 THEN round_even(corr(strain, recovery), 3) END AS r_same
      FROM (SELECT *, lead(recovery) OVER (PARTITION BY user_id ORDER BY date) AS nr FROM daily) GROUP BY 1)""", "daily", "r_sleep r_strain r_same"))
def a29(spark, sf):
    return trends.next_day_correlations(daily_scores(spark, sf))


@query("a30_best_worst_day", sql("""
    SELECT user_id, min(CASE WHEN recovery = b THEN date END) AS best_date, max(b) AS best, min(CASE WHEN recovery = w THEN date END) AS worst_date, max(w) AS worst
    FROM (SELECT *, max(recovery) OVER (PARTITION BY user_id) AS b, min(CASE WHEN recovery > 0 THEN recovery END) OVER (PARTITION BY user_id) AS w FROM daily) GROUP BY 1""", "daily", "best worst"))
def a30(spark, sf):
    return trends.best_and_worst_day(daily_scores(spark, sf), ignore_zero=True)


@query("a31_trend_spans", sql("""
    SELECT user_id, span, count(*) AS days, avg(strain) AS avg_strain, avg(rhr) AS avg_rhr, max(strain) AS max_strain, max(rhr) AS max_rhr
    FROM (SELECT *, max(CAST(date AS DATE)) OVER (PARTITION BY user_id) - CAST(date AS DATE) AS age FROM daily), (SELECT unnest([7, 30, 90]) AS span) s WHERE age < span GROUP BY 1, 2""", "daily", "avg_strain avg_rhr max_strain max_rhr"))
def a31(spark, sf):
    return trends.trend_windows(daily_scores(spark, sf), ["strain", "rhr"])


@query("a32_weekly_report", sql("""
    SELECT user_id, sum(recovery) / 7 AS avg_recovery, sum(sleep) / 7 AS avg_sleep, sum(strain) / 7 AS avg_strain, strftime(CAST(arg_min(d, (-recovery, d)) AS DATE), '%Y-%m-%d') AS best_date FROM (
      SELECT s.user_id, s.d, coalesce(x.recovery, 0) AS recovery, coalesce(x.sleep, 0) AS sleep, coalesce(x.strain, 0) AS strain
      FROM (SELECT user_id, CAST(m - CAST(k AS INT) AS DATE) AS d FROM (SELECT user_id, max(CAST(date AS DATE)) AS m FROM daily GROUP BY 1), (SELECT unnest(range(7)) AS k)) s
      LEFT JOIN daily x ON x.user_id = s.user_id AND CAST(x.date AS DATE) = s.d) GROUP BY 1""", "daily", "avg_recovery avg_sleep avg_strain"))
def a32(spark, sf):
    return trends.weekly_report(daily_scores(spark, sf), ["recovery", "sleep", "strain"])


@query("a33_recovery_analysis", sql("SELECT * FROM recovery7", "recovery7", "avg_recovery"))
def a33(spark, sf):
    return trends.recovery_analysis(daily_scores(spark, sf))


@query("a34_sleep_analysis", sql("""
    SELECT user_id, avg(sleep) AS avg_sleep, max(sleep) AS best, min(sleep) AS worst, count(*) AS days
    FROM (SELECT *, max(CAST(date AS DATE)) OVER (PARTITION BY user_id) AS m FROM daily) WHERE CAST(date AS DATE) > m - 7 GROUP BY 1""", "daily", "avg_sleep best worst"))
def a34(spark, sf):
    return trends.sleep_analysis(daily_scores(spark, sf))


cte("stress_days", "day", """
    SELECT user_id, date, avg(s) AS avg_stress, max(s) AS peak, min(s) AS lowest, CAST(coalesce(sum(CASE WHEN s < 34 THEN g END), 0) AS BIGINT) AS low_s,
           CAST(coalesce(sum(CASE WHEN s >= 34 AND s < 67 THEN g END), 0) AS BIGINT) AS moderate_s, CAST(coalesce(sum(CASE WHEN s >= 67 THEN g END), 0) AS BIGINT) AS high_s
    FROM (SELECT *, CASE WHEN gap > 600 THEN 300 ELSE gap END AS g FROM (
      SELECT user_id, date, CAST(hr AS DOUBLE) AS s, lead(ts) OVER (PARTITION BY user_id, date ORDER BY ts) - ts AS gap FROM day WHERE spo2 > 93)) GROUP BY 1, 2""")


def stress_days(spark, sf):
    points = day_rows(spark, sf).where("spo2 > 93").withColumn("stress", F.col("hr").cast("double"))
    return trends.stress_day(points)


@query("a35_stress_day", sql("SELECT * FROM stress_days", "stress_days", "avg_stress peak lowest"))
def a35(spark, sf):
    return stress_days(spark, sf)


@query("a36_stress_trend", sql("""
    SELECT user_id, avg(avg_stress) AS period_avg, arg_min(date, (avg_stress, date)) AS lowest_date, min(CASE WHEN avg_stress = m THEN date END) AS highest_date, count(*) AS days
    FROM (SELECT *, max(avg_stress) OVER (PARTITION BY user_id) AS m FROM stress_days) GROUP BY 1""", "stress_days", "period_avg"))
def a36(spark, sf):
    return trends.stress_trend(stress_days(spark, sf))


@query("a50_energy", sql("SELECT user_id, sum(round_even(kilojoule / 4.184E0, 0)) AS total_kcal, avg(round_even(kilojoule / 4.184E0, 0)) AS avg_kcal FROM daily GROUP BY 1", "daily", "total_kcal avg_kcal"))
def a50(spark, sf):
    return trends.energy(daily_scores(spark, sf))


@query("a51_workout_zone_minutes", sql("""
    SELECT o_orderkey AS workout_id, zone, ms / 60000.0 AS minutes FROM (
      SELECT o_orderkey, unnest(['zone_one_milli', 'zone_two_milli', 'zone_three_milli']) AS zone, unnest([(o_orderkey % 7) * 60000, (o_custkey % 5) * 90000, ((o_orderkey + o_custkey) % 3) * 30000]) AS ms FROM orders) WHERE ms > 0""", "", "minutes"))
def a51(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    zones = F.create_map(
        F.lit("zone_one_milli"), (k % 7) * 60000, F.lit("zone_two_milli"), (c % 5) * 90000, F.lit("zone_three_milli"), ((k + c) % 3) * 30000
    )
    w = table(spark, sf, "orders").select(k.alias("workout_id"), zones.alias("zone_duration"))
    return trends.workout_zone_minutes(w)


@query("a52_history_context", sql("""
    SELECT h.user_id, h.n_days, h.sum_hrv, coalesce(w.n_workouts, 0) AS n_workouts FROM (
      SELECT user_id, count(*) AS n_days, sum(hrv) AS sum_hrv, max(m) AS m FROM (SELECT *, max(CAST(date AS DATE)) OVER (PARTITION BY user_id) AS m FROM daily) WHERE CAST(date AS DATE) > m - 14 GROUP BY 1) h
    LEFT JOIN (SELECT t.user_id, count(*) AS n_workouts FROM tracked t JOIN (SELECT user_id, max(CAST(date AS DATE)) AS m FROM daily GROUP BY 1) x ON x.user_id = t.user_id
      WHERE DATE '1970-01-01' + CAST(start_ts // 86400 AS INT) > m - 7 AND DATE '1970-01-01' + CAST(start_ts // 86400 AS INT) <= m GROUP BY 1) w ON w.user_id = h.user_id""", "daily tracked", "sum_hrv"))
def a52(spark, sf):
    w = tracked(spark, sf).withColumns(
        {"date": F.to_date(F.timestamp_seconds("start_ts")), "strain": F.col("elapsed_s") / 3600.0}
    )
    context = trends.history_context(daily_scores(spark, sf), w, 14)
    total = F.aggregate("history", F.lit(0.0), lambda a, d: a + d["hrv"])
    return context.select(
        "user_id", F.size("history").alias("n_days"), total.alias("sum_hrv"),
        F.when(F.col("workouts").isNull(), 0).otherwise(F.size("workouts")).alias("n_workouts"),
    )


# ---------------------------------------------------------------- table idioms


@query("k1_latest_rows", sql("""
    SELECT user_id, ts AS timestamp, CAST(hr AS BIGINT) AS hr, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank FROM event_seconds) WHERE rank <= 5""", "event_seconds"))
def k1(spark, sf):
    return trends.latest(event_seconds(spark, sf), 5).select("user_id", "timestamp", "hr", "rank")


@query("k2_top_features", sql("""
    SELECT feature, d AS strength FROM (
      SELECT 'hr_mean' AS feature, abs(corr(hr_mean, label)) AS d FROM x UNION ALL SELECT 'hr_std', abs(corr(hr_std, label)) FROM x UNION ALL SELECT 'mv_mean', abs(corr(mv_mean, label)) FROM x
      UNION ALL SELECT 'rr_mean', abs(corr(rr_mean, label)) FROM x UNION ALL SELECT 'gyro_std', abs(corr(gyro_std, label)) FROM x) ORDER BY d DESC, feature LIMIT 3""", "w_st wl", "strength",
    extra="x AS (SELECT s.*, l.label FROM w_st s JOIN wl l ON l.user_id = s.user_id AND l.night = s.night AND l.win = s.win)"))
def k2(spark, sf):
    names = ["hr_mean", "hr_std", "mv_mean", "rr_mean", "gyro_std"]
    long = window_frame(spark, sf).select(
        "label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("v")
    )
    ranked = long.groupBy("v.feature").agg(F.abs(F.corr("v.x", "label")).alias("strength"))
    return trends.top_k(ranked, "strength", 3, "feature")


@query("k3_night_clock_order", sql("""
    SELECT user_id, night, clock, row_number() OVER (PARTITION BY user_id, night ORDER BY clock + CASE WHEN clock < 720 THEN 1440 ELSE 0 END) AS rank
    FROM (SELECT DISTINCT user_id, night, ((ts + 3600) % 86400) // 60 AS clock FROM night)""", "night"))
def k3(spark, sf):
    from nocturne.functions.scalars import night_minute

    clock = nights.local_minute(F.col("timestamp")).alias("clock")
    distinct = night_rows(spark, sf).select(*NIGHT, clock).distinct()
    order = W.partitionBy(*NIGHT).orderBy(night_minute(F.col("clock")))
    return distinct.withColumn("rank", F.row_number().over(order))


@query("k4_keep_first_and_last", sql("""
    SELECT user_id, date, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, event_id FROM events) GROUP BY 1, 2"""))
def k4(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date(F.col("ts").cast("timestamp")).alias("date"), "event_id")
    first = trends.keep_one(e, DAY, ["event_id"]).withColumnRenamed("event_id", "first_event")
    last = trends.keep_one(e, DAY, ["event_id"], "last").withColumnRenamed("event_id", "last_event")
    return first.join(last, DAY)


@query("k5_union_sources", sql("""
    SELECT source, count(*) AS n, count(hrv) AS n_hrv FROM (SELECT 'own' AS source, hrv FROM daily UNION ALL SELECT 'official', NULL FROM official) GROUP BY 1""", "official"))
def k5(spark, sf):
    own = daily_scores(spark, sf).select("user_id", "date", "hrv", F.lit("own").alias("source"))
    official = official_scores(spark, sf).select("user_id", "date", F.lit("official").alias("source"))
    both = own.unionByName(official, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("hrv").alias("n_hrv"))


@query("k6_intersect_days", sql("SELECT user_id, date FROM daily WHERE has_view = 1 INTERSECT SELECT user_id, date FROM daily WHERE has_purchase = 1", "daily"))
def k6(spark, sf):
    d = daily_scores(spark, sf)
    return d.where("has_view = 1").select(*DAY).intersect(d.where("has_purchase = 1").select(*DAY))


@query("k7_except_days", sql("SELECT user_id, date FROM daily EXCEPT SELECT user_id, date FROM official", "official"))
def k7(spark, sf):
    return daily_scores(spark, sf).select(*DAY).subtract(official_scores(spark, sf).select(*DAY))


@query("k8_distinct_days", sql("SELECT DISTINCT user_id, date FROM day", "day"))
def k8(spark, sf):
    return day_rows(spark, sf).select(*DAY).distinct()


@query("scalar_text_numbers", sql("""
    SELECT doc_id, CASE kind WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 2 THEN n // 60 + (n % 60) / 60.0 WHEN 3 THEN n // 60 + (n % 60) / 60.0 END AS value,
           CASE kind WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 4 THEN 0 ELSE CAST((n // 60) || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS DOUBLE) END AS digits
    FROM (SELECT doc_id, doc_id % 5 AS kind, n_chars AS n FROM documents)""", "", "value digits"))
def text_numbers(spark, sf):
    n, kind = F.col("n_chars").cast("int"), F.col("doc_id") % 5
    h, m = F.floor(n / 60).cast("int"), F.format_string("%02d", (n % 60).cast("int"))
    text = (
        F.when(kind == 0, F.concat(n, F.lit("%"))).when(kind == 1, F.format_number(n, 0))
        .when(kind == 2, F.concat(h, F.lit(":"), m)).when(kind == 3, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise("--")
    )
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", to_number(F.col("text")).alias("value"), digits_number(F.col("text")).alias("digits"))


@query("scalar_strain_bands", sql("""
    SELECT CASE WHEN strain < 10 THEN 'green' WHEN strain < 14 THEN 'yellow' WHEN strain < 18 THEN 'orange' ELSE 'red' END AS band, count(*) AS n FROM daily GROUP BY 1""", "daily"))
def strain_bands(spark, sf):
    return daily_scores(spark, sf).groupBy(strain_band(F.col("strain")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


