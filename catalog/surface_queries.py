"""Whole-day result (SC16) and the pluggable stager and scorer surface."""

from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from catalog.daily_queries import _REC1 as RECOVERY_CUSTOM
from catalog.daily_queries import _REC2 as RECOVERY_CALIBRATED
from catalog.daily_queries import WHOLE
from catalog.window_queries import night_rows, rest
from nocturne.operators import aggregates, nights, stagers
from nocturne.operators.nights import NIGHT
from nocturne.operators.stagers import RULE_SETS
from nocturne.plans import compare, scorers
from nocturne.plans.day import full_day
from nocturne.sources.adapters import daily_scores, sensor


@query("sc16_full_day")
def sc16(spark, sf):
    """Sixty-second samples: every user has one night of up to 600 rows."""
    return full_day(
        sensor(spark, sf, 60), max_hr=120, bout_min_s=300, rules=RULE_SETS["fallback"], rows=20, rest_rows=60,
        rest_step=6, sws_beats=100, min_rows=100,
    )


@query("stager_comparison")
def stager_comparison(spark, sf):
    """Three registered stagers on the same nights with their stage shares and errors."""
    rows, rhr = night_rows(spark, sf), rest(spark, sf)
    chosen = {
        name: (lambda df, r, k=name: stagers.stage_windows(df, RULE_SETS[k], r, 20))
        for name in ("threshold", "calibrated", "scored")
    }
    shares = compare.compare_stagers(rows, rhr, chosen, 100 / 20)
    labels = stagers.stage_windows(rows, RULE_SETS["hr_only"], rhr, 20, 20)
    named = labels.withColumn(
        "phase", F.element_at(F.array(*[F.lit(s) for s in ("awake", "light", "deep", "rem")]), F.col("label") + 1)
    )
    official = aggregates.stage_summary(named, 5.0)
    return compare.stager_errors(shares, official).select("algo", *NIGHT, "error")


@query("scorer_registry")
def scorer_registry(spark, sf):
    """Registered scorers over all days; one of them fails and becomes an error row."""
    rows = sensor(spark, sf)
    return compare.run_scorers(rows, {
        "load": lambda df: compare.daily_strain(df, 100), "broken": lambda df: df.select("no_such_column"),
    })


# inputs as a careless export has them: text, gaps and impossible values
_INPUTS = """
    SELECT user_id, date, CASE WHEN hrv < 25 THEN 'n/a' ELSE CAST(hrv AS VARCHAR) END AS hrv_text, hrv,
           CASE WHEN rhr <> 50 THEN rhr END AS rhr, CASE WHEN resp = 18 THEN 0.0E0 ELSE resp END AS resp,
           sleep_hours * 60 AS sleep_min, efficiency, awake_pct, awake_pct + 10 AS deep_pct, 20.0E0 AS rem_pct,
           kilojoule / 40 AS zone_load, CAST(n_events AS DOUBLE) AS n_valid, n_events + 1.0E0 AS n_rows FROM daily"""
cte("scorer_inputs", "daily", _INPUTS)
_SLEEP_CUSTOM = WHOLE.format("0.40E0 * least(100, sleep_min / 480 * 100) + 0.30E0 * least(100, efficiency) + 0.20E0 * least(100, (deep_pct + rem_pct) * 2.5E0) + 0.10E0 * greatest(0, 100 - awake_pct * 5)")
_SLEEP_CALIBRATED = WHOLE.format("0.23E0 * least(100, sleep_min / 480 * 100) + 0.34E0 * 41.5E0 + 0.26E0 * least(100, efficiency) + 0.18E0 * greatest(0, 100 - awake_pct * 5)")
_SLEEP_ENGINE = "round_even(greatest(0, least(100, 0.4E0 * least(100, sleep_min / 60 / 7.5E0 * 100) + 0.3E0 * least(100, efficiency) + 0.3E0 * 70)), 0)"
_RECOVERY_ENGINE = "round_even(greatest(0, least(100, 0.60E0 * 100 / (1 + exp(-4 * (hrv / 90 - 1))) + 0.25E0 * greatest(0, least(100, 50 + (55 - rhr) * 8)) + 0.15E0 * least(100, efficiency) - CASE WHEN resp > 18 THEN (resp - 18) * 5 WHEN resp < 10 THEN (10 - resp) * 5 ELSE 0 END)), 0)"
_RECOVERY_SIMPLE = "greatest(0, least(100, floor(least(100, hrv / 1.5) * 0.6E0 + greatest(0, 100 - (rhr - 40) * 3) * 0.4E0)))"
_STRAIN = "least(21, round_even(5.5E0 * ln(1 + zone_load / 15.0E0), 1))"


def _scorer_sql(name: str, recovery: str, sleep: str, strain: str, resp: bool = True) -> str:
    fault = "WHEN hrv_text = 'n/a' THEN 'not_a_number:hrv' WHEN rhr IS NULL THEN 'missing:rhr'" + (" WHEN resp < 4 THEN 'out_of_range:resp'" if resp else "")
    return f"""
      SELECT '{name}' AS algo, user_id, date, CASE {fault} END AS error, {recovery} AS recovery, CAST({sleep} AS DOUBLE) AS sleep, CAST({strain} AS DOUBLE) AS strain,
             hrv AS hrv_ms, rhr AS rhr_bpm, {"resp" if resp else "NULL::DOUBLE"} AS resp_rate
      FROM (SELECT *, 90.0E0 AS hb, 55.0E0 AS rb, {sleep} AS sleep FROM scorer_inputs)"""


_CALIBRATED_STRAIN = "least(21, round_even(2.32E0 * ln(1 + zone_load * least(3.0E0, n_rows / n_valid) / 6.3E0), 1))"
_ALL_SCORERS = " UNION ALL ".join([
    _scorer_sql("custom", RECOVERY_CUSTOM, _SLEEP_CUSTOM, _STRAIN), _scorer_sql("calibrated", RECOVERY_CALIBRATED, _SLEEP_CALIBRATED, _CALIBRATED_STRAIN),
    _scorer_sql("engine", _RECOVERY_ENGINE, _SLEEP_ENGINE, _STRAIN), _scorer_sql("simple", _RECOVERY_SIMPLE, "NULL::DOUBLE", "NULL::DOUBLE", resp=False),
])
_WELL = ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in compare.SCORE_COLUMNS)


@query("scorer_contract", sql(f"SELECT algo, user_id, date, {_WELL}, error FROM ({_ALL_SCORERS})", "scorer_inputs", " ".join(compare.SCORE_COLUMNS)))
def scorer_contract(spark, sf):
    """Four scorers over all days; days with text, gaps or impossible values become error rows."""
    text = F.when(F.col("hrv") < 25, "n/a").otherwise(F.col("hrv").cast("string"))
    days = daily_scores(spark, sf).select(
        "user_id", "date", text.alias("hrv"), F.when(F.col("rhr") != 50, F.col("rhr")).alias("rhr"),
        F.when(F.col("resp") == 18, 0.0).otherwise(F.col("resp")).alias("resp"), (F.col("sleep_hours") * 60).alias("sleep_min"),
        "efficiency", "awake_pct", (F.col("awake_pct") + 10).alias("deep_pct"), F.lit(20.0).alias("rem_pct"),
        (F.col("kilojoule") / 40).alias("zone_load"), F.col("n_events").alias("n_valid"), (F.col("n_events") + 1).alias("n_rows"),
    )
    return scorers.score_days(days)


@query("scorer_day_functions", sql("""
    SELECT 'resting' AS algo, user_id, date, CASE WHEN n >= 20 THEN rest END AS rhr_bpm, NULL::DOUBLE AS hrv_ms, CASE WHEN n < 20 THEN 'LookupError' END AS error
    FROM (SELECT user_id, date, count(CASE WHEN hr > 30 THEN 1 END) AS n, quantile_cont(CASE WHEN hr > 30 THEN CAST(hr AS DOUBLE) END, 0.1) AS rest FROM day GROUP BY 1, 2)
    UNION ALL
    SELECT 'variability', user_id, date, NULL::DOUBLE, sqrt(avg(d * d)), CASE WHEN count(d) = 0 THEN 'ZeroDivisionError' END
    FROM (SELECT user_id, date, r - lag(r IGNORE NULLS) OVER (PARTITION BY user_id, date ORDER BY ts) AS d
          FROM (SELECT *, CASE WHEN rr > 200 AND rr < 2500 THEN rr END AS r FROM day)) GROUP BY 2, 3""", "day", "rhr_bpm hrv_ms"))
def scorer_day_functions(spark, sf):
    """Two Python scorers over the readings of every day; a day on which one raises is its error row."""
    rows = nights.with_date(sensor(spark, sf))
    scored = scorers.score_readings(rows, {"resting": scorers.resting_rate, "variability": scorers.beat_variability}, ["hr", "rr1_ms"])
    return scored.select("algo", *nights.DAY, "rhr_bpm", "hrv_ms", "error")
