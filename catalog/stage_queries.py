"""Stagers (ST1-ST16), sequence repair (Q1-Q6, Q16, Q17) and stage summaries."""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from catalog.spectral_sql import spectrum_cte
from catalog.window_queries import night_rows, window_frame, windows_cte
from nocturne.operators import aggregates, sequence, series, stagers
from nocturne.operators.nights import NIGHT
from nocturne.operators.stagers import RULE_SETS, RuleSet
from nocturne.operators.window_stats import NIGHT_WIN

windows_cte("w60", 60)
windows_cte("ws60", 60, 30)
cte("slide_beats", "ws60_a", """
    SELECT user_id || '/' || night || '/' || win AS g, rr, row_number() OVER (PARTITION BY user_id, night, win ORDER BY ts) AS i
    FROM ws60_a WHERE rr > 200 AND rr < 2500""")
spectrum_cte("sps", "slide_beats", 128)

_EMPTY = "SELECT NULL::VARCHAR AS g, NULL::DOUBLE AS vlf, NULL::DOUBLE AS lf, NULL::DOUBLE AS hf WHERE false"


def stage_sql(rules: RuleSet, windows: str, bands: str | None) -> str:
    """The unsmoothed stage of every window, as SQL."""
    derived = ", ".join(f"{v} AS {k}" for k, v in rules.derived.items())
    scores = ", ".join(f"{stagers.score_sql(rules.groups, s)} AS s_{s}" for s in rules.ties) if rules.groups else "0 AS s_none"
    return f"""
      SELECT user_id, night, win, {stagers.phase_sql(rules)} AS phase FROM (SELECT *, {scores} FROM (SELECT *, {derived} FROM (
        SELECT st.*, r.rhr, lag(n_hr) OVER o AS prev_n_hr, lag(hr_med) OVER o AS prev_med, b.hf IS NOT NULL AS has_power,
               CASE WHEN b.hf IS NULL THEN 1.5 WHEN b.hf < 1e-10 THEN 5.0 ELSE b.lf / b.hf END AS lf_hf,
               CASE WHEN b.hf IS NULL THEN 1.0 WHEN b.hf < 1e-10 THEN 5.0 ELSE b.lf / b.hf END AS lf_hf1,
               CASE WHEN b.hf IS NULL THEN 33.0 ELSE b.hf / (b.lf + b.hf) * 100 END AS hf_pct,
               CASE WHEN b.hf IS NULL THEN 33.0 ELSE b.hf / (b.vlf + b.lf + b.hf) * 100 END AS hf_pct_all
        FROM {windows}_st st JOIN rest r ON r.user_id = st.user_id AND r.night = st.night
        LEFT JOIN ({f"SELECT * FROM {bands}" if bands else _EMPTY}) b ON b.g = st.user_id || '/' || st.night || '/' || st.win
        WINDOW o AS (PARTITION BY st.user_id, st.night ORDER BY st.win))))"""


def smooth_sql(source: str, agree: bool = False) -> str:
    """Isolated-label smoothing as a recursion over the windows of a night."""
    lone = "s.phase <> f.phase AND " + ("f.phase = s.nxt" if agree else "s.phase <> s.nxt")
    return f"""
    raw AS ({source}),
    seq AS (SELECT *, row_number() OVER w AS i, lead(phase) OVER w AS nxt FROM raw WINDOW w AS (PARTITION BY user_id, night ORDER BY win)),
    smooth AS (SELECT user_id, night, win, i, phase FROM seq WHERE i = 1
               UNION ALL SELECT s.user_id, s.night, s.win, s.i, CASE WHEN s.nxt IS NOT NULL AND {lone} THEN f.phase ELSE s.phase END
               FROM smooth f JOIN seq s ON s.user_id = f.user_id AND s.night = f.night AND s.i = f.i + 1)"""


def register_stager_query(key: str, name: str, rows: int, stride: int | None = None) -> None:
    rules = RULE_SETS[name]
    bands = None
    if rules.spectrum_beats:
        windows, bands = ("ws60", "sps_b") if stride else ("w60", "sp_b")
    elif stride:
        windows = "ws"
    else:
        windows = "w0" if rules.hr_above == 0 else "w"
    raw = stage_sql(rules, windows, bands)
    needs = f"{windows}_st rest" + (f" {bands}" if bands else "")
    out = "SELECT user_id, night, win, phase FROM "
    oracle = (
        sql(out + "smooth", needs, recursive=True, extra=smooth_sql(raw)) if rules.smooth
        else sql(out + f"({raw})", needs)
    )

    @query(key, oracle)
    def run(spark, sf):
        staged = stagers.stage_windows(night_rows(spark, sf), rules, None, rows, stride, rest_rows=30, rest_step=3)
        return staged.select(*NIGHT_WIN, "phase")


for _key, _name, _rows, _stride in [
    ("st1_threshold_rules", "threshold", 20, None),
    ("st2_calibrated_rules", "calibrated", 20, None),
    ("st3_app_rules", "app", 20, None),
    ("st4_scored", "scored", 20, None),
    ("st5_scored_gyro", "scored_gyro", 20, None),
    ("st6_spectral_sliding", "spectral_sliding", 60, 30),
    ("st7_nonlinear_sliding", "nonlinear_sliding", 60, 30),
    ("st8_hr_only", "hr_only", 20, 10),
    ("st9_spectral", "spectral", 60, None),
    ("st10_short_epochs", "epoch30", 20, None),
    ("st11_nonlinear", "nonlinear", 60, None),
    ("st12_hr_delta", "hr_delta", 20, None),
    ("st13_fallback_rules", "fallback", 20, None),
    ("st14_two_deep_tiers", "two_tier", 20, None),
]:
    register_stager_query(_key, _name, _rows, _stride)


# the external classifier's coarse label is the synthetic label of the window
_COARSE = "CASE label WHEN 0 THEN 'awake' WHEN 3 THEN 'rem' ELSE 'nrem' END"


def coarse_windows(spark, sf):
    rules = replace(RULE_SETS["hr_only"], smooth=False)
    staged = stagers.stage_windows(night_rows(spark, sf), rules, None, 20, 20, rest_rows=30, rest_step=3)
    span = F.greatest(F.col("night_last") - F.col("night_first"), F.lit(1))
    coarse = F.when(F.col("label") == 0, "awake").when(F.col("label") == 3, "rem").otherwise("nrem")
    return staged.withColumns(
        {"fraction": (F.col("mid_ts") - F.col("night_first")) / span, "coarse": coarse}
    )


cte("coarse", "w_st rest wl", f"""
    SELECT st.*, r.rhr, hr_med - rhr AS ha, {stagers.RMSSD} AS hrv, {_COARSE} AS coarse,
           (mid_ts - night_first) / greatest(night_last - night_first, 1) AS fraction
    FROM w_st st JOIN rest r ON r.user_id = st.user_id AND r.night = st.night
    JOIN wl l ON l.user_id = st.user_id AND l.night = st.night AND l.win = st.win""")


@query("st15_split_by_heart_rate", sql("""
    SELECT user_id, night, win, CASE WHEN mv_mean > 1.0 OR mv_max > 3.0 THEN 'awake' WHEN coarse <> 'nrem' THEN coarse
      WHEN (ha < 2 AND hr_std < 3 AND mv_mean < 0.15) OR (ha < 0 AND hrv > 80) OR (fraction < 0.4 AND ha < 5 AND hr_std < 4) THEN 'deep' ELSE 'light' END AS phase
    FROM coarse""", "coarse"))
def st15_rate(spark, sf):
    return stagers.split_external(coarse_windows(spark, sf)).select(*NIGHT_WIN, "phase")


@query("st15_split_by_median", sql("""
    SELECT user_id, night, win, CASE WHEN coarse <> 'nrem' THEN coarse WHEN n_hr > 0 AND ha < -1 THEN 'deep' ELSE 'light' END AS phase
    FROM coarse""", "coarse"))
def st15_median(spark, sf):
    return stagers.split_external(coarse_windows(spark, sf), "median").select(*NIGHT_WIN, "phase")


@query("st15_split_fixed_share", sql("""
    SELECT user_id, night, n, round_even(100.0 * floor(nrem * 0.25) / n, 1) AS deep_pct, round_even(100.0 * (nrem - floor(nrem * 0.25)) / n, 1) AS light_pct,
           round_even(100.0 * rem / n, 1) AS rem_pct, round_even(100.0 * awake / n, 1) AS awake_pct
    FROM (SELECT user_id, night, count(*) AS n, count(CASE WHEN coarse = 'nrem' THEN 1 END) AS nrem, count(CASE WHEN coarse = 'rem' THEN 1 END) AS rem,
                 count(CASE WHEN coarse = 'awake' THEN 1 END) AS awake FROM coarse GROUP BY 1, 2)""", "coarse",
    "deep_pct light_pct rem_pct awake_pct"))
def st15_fixed(spark, sf):
    return stagers.split_external_fixed(coarse_windows(spark, sf))


@query("st16_awake_overrides", sql("""
    SELECT user_id, night, win, CASE WHEN (mv_mean > 0.008 AND ha > 5) OR mv_energy > 0.004 OR (mv_changes / n_rows > 0.1 AND mv_mean > 0.008 AND ha > 5)
      OR hr_mean / 100.0 > 0.72 THEN 'awake' ELSE coarse END AS phase FROM coarse""", "coarse"))
def st16(spark, sf):
    w = coarse_windows(spark, sf).withColumns(
        {
            "mv_zcr": F.col("mv_changes") / F.col("n_rows"), "p_awake": F.col("hr_mean") / 100.0,
            "phase": F.col("coarse"),
        }
    )
    return stagers.awake_overrides(w, 0.008, 5.0, 0.004, 0.1, 0.72).select(*NIGHT_WIN, "phase")


# -------------------------------------------------------------- sequence repair

_NAMED = "SELECT user_id, night, win, CASE label WHEN 0 THEN 'awake' WHEN 1 THEN 'light' WHEN 2 THEN 'deep' ELSE 'rem' END AS phase FROM {}"
windows_cte("w6", 6)
cte("wl6", "w6_c", "SELECT user_id, night, win, arg_max(label, n * 100 - label) AS label FROM (SELECT user_id, night, win, label, count(*) AS n FROM w6_c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
cte("phases", "wl6", _NAMED.format("wl6"))


def phases(spark, sf):
    """Majority stage of windows of six rows: sequences of up to 31 labels per night."""
    w = window_frame(spark, sf, 6)
    names = F.when(F.col("label") == 0, "awake").when(F.col("label") == 1, "light").when(
        F.col("label") == 2, "deep").otherwise("rem")
    return w.select(*NIGHT_WIN, names.alias("phase"), "start_ts", "last_ts")


@query("q1_smooth_isolated", sql("SELECT user_id, night, win, phase FROM smooth", "phases", recursive=True,
                                 extra=smooth_sql("SELECT * FROM phases")))
def q1(spark, sf):
    return sequence.smooth_isolated(phases(spark, sf))


@query("q2_smooth_isolated_agreeing", sql("SELECT user_id, night, win, phase FROM smooth", "phases", recursive=True,
                                          extra=smooth_sql("SELECT * FROM phases", True)))
def q2(spark, sf):
    return sequence.smooth_isolated(phases(spark, sf), agree=True)


@query("q3_majority_filter", sql("""
    SELECT user_id, night, win, CASE WHEN n < 5 OR i <= 2 OR i > n - 2 THEN phase ELSE (
      SELECT arg_min(x, rank) FROM (SELECT x, -count(*) * 100 + min(ix) AS rank FROM (
        SELECT unnest(near) AS x, unnest(range(5)) AS ix) GROUP BY x)) END AS phase
    FROM (SELECT user_id, night, win, phase, list(phase) OVER (PARTITION BY user_id, night ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near,
                 row_number() OVER (PARTITION BY user_id, night ORDER BY win) AS i, count(*) OVER (PARTITION BY user_id, night) AS n FROM phases)""", "phases"))
def q3(spark, sf):
    return sequence.majority_filter(phases(spark, sf).select(*NIGHT_WIN, "phase"), 5)


@query("q4_architecture_rules", sql("""
    SELECT s.user_id, s.night, s.win, CASE WHEN s.phase = 'awake' AND r.length <= 2 AND r.run > 1 AND r.run < r.runs THEN 'light' ELSE s.phase END AS phase
    FROM numbered s JOIN (SELECT user_id, night, run, count(*) AS length, max(runs) AS runs FROM (
        SELECT *, max(run) OVER (PARTITION BY user_id, night) AS runs FROM numbered) GROUP BY 1, 2, 3) r
      ON r.user_id = s.user_id AND r.night = s.night AND r.run = s.run""", "phases", recursive=True, extra=smooth_sql("""
      SELECT user_id, night, win, CASE WHEN phase = 'rem' AND win * 0.5 < 1.0 AND count(*) OVER (PARTITION BY user_id, night) >= 3 THEN 'light' ELSE phase END AS phase FROM phases""", True) + """,
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
      SELECT user_id, night, win, phase, CASE WHEN phase = lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM smooth))"""))
def q4(spark, sf):
    hours = phases(spark, sf).withColumn("hours_since_onset", F.col("win") * 0.5)
    return sequence.architecture_rules(hours)


@query("q5_floor_runs", sql("""
    SELECT user_id, night, win, CASE WHEN d = 'deep' THEN 'deep' ELSE phase END AS phase FROM (SELECT *, phase AS d FROM floored2)""",
    "phases", recursive=True, extra="""
    n1 AS (SELECT user_id, night, win, phase, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
      SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM phases)),
    r1 AS (SELECT *, lag(phase) OVER w AS bef, lead(phase) OVER w AS aft FROM (SELECT user_id, night, run, any_value(phase) AS phase, count(*) AS length FROM n1 GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY user_id, night ORDER BY run)),
    floored1 AS (SELECT n.user_id, n.night, n.win, CASE WHEN r.phase = 'deep' AND r.length < 4 THEN
        CASE WHEN coalesce(bef, 'light') = coalesce(aft, 'light') THEN coalesce(bef, 'light') ELSE 'light' END ELSE n.phase END AS phase
      FROM n1 n JOIN r1 r ON r.user_id = n.user_id AND r.night = n.night AND r.run = n.run),
    n2 AS (SELECT user_id, night, win, phase, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
      SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM floored1)),
    r2 AS (SELECT *, lag(phase) OVER w AS bef, lead(phase) OVER w AS aft FROM (SELECT user_id, night, run, any_value(phase) AS phase, count(*) AS length FROM n2 GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY user_id, night ORDER BY run)),
    floored2 AS (SELECT n.user_id, n.night, n.win, CASE WHEN r.phase = 'rem' AND r.length < 3 THEN
        CASE WHEN coalesce(bef, 'light') = coalesce(aft, 'light') THEN coalesce(bef, 'light') ELSE 'light' END ELSE n.phase END AS phase
      FROM n2 n JOIN r2 r ON r.user_id = n.user_id AND r.night = n.night AND r.run = n.run)"""))
def q5(spark, sf):
    return sequence.floor_runs(phases(spark, sf))


_FLAG_RUNS = """
    fl AS (SELECT user_id, night, win, phase, CASE WHEN phase = 'awake' THEN 1 ELSE 0 END AS awake FROM phases),
    fr AS (SELECT *, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
      SELECT *, CASE WHEN awake = lag(awake) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM fl)),
    fx AS (SELECT *, count(*) OVER (PARTITION BY user_id, night, run) AS length, max(run) OVER (PARTITION BY user_id, night) AS runs FROM fr)"""


@query("q6_drop_short_runs", sql("""
    SELECT user_id, night, win, CASE WHEN awake = 1 AND length < 2 THEN 0 ELSE awake END AS awake FROM fx""", "phases", extra=_FLAG_RUNS))
def q6_drop(spark, sf):
    flagged = phases(spark, sf).select(*NIGHT_WIN, (F.col("phase") == "awake").cast("int").alias("awake"))
    return sequence.drop_short_runs(flagged, "awake", 2)


@query("q6_bridge_awake", sql("""
    SELECT user_id, night, win, CASE WHEN awake = 0 AND length <= 2 AND run > 1 AND run < runs THEN 'awake' ELSE phase END AS phase FROM fx""",
    "phases", extra=_FLAG_RUNS))
def q6_bridge(spark, sf):
    return sequence.bridge_awake(phases(spark, sf).select(*NIGHT_WIN, "phase"), 2)


@query("q16_sleep_cycles", sql("""
    SELECT user_id, night, CAST(cycle AS BIGINT) AS cycle, count(CASE WHEN phase <> 'rem' THEN 1 END) AS nrem_windows,
           count(CASE WHEN phase = 'rem' THEN 1 END) AS rem_windows, count(*) AS total_windows
    FROM (SELECT *, sum(e) OVER (PARTITION BY user_id, night ORDER BY win) AS cycle FROM (
      SELECT *, CASE WHEN phase <> 'rem' AND lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) = 'rem' THEN 1 ELSE 0 END AS e
      FROM phases WHERE phase <> 'awake')) GROUP BY 1, 2, 3 HAVING count(*) >= 3""", "phases"))
def q16(spark, sf):
    return sequence.sleep_cycles(phases(spark, sf), 3)


@query("q16_deep_rem_transitions", sql("""
    SELECT user_id, night, greatest(1, sum(CASE WHEN phase = 'rem' AND prev = 'deep' THEN 1 ELSE 0 END)) AS cycles
    FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) AS prev FROM phases) GROUP BY 1, 2""", "phases"))
def q16_transitions(spark, sf):
    return sequence.deep_rem_transitions(phases(spark, sf))


@query("q17_disturbances", sql("""
    SELECT user_id, night, sum(CASE WHEN phase = 'awake' AND coalesce(prev <> 'awake', true) THEN 1 ELSE 0 END) AS disturbances,
           sum(CASE WHEN phase IN ('deep', 'rem') THEN 1 ELSE 0 END) AS restorative_windows
    FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id, night ORDER BY win) AS prev FROM phases) GROUP BY 1, 2""", "phases"))
def q17(spark, sf):
    return sequence.disturbances(phases(spark, sf))


@query("w21_label_bounds", sql("""
    SELECT p.user_id, p.night, min(CASE WHEN phase <> 'awake' THEN s.start_ts END) AS onset_ts, max(CASE WHEN phase <> 'awake' THEN s.last_ts END) AS wake_ts,
           min(s.start_ts) AS first_ts, max(s.last_ts) - min(s.start_ts) AS in_bed_s
    FROM phases p JOIN w6_st s ON s.user_id = p.user_id AND s.night = p.night AND s.win = p.win GROUP BY 1, 2""", "phases w6_st"))
def w21(spark, sf):
    return series.label_bounds(phases(spark, sf))


_PCT = ", ".join(f"round_even(100.0 * count(CASE WHEN phase = '{s}' THEN 1 END) / count(*), 1) AS {s}_pct" for s in ("awake", "light", "deep", "rem"))
_MIN = ", ".join(f"round_even(CAST(count(CASE WHEN phase = '{s}' THEN 1 END) * 10 AS DOUBLE), 1) AS {s}_min" for s in ("awake", "light", "deep", "rem"))
cte("stage_sum", "phases", f"""
    SELECT user_id, night, count(*) AS total, CAST(count(*) * 10 AS DOUBLE) AS total_min, CAST(count(CASE WHEN phase <> 'awake' THEN 1 END) * 10 AS DOUBLE) AS sleep_min,
           round_even(100.0 * count(CASE WHEN phase <> 'awake' THEN 1 END) / count(*), 1) AS efficiency, {_MIN}, {_PCT} FROM phases GROUP BY 1, 2""")
SUMMARY = ("total_min sleep_min efficiency awake_min light_min deep_min rem_min awake_pct light_pct deep_pct rem_pct")


@query("a23_stage_summary", sql("SELECT * FROM stage_sum", "stage_sum", SUMMARY))
def a23(spark, sf):
    return aggregates.stage_summary(phases(spark, sf), 10.0)


@query("a24_hypnogram_statistics", sql("""
    SELECT user_id, night, sleep_min AS tst_min, printf('%d:%02d', CAST(sleep_min AS INT) // 60, CAST(sleep_min AS INT) % 60) AS tst_hours, efficiency AS se,
           awake_pct, light_pct, deep_pct, rem_pct, awake_min, light_min, deep_min, rem_min FROM stage_sum""", "stage_sum",
    "tst_min se awake_pct light_pct deep_pct rem_pct awake_min light_min deep_min rem_min"))
def a24(spark, sf):
    return aggregates.hypnogram_statistics(phases(spark, sf), 600)
