"""Evaluation (A38-A49), decoding (Q7-Q15) and models (M1-M14, IO17)."""

import numpy as np
from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from catalog.daily_queries import pairs
from catalog.stage_queries import a23, phases
from catalog.window_queries import night_bounds, night_rows, window_frame, window_labels, with_bounds
from nocturne.operators import decoding, evaluate, order_stats, sequence
from nocturne.operators.nights import NIGHT
from nocturne.operators.window_stats import NIGHT_WIN
from nocturne.plans import features, models
from nocturne.session import cut_lineage
from nocturne.sources.adapters import SENSOR_ROWS, daily_scores, official_scores, sensor, sensor_tasks

# ------------------------------------------------------------------ evaluation

cte("ev", "w_st wl position", """
    SELECT s.user_id, s.night, s.win, l.label, CASE WHEN hr_mean > 68 THEN 0 WHEN hr_std < 13 THEN 2 WHEN hr_std > 15 THEN 3 ELSE 1 END AS pred,
           p.fraction_of_night, hr_mean / 100 AS score FROM w_st s
    JOIN wl l ON l.user_id = s.user_id AND l.night = s.night AND l.win = s.win JOIN position p ON p.user_id = s.user_id AND p.night = s.night AND p.win = s.win""")


def ev(spark, sf):
    w = with_bounds(window_frame(spark, sf), night_rows(spark, sf))
    pred = F.when(F.col("hr_mean") > 68, 0).when(F.col("hr_std") < 13, 2).when(F.col("hr_std") > 15, 3).otherwise(1)
    return w.select(*NIGHT_WIN, "label", pred.alias("pred"), "fraction_of_night", (F.col("hr_mean") / 100).alias("score"))


@query("a38_confusion_matrix", sql("""
    SELECT label AS true, count(CASE WHEN pred = 0 THEN 1 END) AS pred_0, count(CASE WHEN pred = 1 THEN 1 END) AS pred_1, count(CASE WHEN pred = 2 THEN 1 END) AS pred_2, count(CASE WHEN pred = 3 THEN 1 END) AS pred_3 FROM ev GROUP BY 1""", "ev"))
def a38(spark, sf):
    return evaluate.confusion_matrix(ev(spark, sf))


_N = {k: (f"count(CASE WHEN label = {k} AND pred = {k} THEN 1 END)", f"count(CASE WHEN label = {k} THEN 1 END)", f"count(CASE WHEN pred = {k} THEN 1 END)") for k in range(4)}
_REC = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS recall_{k}" for k, (a, b, _) in _N.items())
_PRE = ", ".join(f"CASE WHEN {p} > 0 THEN {a} / {p} ELSE 0 END AS precision_{k}" for k, (a, _, p) in _N.items())
REPORT = "accuracy recall_0 recall_1 recall_2 recall_3 precision_0 precision_1 precision_2 precision_3 min_recall"


@query("a38_report_per_night", sql(f"SELECT *, least(recall_0, recall_1, recall_2, recall_3) AS min_recall FROM (SELECT user_id, night, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy, {_REC}, {_PRE} FROM ev GROUP BY 1, 2)", "ev", REPORT))
def a38_report(spark, sf):
    return evaluate.classification_report(ev(spark, sf), by=NIGHT)


_LONG = "SELECT unnest(['recovery', 'sleep', 'strain']) AS metric, unnest([d.recovery, d.sleep, d.strain]) AS x, unnest([o.recovery, o.sleep, o.strain]) AS y FROM daily d JOIN official o ON o.user_id = d.user_id AND o.date = d.date"


@query("a39_score_errors", sql(f"SELECT metric, count(*) AS n, avg(abs(x - y)) AS mae, sqrt(avg((x - y) * (x - y))) AS rmse, corr(x, y) AS r FROM ({_LONG}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", "official", "mae rmse r"))
def a39(spark, sf):
    return evaluate.score_errors(pairs(spark, sf), ["recovery", "sleep", "strain"])


_SHIFT = "(SELECT user_id, night, 25.0 AS deep, 25.0 AS light, 25.0 AS rem, 25.0 AS awake FROM stage_sum)"


@query("a40_stage_share_error", sql(f"""
    SELECT a.user_id, a.night, 2 * abs(deep_pct - deep) + abs(light_pct - light) + abs(rem_pct - rem) + 1.5 * abs(awake_pct - awake) AS error
    FROM stage_sum a JOIN {_SHIFT} b ON b.user_id = a.user_id AND b.night = a.night""", "stage_sum", "error"))
def a40(spark, sf):
    a = a23(spark, sf)
    even = a.select(*NIGHT, *[F.lit(25.0).alias(f"{s}_pct") for s in ("deep", "light", "rem", "awake")])
    return evaluate.stage_share_error(a, even, weighted=True)


_POS, _NEG = "label = 0", "label <> 0"


@query("a41_roc_auc", sql(f"""
    SELECT (sum(CASE WHEN {_POS} THEN r END) - count(CASE WHEN {_POS} THEN 1 END) * (count(CASE WHEN {_POS} THEN 1 END) + 1) / 2.0) / (count(CASE WHEN {_POS} THEN 1 END) * count(CASE WHEN {_NEG} THEN 1 END)) AS auc
    FROM (SELECT *, (rank() OVER (ORDER BY score) * 2 + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM ev)""", "ev", "auc"))
def a41(spark, sf):
    return order_stats.roc_auc(ev(spark, sf), "score", F.col("label") == 0)


@query("a41_operating_points", sql(f"""
    SELECT h AS negative_recall, t AS threshold, (SELECT avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) FROM ev WHERE {_POS}) AS positive_recall
    FROM (SELECT unnest([0.7, 0.75, 0.8, 0.85]) AS h, unnest((SELECT quantile_cont(score, [0.7, 0.75, 0.8, 0.85]) FROM ev WHERE {_NEG})) AS t)""", "ev", "negative_recall threshold positive_recall"))
def a41_points(spark, sf):
    return order_stats.operating_points(ev(spark, sf), "score", F.col("label") == 0, [0.7, 0.75, 0.8, 0.85])


@query("a41_separation", sql("""
    SELECT feature, (avg(CASE WHEN p THEN x END) - avg(CASE WHEN NOT p THEN x END)) / sqrt((var_pop(CASE WHEN p THEN x END) + var_pop(CASE WHEN NOT p THEN x END)) / 2) AS cohens_d,
      abs((avg(CASE WHEN p THEN x END) - avg(CASE WHEN NOT p THEN x END)) / sqrt((var_pop(CASE WHEN p THEN x END) + var_pop(CASE WHEN NOT p THEN x END)) / 2)) AS strength
    FROM (SELECT l.label = 0 AS p, unnest(['hr_mean', 'hr_std', 'mv_mean']) AS feature, unnest([hr_mean, hr_std, mv_mean]) AS x FROM w_st s JOIN wl l ON l.user_id = s.user_id AND l.night = s.night AND l.win = s.win) GROUP BY 1""", "w_st wl", "cohens_d strength"))
def a41_d(spark, sf):
    return evaluate.separation(window_frame(spark, sf), ["hr_mean", "hr_std", "mv_mean"], F.col("label") == 0)


cte("trans", "wl6", """
    SELECT s.a, s.b, coalesce(t.n, 0) AS n FROM (SELECT a, b FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b)) s
    LEFT JOIN (SELECT a, b, count(*) AS n FROM (SELECT label AS a, lead(label) OVER (PARTITION BY user_id, night ORDER BY win) AS b FROM wl6) WHERE b IS NOT NULL GROUP BY 1, 2) t ON t.a = s.a AND t.b = s.b""")


def short_labels(spark, sf):
    return window_labels(spark, sf, 6)


@query("a42_transition_probabilities", sql("""
    SELECT a, b, n, w / sum(w) OVER (PARTITION BY a) AS p FROM (SELECT *, (n + 0.1) * CASE WHEN a = b AND a = 0 THEN 1.5 WHEN a = b AND a = 1 THEN 1.3 ELSE 1 END AS w FROM trans)""", "trans", "p"))
def a42(spark, sf):
    return evaluate.transition_probabilities(evaluate.transition_counts(short_labels(spark, sf)), 0.1, 1.5, 1.3)


@query("a42_sticky_transitions", sql("""
    SELECT a, b, p, CASE WHEN (a = 2 AND b IN (3, 0)) OR (a = 3 AND b = 2) OR (a = 0 AND b = 2) THEN -20 ELSE ln(greatest(1e-10, p)) END AS log_p FROM (
      SELECT a, b, CASE WHEN a = b THEN boost ELSE q * (1 - boost) / (1 - stay) END AS p FROM (SELECT *, least(0.95, stay * CASE WHEN a = 0 THEN 1.0 ELSE 1.5 END) AS boost FROM (
        SELECT *, max(CASE WHEN a = b THEN q END) OVER (PARTITION BY a) AS stay FROM (SELECT *, (n + 0.1) / sum(n + 0.1) OVER (PARTITION BY a) AS q FROM trans))))""", "trans", "p log_p"))
def a42_sticky(spark, sf):
    return evaluate.sticky_transitions(evaluate.transition_counts(short_labels(spark, sf)))


@query("a43_class_shares", sql("""
    SELECT k, (f + 0.1) / sum(f + 0.1) OVER () AS p_first, n / sum(n) OVER () AS p_all FROM (
      SELECT label AS k, count(*) AS n, count(CASE WHEN win = 0 THEN 1 END) AS f FROM wl6 GROUP BY 1)""", "wl6", "p_first p_all"))
def a43(spark, sf):
    return evaluate.class_shares(short_labels(spark, sf))


_BIN = "greatest(0, least(9, CAST(floor(fraction_of_night * 10) AS INT)))"
cte("prior", "ev", f"""
    SELECT bin, n, {', '.join(f'CASE WHEN n > 20 THEN (n{k} / n) / greatest(sum(n{k}) OVER () / sum(n) OVER (), 1e-6) ELSE 1 END AS r{k}' for k in range(4))}
    FROM (SELECT {_BIN} AS bin, count(*) AS n, {', '.join(f'count(CASE WHEN label = {k} THEN 1 END) AS n{k}' for k in range(4))} FROM ev GROUP BY 1)""")


@query("a44_position_prior", sql("SELECT * FROM prior", "prior", "r0 r1 r2 r3"))
def a44(spark, sf):
    return evaluate.position_prior(ev(spark, sf))


@query("a45_segment_statistics", sql("""
    SELECT label AS k, count(*) AS segments, quantile_cont(length, 0.5) * 2 AS median_min, avg(length) * 2 AS mean_min, quantile_cont(length, 0.9) * 2 AS p90_min, avg(CASE WHEN length = 1 THEN 1.0 ELSE 0.0 END) AS single_share
    FROM wruns GROUP BY 1""", "wruns", "median_min mean_min p90_min single_share"))
def a45(spark, sf):
    return evaluate.segment_statistics(window_labels(spark, sf))


@query("a46_onset_and_waso", sql("""
    SELECT user_id, night, coalesce(any_value(onset), count(*)) * 2.0 AS latency_min, avg(CASE WHEN win >= onset THEN CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END END) AS waso_share,
           sum(CASE WHEN label = 0 AND coalesce(prev <> 0, true) THEN 1 ELSE 0 END) AS awake_segments
    FROM (SELECT *, min(CASE WHEN label <> 0 THEN win END) OVER (PARTITION BY user_id, night) AS onset, lag(label) OVER (PARTITION BY user_id, night ORDER BY win) AS prev FROM wl6) GROUP BY 1, 2""", "wl6", "latency_min waso_share"))
def a46(spark, sf):
    return evaluate.onset_and_waso(short_labels(spark, sf))


@query("a47_timing_predictor", sql(f"""
    SELECT bin, arg_min(label, (-n, label)) AS pred FROM (SELECT {_BIN} AS bin, label, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1""", "ev"))
def a47(spark, sf):
    return evaluate.timing_predictor(ev(spark, sf))


@query("a47_stage_positions", sql("""
    SELECT label AS k, avg(fraction_of_night) AS mean_fraction, quantile_cont(floor(fraction_of_night * 100) / 100, 0.5) AS median_cell FROM ev GROUP BY 1""", "ev", "mean_fraction median_cell"))
def a47_positions(spark, sf):
    return evaluate.stage_positions(ev(spark, sf))


@query("a48_sleep_hours", sql("SELECT user_id, night, round_even(count(CASE WHEN label <> 0 THEN 1 END) * 60 / 3600.0, 2) AS sleep_hours FROM wl6 GROUP BY 1, 2", "wl6", "sleep_hours"))
def a48(spark, sf):
    return evaluate.sleep_hours(short_labels(spark, sf))


@query("a49_night_summary", sql("""
    SELECT user_id, night, avg(hr_std) AS hr_std_mean, stddev_pop(hr_std) AS hr_std_sd, quantile_cont(hr_std, 0.9) AS hr_std_p90, quantile_cont(hr_std, 0.1) AS hr_std_p10,
           avg(gyro_std) AS gyro_std_mean, stddev_pop(gyro_std) AS gyro_std_sd, quantile_cont(gyro_std, 0.9) AS gyro_std_p90, quantile_cont(gyro_std, 0.1) AS gyro_std_p10, count(*) AS n_windows
    FROM w_st GROUP BY 1, 2""", "w_st", "hr_std_mean hr_std_sd hr_std_p90 hr_std_p10 gyro_std_mean gyro_std_sd gyro_std_p90 gyro_std_p10"))
def a49(spark, sf):
    return evaluate.night_summary(window_frame(spark, sf), ["hr_std", "gyro_std"])


# -------------------------------------------------------------------- decoding

TRANS = np.array([[0.70, 0.15, 0.05, 0.10], [0.08, 0.72, 0.12, 0.08], [0.03, 0.17, 0.75, 0.05], [0.06, 0.14, 0.02, 0.78]])
INIT = np.array([0.4, 0.3, 0.2, 0.1])
cte("emit", "w6_st", """
    SELECT user_id, night, win, q0 / t AS p0, q1 / t AS p1, q2 / t AS p2, q3 / t AS p3, least(1.0, hr_mean / 100) AS p_awake, least(1.0, hr_std / 30) AS p_rem,
           win / 32.0 AS fraction_of_night FROM (SELECT *, q0 + q1 + q2 + q3 AS t FROM (
      SELECT user_id, night, win, hr_mean, hr_std, 1 / (1 + abs(hr_mean - 75)) AS q0, 1 / (1 + abs(hr_mean - 66)) AS q1, 1 / (1 + abs(hr_mean - 59)) AS q2, 1 / (1 + abs(hr_mean - 70)) AS q3 FROM w6_st WHERE hr_mean IS NOT NULL))""")


def emissions(spark, sf):
    """Class and gate probabilities from the mean and spread of short windows."""
    w = window_frame(spark, sf, 6).where("hr_mean is not null")
    q = [1 / (1 + F.abs(F.col("hr_mean") - m)) for m in (75, 66, 59, 70)]
    total = q[0] + q[1] + q[2] + q[3]
    return w.select(
        *NIGHT_WIN, "label", *[(x / total).alias(f"p{i}") for i, x in enumerate(q)],
        F.least(F.lit(1.0), F.col("hr_mean") / 100).alias("p_awake"), F.least(F.lit(1.0), F.col("hr_std") / 30).alias("p_rem"),
        (F.col("win") / 32.0).alias("fraction_of_night"),
    )


def viterbi_sql(source: str, trans: np.ndarray, init: np.ndarray, temperature: float) -> str:
    """Forward scores, back pointers and the traced path as two recursions."""
    lt, li = np.log(trans), np.log(init)
    k = len(init)
    reach = lambda j: [f"v{i} + {float(lt[i, j])!r}::DOUBLE" for i in range(k)]
    best = lambda j: f"greatest({', '.join(reach(j))})"
    back = lambda j: "CASE " + " ".join(f"WHEN {r} = {best(j)} THEN {i}" for i, r in enumerate(reach(j))) + " END"
    return f"""
    e AS (SELECT user_id, night, win, row_number() OVER (PARTITION BY user_id, night ORDER BY win) AS i, count(*) OVER (PARTITION BY user_id, night) AS n,
          {', '.join(f'ln(greatest(1e-10, p{j})) / {temperature} AS e{j}' for j in range(k))} FROM {source}),
    fw AS (SELECT user_id, night, win, i, n, {', '.join(f'e{j} + {float(li[j])!r}::DOUBLE AS v{j}' for j in range(k))}, {', '.join(f'0 AS b{j}' for j in range(k))} FROM e WHERE i = 1
           UNION ALL SELECT e.user_id, e.night, e.win, e.i, e.n, {', '.join(f'{best(j)} + e.e{j}' for j in range(k))}, {', '.join(back(j) for j in range(k))}
           FROM fw f JOIN e ON e.user_id = f.user_id AND e.night = f.night AND e.i = f.i + 1),
    tr AS (SELECT user_id, night, win, i, CASE {' '.join(f"WHEN v{j} = greatest({', '.join(f'v{m}' for m in range(k))}) THEN {j}" for j in range(k))} END AS state,
           {', '.join(f'b{j}' for j in range(k))} FROM fw WHERE i = n
           UNION ALL SELECT f.user_id, f.night, f.win, f.i, CASE t.state {' '.join(f'WHEN {j} THEN t.b{j}' for j in range(k))} END, {', '.join(f'f.b{j}' for j in range(k))}
           FROM tr t JOIN fw f ON f.user_id = t.user_id AND f.night = t.night AND f.i = t.i - 1)"""


@query("q7_viterbi", sql("SELECT user_id, night, win, state FROM tr", "emit", recursive=True, extra=viterbi_sql("emit", TRANS, INIT, 0.6)))
def q7(spark, sf):
    return decoding.viterbi(emissions(spark, sf), TRANS, INIT, 0.6)


@query("q8_context_blend", sql("SELECT user_id, night, win, b0 / greatest(b0 + b1 + b2 + b3, 1e-10) AS p0, b1 / greatest(b0 + b1 + b2 + b3, 1e-10) AS p1, b2 / greatest(b0 + b1 + b2 + b3, 1e-10) AS p2, b3 / greatest(b0 + b1 + b2 + b3, 1e-10) AS p3 FROM bl",
    "emit", "p0 p1 p2 p3", recursive=True, extra=f"""
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY win) AS i FROM emit),
    bl AS (SELECT user_id, night, win, i, {', '.join(f'p{k} AS b{k}' for k in range(4))}, {', '.join(f'[p{k}] AS h{k}' for k in range(4))} FROM e WHERE i = 1
           UNION ALL SELECT user_id, night, win, i, {', '.join(f'b{k}' for k in range(4))}, {', '.join(f'list_append(h{k}[-2:], b{k})' for k in range(4))} FROM (
             SELECT e.user_id, e.night, e.win, e.i, {', '.join(f'0.8 * p{k} + 0.2 * list_avg(h{k}) AS b{k}' for k in range(4))}, {', '.join(f'h{k}' for k in range(4))}
             FROM bl JOIN e ON e.user_id = bl.user_id AND e.night = bl.night AND e.i = bl.i + 1))"""))
def q8(spark, sf):
    return decoding.context_blend(emissions(spark, sf))


@query("q9_position_prior", sql(f"""
    SELECT user_id, night, win, {', '.join(f'z{k} / greatest(z0 + z1 + z2 + z3, 1e-10) AS p{k}' for k in range(4))} FROM (
      SELECT e.user_id, e.night, e.win, {', '.join(f'p{k} * pow(coalesce(r{k}, 1), 0.6) AS z{k}' for k in range(4))} FROM emit e LEFT JOIN prior p ON p.bin = {_BIN})""", "emit prior", "p0 p1 p2 p3"))
def q9(spark, sf):
    prior = evaluate.position_prior(ev(spark, sf)).select("bin", *[f"r{k}" for k in range(4)])
    return sequence.apply_position_prior(emissions(spark, sf), prior).select(*NIGHT_WIN, "p0", "p1", "p2", "p3")


@query("q10_gate_blend", sql(f"""
    SELECT user_id, night, win, {', '.join(f'g{k} / greatest(g0 + g1 + g2 + g3, 1e-10) AS p{k}' for k in range(4))} FROM (
      SELECT user_id, night, win, 2.0 * (0.4 * p0 + 0.6 * p_awake) / t AS g0, 0.9 * p1 / t AS g1, p2 / t AS g2, 1.3 * (0.4 * p3 + 0.6 * p_rem) / t AS g3
      FROM (SELECT *, 0.4 * p0 + 0.6 * p_awake + p1 + p2 + 0.4 * p3 + 0.6 * p_rem AS t FROM emit))""", "emit", "p0 p1 p2 p3"))
def q10(spark, sf):
    return sequence.blend_gates(emissions(spark, sf), gain=(2.0, 0.9, 1.0, 1.3)).select(*NIGHT_WIN, "p0", "p1", "p2", "p3")


@query("q13_gate_override", sql("""
    SELECT user_id, night, win, CASE WHEN asleep = 1 AND length <= 1 AND run > 1 AND run < runs THEN 'awake' ELSE phase END AS phase FROM (
      SELECT *, count(*) OVER (PARTITION BY user_id, night, run) AS length, max(run) OVER (PARTITION BY user_id, night) AS runs FROM (
        SELECT *, sum(c) OVER (PARTITION BY user_id, night ORDER BY win) AS run FROM (
          SELECT *, CASE WHEN asleep = lag(asleep) OVER (PARTITION BY user_id, night ORDER BY win) THEN 0 ELSE 1 END AS c FROM (
            SELECT *, CASE WHEN phase <> 'awake' THEN 1 ELSE 0 END AS asleep FROM (
              SELECT e.user_id, e.night, e.win, CASE WHEN p_awake >= 0.68 AND (phase <> 'rem' OR p_awake >= 0.75) THEN 'awake' ELSE phase END AS phase
              FROM emit e JOIN phases p ON p.user_id = e.user_id AND p.night = e.night AND p.win = e.win)))))""", "emit phases"))
def q13(spark, sf):
    joined = emissions(spark, sf).join(phases(spark, sf).select(*NIGHT_WIN, "phase"), NIGHT_WIN)
    return sequence.gate_override(joined, 0.68, 0.75, bridge=1).select(*NIGHT_WIN, "phase")


@query("q15_two_stage", sql("""
    SELECT user_id, night, win, a / t AS p0, b / t AS p1, c / t AS p2, d / t AS p3 FROM (SELECT *, a + b + c + d AS t FROM (
      SELECT user_id, night, win, greatest(p_awake * 1.5, 1e-10) AS a, greatest(p1 * (1 - p_awake), 1e-10) AS b, greatest(p2 * (1 - p_awake), 1e-10) AS c, greatest(p3 * (1 - p_awake), 1e-10) AS d FROM emit))""", "emit", "p0 p1 p2 p3"))
def q15(spark, sf):
    return sequence.two_stage(emissions(spark, sf), "p_awake", ["p1", "p2", "p3"], 1.5).select(*NIGHT_WIN, "p0", "p1", "p2", "p3")


# ---------------------------------------------------------------------- models


def windows(spark, sf):
    return features.windows_of(night_rows(spark, sf), 20, None, 30, 3, sensor_tasks(spark, sf))


def frame_a(spark, sf):
    return features.features_a(windows(spark, sf), tasks=window_tasks(spark, sf))


def frame_b(spark, sf):
    return features.features_b(windows(spark, sf), tasks=window_tasks(spark, sf))


def window_tasks(spark, sf):
    """A window takes twenty rows and has five times the columns, so a task holds those of four times the rows."""
    return sensor_tasks(spark, sf, 4 * SENSOR_ROWS)


_CHECK_A = "hr_trend hr_range hr_masd hr_cv rmssd pnn20 rr_trend mv_zcr mv_burst_count spo2_min delta_hr roll_hr_std roll10_hr_mean prev3_hr cumulative_sleep_hrs hr_mv_interaction"


@query("m1_features_a", sql("""
    SELECT s.user_id, s.night, s.win, CASE WHEN n_hr > 10 THEN hr_slope * n_hr ELSE 0 END AS hr_trend, hr_max - hr_min AS hr_range, hr_masd, hr_std / hr_mean AS hr_cv, CASE WHEN n_rr > 3 AND n_d300 > 2 THEN rmssd300 ELSE 0 END AS rmssd,
      CASE WHEN n_rr > 3 AND n_d300 > 2 THEN 100.0 * n20 / n_d300 ELSE 0 END AS pnn20, CASE WHEN n_rr > 10 THEN rr_slope * n_rr ELSE 0 END AS rr_trend, mv_changes / n_rows AS mv_zcr, mv_bursts AS mv_burst_count, spo2_min,
      hr_mean - coalesce(lag(hr_mean) OVER w, hr_mean) AS delta_hr, CASE WHEN count(*) OVER f3 = 3 THEN stddev_pop(hr_mean) OVER f3 ELSE 0 END AS roll_hr_std, CASE WHEN count(*) OVER f10 = 10 THEN avg(hr_mean) OVER f10 ELSE hr_mean END AS roll10_hr_mean,
      coalesce(lag(hr_mean, 3) OVER w, hr_mean) AS prev3_hr, (row_number() OVER w - 1) / 60.0 AS cumulative_sleep_hrs, (hr_mean - rhr) * mv_mean AS hr_mv_interaction
    FROM w_st s JOIN rest r ON r.user_id = s.user_id AND r.night = s.night
    WINDOW w AS (PARTITION BY s.user_id, s.night ORDER BY win), f3 AS (PARTITION BY s.user_id, s.night ORDER BY win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f10 AS (PARTITION BY s.user_id, s.night ORDER BY win ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "w_st rest", _CHECK_A))
def m1(spark, sf):
    return frame_a(spark, sf).select(*NIGHT_WIN, *_CHECK_A.split())


@query("m1_features_a_all")
def m1_all(spark, sf):
    return frame_a(spark, sf).select(*NIGHT_WIN, *features.FEATURES_A)


_CHECK_B = "hr_iqr rr_mean sd1 sd2 cv roll5_hr_mean roll15_rmssd_mean delta_rr_mean accel_mag_mean gyro_mean gyro_spikes acc_jerk_p95 spo2_std acc_zcr hr_std_zone light_score deep_vs_light not_deep_score probably_light"


@query("m2_features_b", sql("""
    SELECT user_id, night, win, hr_iqr, rr_mean, sd1, sd2, cv, avg(hr_mean) OVER f5 AS roll5_hr_mean, avg(rmssd) OVER f15 AS roll15_rmssd_mean, rr_mean - coalesce(lag(rr_mean) OVER w, rr_mean) AS delta_rr_mean, mag_mean AS accel_mag_mean,
      coalesce(gyro_nz_abs, 0) AS gyro_mean, gyro_spikes, jerk_p95 AS acc_jerk_p95, spo2_std, mag_crossings / n_rows AS acc_zcr, CASE WHEN hr_std < 4 THEN 0 WHEN hr_std <= 7 THEN 1 ELSE 2 END AS hr_std_zone,
      (CASE WHEN pnn50 > 55 THEN 1 ELSE 0 END + CASE WHEN ha > 3 AND ha < 6 THEN 1 ELSE 0 END + CASE WHEN hr_std > 4 AND hr_std < 7 THEN 1 ELSE 0 END + CASE WHEN gyro_spikes > 0.1 AND gyro_spikes < 1 THEN 1 ELSE 0 END) / 4.0 AS light_score,
      hr_std / (rmssd + 1) AS deep_vs_light, (CASE WHEN hr_std > 4 THEN 1 ELSE 0 END + CASE WHEN rmssd > 80 THEN 1 ELSE 0 END + CASE WHEN gyro_spikes > 0.1 THEN 1 ELSE 0 END) / 3.0 AS not_deep_score,
      CASE WHEN ha < 5 AND hr_std > 3.5 AND hr_std < 8 AND rmssd > 80 AND rmssd < 145 THEN 1 ELSE 0 END AS probably_light
    FROM (SELECT s.* EXCLUDE (rr_mean, spo2_std), hr_p75 - hr_p25 AS hr_iqr, CASE WHEN n_rr >= 5 THEN s.rr_mean ELSE 1000 END AS rr_mean, CASE WHEN n_spo2 > 1 THEN s.spo2_std ELSE 0 END AS spo2_std, hr_mean - rhr AS ha,
            CASE WHEN n_rr >= 5 AND n_d300 >= 3 THEN rmssd300 ELSE 0 END AS rmssd, CASE WHEN n_rr >= 5 AND n_d300 >= 3 THEN 100.0 * n50 / n_d300 ELSE 0 END AS pnn50,
            CASE WHEN n_rr >= 5 AND n_d300 >= 3 THEN sd_d300 / sqrt(2) ELSE 0 END AS sd1, CASE WHEN n_rr >= 5 AND n_d300 >= 3 THEN sqrt(greatest(2 * rr_std * rr_std - sd_d300 * sd_d300 / 2, 0.01)) ELSE 0 END AS sd2,
            CASE WHEN n_rr >= 5 THEN rr_std / s.rr_mean ELSE 0 END AS cv FROM w_st s JOIN rest r ON r.user_id = s.user_id AND r.night = s.night)
    WINDOW w AS (PARTITION BY user_id, night ORDER BY win), f5 AS (PARTITION BY user_id, night ORDER BY win ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f15 AS (PARTITION BY user_id, night ORDER BY win ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""",
    "w_st rest", _CHECK_B))
def m2(spark, sf):
    return frame_b(spark, sf).select(*NIGHT_WIN, *_CHECK_B.split())


@query("m2_features_b_all")
def m2_all(spark, sf):
    return frame_b(spark, sf).select(*NIGHT_WIN, *features.FEATURES_B)


@query("m3_augmented_features", sql("""
    SELECT s.user_id, s.night, s.win, acc_z_var, gyro_max, hr_std / (mv_mean + 0.05) AS atonia_score, hr_masd_std, hr_accel_var, hr_std * hr_mean AS hr_var_x_level, coalesce(b.breath_irreg, 0) AS breath_irreg
    FROM w_st s LEFT JOIN (SELECT user_id, night, win, CASE WHEN count(*) > 4 THEN stddev_pop(d_rr) ELSE 0 END AS breath_irreg FROM w_c WHERE rr_ok IS NOT NULL GROUP BY 1, 2, 3) b ON b.user_id = s.user_id AND b.night = s.night AND b.win = s.win""",
    "w_st", "acc_z_var gyro_max atonia_score hr_masd_std hr_accel_var hr_var_x_level breath_irreg", digits=4), digits=4)
def m3(spark, sf):
    f = features.features_extra(features.windows_of(night_rows(spark, sf), 20, tasks=sensor_tasks(spark, sf)), frame_a(spark, sf))
    return f.select(*NIGHT_WIN, "acc_z_var", "gyro_max", "atonia_score", "hr_masd_std", "hr_accel_var", "hr_var_x_level", "breath_irreg")


FOLDS = 3
#: Fold of a night by user and day, the same for all its windows; fold 0 is held out.
FOLD = "((user_id + CAST(substr(night, 9, 2) AS INT)) % 3)"
_TABLES = {}


def fold_of(key="night"):
    return ((F.col("user_id") + F.substring(key, 9, 2).cast("int")) % FOLDS).cast("int")


def training_table(spark, sf):
    """The feature table, written once per application: folds scan it many times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        _TABLES[key] = cut_lineage(frame_a(spark, sf).select(*NIGHT_WIN, "start_ts", "label", *features.FEATURES_A), "features")
    return _TABLES[key]


def train_and_test(spark, sf):
    t = training_table(spark, sf)
    return t.where(fold_of() != 0), t.where(fold_of() == 0)


@query("m5_gates")
def m5(spark, sf):
    train, test = train_and_test(spark, sf)
    gates = [(0, 12.0, "p_awake"), (3, 3.0, "p_rem")]
    fitted = models.side_by_side([lambda k=k, w=w: models.fit_gate(train, features.FEATURES_A, k, w, rounds=3) for k, w, _ in gates])
    areas = [
        order_stats.roc_auc(models.gate_probability(gate, test, features.FEATURES_A, out), out, F.col("label") == k).withColumn("gate", F.lit(out))
        for gate, (k, _, out) in zip(fitted, gates)
    ]
    return areas[0].unionByName(areas[1])


@query("m6_score_regressor")
def m6(spark, sf):
    d = daily_scores(spark, sf).join(
        official_scores(spark, sf).select("user_id", "date", F.col("recovery").alias("target")), ["user_id", "date"]
    ).where("target is not null").withColumn("fold", fold_of("date"))
    names = ["hrv", "rhr", "resp", "sleep", "strain"]
    scored = models.fit_score(d.where("fold != 0"), names, "target", rounds=5).transform(models.finite(d.where("fold = 0"), names))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"))


def oof(spark, sf):
    key = ("oof", spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        t = training_table(spark, sf)
        _TABLES[key] = cut_lineage(
            models.out_of_fold(t, features.FEATURES_A, 2, 5, 2).select(*NIGHT_WIN, "label", "fraction_of_night", "p0", "p1", "p2", "p3", "p_awake", "p_rem", "fold"), "oof"
        )
    return _TABLES[key]


@query("m7_out_of_fold")
def m7(spark, sf):
    return evaluate.classification_report(models.best_class(oof(spark, sf)), by=["fold"])


@query("m8_bake_off")
def m8(spark, sf):
    train, test = train_and_test(spark, sf)
    return models.bake_off_report(models.bake_off(train, test, features.FEATURES_A, 5, 2))


@query("m10_awake_share_regressor")
def m10(spark, sf):
    t = training_table(spark, sf)
    nights = evaluate.night_summary(t, ["hr_std", "gyro_std", "rmssd", "hr_range", "rr_std", "hr_max"])
    share = t.groupBy(*NIGHT).agg(F.avg((F.col("label") == 0).cast("double")).alias("awake_share"))
    d = nights.join(share, NIGHT).withColumn("fold", fold_of())
    names = [c for c in nights.columns if c not in NIGHT]
    scored = models.fit_score(d.where("fold != 0"), names, "awake_share", rounds=3).transform(models.finite(d.where("fold = 0"), names))
    return scored.select(*NIGHT, F.greatest(F.lit(0.0), F.col("prediction")).alias("awake_target"))


@query("m11_importance")
def m11(spark, sf):
    train, test = train_and_test(spark, sf)
    model = models.fit_stages(train, features.FEATURES_A, 5)
    return models.impurity_importance(model, features.FEATURES_A, spark).join(
        models.permutation_importance(model, test, features.FEATURES_A).withColumnRenamed("importance", "accuracy_loss"), "feature"
    )


def report_sql(by: str, source: str) -> str:
    """The classification report of rows with label and pred."""
    ratio = lambda hit, n: f"CASE WHEN count(CASE WHEN {n} THEN 1 END) > 0 THEN count(CASE WHEN {hit} THEN 1 END) / count(CASE WHEN {n} THEN 1 END) ELSE 0 END"
    recall = [ratio(f"label = {k} AND pred = {k}", f"label = {k}") for k in range(4)]
    return f"""SELECT {by}, count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy, {', '.join(f'{r} AS recall_{k}' for k, r in enumerate(recall))},
      {', '.join(f'{ratio(f"label = {k} AND pred = {k}", f"pred = {k}")} AS precision_{k}' for k in range(4))}, least({', '.join(recall)}) AS min_recall FROM ({source}) GROUP BY {by}"""


_BEST = "CASE WHEN {0} >= greatest({1}, {2}, {3}) THEN 0 WHEN {1} >= greatest({2}, {3}) THEN 1 WHEN {2} >= {3} THEN 2 ELSE 3 END"
_REPORT = "accuracy recall_0 recall_1 recall_2 recall_3 precision_0 precision_1 precision_2 precision_3 min_recall"
_LABELLED = "(SELECT e.*, l.label FROM emit e JOIN wl6 l ON l.user_id = e.user_id AND l.night = e.night AND l.win = e.win)"


@query("m12_threshold_sweep", sql(report_sql("tau, protect", f"""
    SELECT tau, protect, label, CASE WHEN p_awake >= tau AND (best <> 3 OR p_awake >= protect) THEN 0 ELSE best END AS pred
    FROM (SELECT *, {_BEST.format('p0', 'p1', 'p2', 'p3')} AS best FROM {_LABELLED}), (SELECT unnest([0.6E0, 0.66E0, 0.7E0]) AS tau), (SELECT unnest([0.65E0, 0.75E0]) AS protect)"""), "emit wl6", "tau protect " + _REPORT))
def m12(spark, sf):
    return models.threshold_sweep(emissions(spark, sf), [0.6, 0.66, 0.7], [0.65, 0.75])


@query("m12_gain_sweep", sql(report_sql("g0, g1, g2, g3", f"""
    SELECT g0, 1.0E0 AS g1, 1.0E0 AS g2, g3, label, {_BEST.format('p0 * g0', 'p1', 'p2', 'p3 * g3')} AS pred
    FROM {_LABELLED}, (SELECT unnest([1.0E0, 2.0E0, 3.0E0]) AS g0), (SELECT unnest([1.0E0, 1.5E0]) AS g3)"""), "emit wl6", "g0 g1 g2 g3 " + _REPORT))
def m12_gain(spark, sf):
    return models.gain_sweep(emissions(spark, sf), [{"g0": a, "g1": 1.0, "g2": 1.0, "g3": r} for a in (1, 2, 3) for r in (1, 1.5)])


@query("m12_score_sweep", sql("""
    SELECT w_hrv, 0.43 AS w_rhr, 0.33 AS w_sleep, 0.14 AS w_resp, 11.6 AS slope, 1.107 AS center, rhr_scale, avg(abs(score - o)) AS mae FROM (
      SELECT w_hrv, rhr_scale, o, greatest(0, least(100, round_even(w_hrv / t * 100 / (1 + exp(-11.6E0 * (hrv / 90 - 1.107E0))) + 0.43E0 / t * greatest(0, least(100, 50 + (55 - rhr) * rhr_scale)) + 0.33E0 / t * least(100, sleep) + 0.14E0 / t * (100 - greatest(0, (resp - 16) * 3)), 0))) AS score
      FROM (SELECT d.*, off.recovery AS o, w_hrv, rhr_scale, w_hrv + 0.43E0 + 0.33E0 + 0.14E0 AS t FROM daily d JOIN official off ON off.user_id = d.user_id AND off.date = d.date, (SELECT unnest([0.09E0, 0.3E0]) AS w_hrv), (SELECT unnest([6.0E0, 8.1E0]) AS rhr_scale) WHERE off.recovery IS NOT NULL)) GROUP BY 1, 7""",
    "official", "w_hrv w_rhr w_sleep w_resp slope center rhr_scale mae", digits=3), digits=3)
def m12_score(spark, sf):
    d = daily_scores(spark, sf).join(
        official_scores(spark, sf).select("user_id", "date", F.col("recovery").alias("official_recovery")), ["user_id", "date"]
    ).where("official_recovery is not null")
    grid = [
        {"w_hrv": h, "w_rhr": 0.43, "w_sleep": 0.33, "w_resp": 0.14, "slope": 11.6, "center": 1.107, "rhr_scale": s}
        for h in (0.09, 0.3) for s in (6.0, 8.1)
    ]
    return models.score_sweep(d, grid)


@query("m13_awake_before_sleep", sql("""
    SELECT s.user_id, b.night, count(*) AS n_rows, min(s.ts) AS first_ts, 0 AS label FROM sensor s JOIN (SELECT user_id, night, min(ts) AS start_ts FROM night GROUP BY 1, 2) b
      ON b.user_id = s.user_id AND s.ts >= b.start_ts - 7200 AND s.ts < b.start_ts GROUP BY 1, 2""", "night"))
def m13(spark, sf):
    before = features.awake_before_sleep(sensor(spark, sf), night_bounds(night_rows(spark, sf)), 7200)
    return before.groupBy(*NIGHT).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("label").alias("label")
    )
