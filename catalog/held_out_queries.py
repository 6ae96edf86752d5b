"""Held-out decoding and night-wise validation (M7, M12, M14, Q11, Q12, Q14), parameters learned per fold."""

from pyspark.sql import functions as F

from catalog.base import cte, query, sql
from catalog.model_queries import _CHECK_A, FOLD, FOLDS, emissions, fold_of, frame_a, train_and_test, training_table, windows
from catalog.stage_queries import smooth_sql
from nocturne.functions.scalars import stage_name
from nocturne.operators import decoding, evaluate, sequence
from nocturne.operators.nights import NIGHT
from nocturne.operators.window_stats import NIGHT_WIN
from nocturne.plans import features, held_out, models
from nocturne.session import cut_lineage, work_folder

KEYS = "user_id, night"
_SAVED = {}


def folded(spark, sf):
    """Class and gate probabilities of short windows, labelled, with the decoder tables of the other folds."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        _SAVED[key] = cut_lineage(emissions(spark, sf).withColumn("fold", fold_of()), "emissions")
    return held_out.with_fold_tables(_SAVED[key])


# ------------------------------------------------------------------ SQL of the tables per fold

cte("ef", "emit wl6", f"""
    SELECT e.*, l.label, CAST({FOLD.replace('user_id', 'e.user_id').replace('night', 'e.night')} AS INT) AS fold, greatest(0, least(9, CAST(floor(fraction_of_night * 10) AS INT))) AS bin
    FROM emit e JOIN wl6 l ON l.user_id = e.user_id AND l.night = e.night AND l.win = e.win""")
cte("folds", "ef", "SELECT DISTINCT fold FROM ef")
cte("held_k", "ef folds", """
    SELECT f.fold, k, count(e.label) AS n FROM folds f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) LEFT JOIN ef e ON e.fold <> f.fold AND e.label = k GROUP BY 1, 2""")
cte("held_prior", "ef folds held_k", """
    SELECT fold, bin, k, CASE WHEN sum(n) OVER (PARTITION BY fold, bin) > 20 THEN n / sum(n) OVER (PARTITION BY fold, bin) / greatest(share, 1e-6) ELSE 1 END AS r FROM (
      SELECT f.fold, b.bin, s.k, any_value(s.share) AS share, count(e.label) AS n FROM folds f CROSS JOIN (SELECT unnest(range(10)) AS bin) b
      JOIN (SELECT fold, k, n / greatest(sum(n) OVER (PARTITION BY fold), 1) AS share FROM held_k) s ON s.fold = f.fold
      LEFT JOIN ef e ON e.fold <> f.fold AND e.label = s.k AND e.bin = b.bin GROUP BY 1, 2, 3)""")


def fold_tables(name: str, classes: tuple, most: float, gain: float) -> None:
    """Sticky log transitions and log class shares of the other folds, one row per fold."""
    inside = ", ".join(map(str, classes))
    apart = "(a = 2 AND b IN (0, 3)) OR (a = 3 AND b = 2) OR (a = 0 AND b = 2)" if len(classes) > 2 else "false"
    cte(f"lt_{name}", "ef folds held_k", f"""
      SELECT t.fold, {', '.join(f'max(CASE WHEN a = {i} AND b = {j} THEN lt END) AS t{x}{y}' for x, i in enumerate(classes) for y, j in enumerate(classes))},
             {', '.join(f'any_value(s{x}) AS s{x}' for x in range(len(classes)))}
      FROM (SELECT fold, a, b, CASE WHEN {apart} THEN -20 ELSE ln(greatest(1e-10, least(1.0, CASE WHEN a = b THEN kept ELSE q * (1 - kept) / (1 - stay) END))) END AS lt FROM (
          SELECT *, least({most}, stay * CASE WHEN a = 0 THEN 1.0 ELSE {gain} END) AS kept FROM (
            SELECT *, max(CASE WHEN a = b THEN q END) OVER (PARTITION BY fold, a) AS stay FROM (
              SELECT fold, a, b, (n + 0.1) / sum(n + 0.1) OVER (PARTITION BY fold, a) AS q FROM (
                SELECT f.fold, x.a, y.b, count(p.fold) AS n FROM folds f CROSS JOIN (SELECT unnest([{inside}]) AS a) x CROSS JOIN (SELECT unnest([{inside}]) AS b) y
                LEFT JOIN (SELECT fold, lag(label) OVER (PARTITION BY {KEYS} ORDER BY win) AS a, label AS b FROM ef WHERE label IN ({inside})) p ON p.fold <> f.fold AND p.a = x.a AND p.b = y.b
                GROUP BY 1, 2, 3))))) t
      JOIN (SELECT fold, {', '.join(f'ln(greatest(1e-10, sum(CASE WHEN k = {i} THEN n END) / greatest(sum(n), 1))) AS s{x}' for x, i in enumerate(classes))} FROM held_k WHERE k IN ({inside}) GROUP BY 1) s ON s.fold = t.fold
      GROUP BY 1""")


fold_tables("ld", *held_out.LIGHT_DEEP)
fold_tables("ldr", *held_out.ASLEEP)
fold_tables("all", *held_out.EVERY)


# ------------------------------------------------------------------ SQL of blend, path and floors


def blend_sql(name: str, source: str, k: int) -> str:
    """``source`` has keys, win, p0..; gives ``name`` with i (from 1), n and the blended shares p0.."""
    cols = range(k)
    total = " + ".join(f"b{j}" for j in cols)
    return f"""
    {name}_i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY win) AS i, count(*) OVER (PARTITION BY {KEYS}) AS n FROM {source}),
    {name}_b AS (SELECT {KEYS}, win, i, n, {', '.join(f'p{j} AS b{j}' for j in cols)}, {', '.join(f'[p{j}] AS h{j}' for j in cols)} FROM {name}_i WHERE i = 1
      UNION ALL SELECT {KEYS}, win, i, n, {', '.join(f'b{j}' for j in cols)}, {', '.join(f'list_append(h{j}[-2:], b{j})' for j in cols)} FROM (
        SELECT e.user_id, e.night, e.win, e.i, e.n, {', '.join(f'0.8 * p{j} + 0.2 * list_avg(h{j}) AS b{j}' for j in cols)}, {', '.join(f'h{j}' for j in cols)}
        FROM {name}_b f JOIN {name}_i e ON e.user_id = f.user_id AND e.night = f.night AND e.i = f.i + 1)),
    {name} AS MATERIALIZED (SELECT {KEYS}, win, i, n, {', '.join(f'b{j} / greatest({total}, 1e-10) AS p{j}' for j in cols)} FROM {name}_b)"""


def path_sql(name: str, source: str, tables: str, k: int, on: str = "fold") -> str:
    """Best paths through ``source`` (a blend) with the log transitions t.. and starts s.. of ``tables``."""
    cols = range(k)
    reach = lambda j: [f"v{m} + e.t{m}{j}" for m in cols]
    best = lambda j: f"greatest({', '.join(reach(j))})"
    back = lambda j: "CASE " + " ".join(f"WHEN {r} = {best(j)} THEN {m}" for m, r in enumerate(reach(j))) + " END"
    last = " ".join(f"WHEN v{j} = greatest({', '.join(f'v{m}' for m in cols)}) THEN {j}" for j in cols)
    match = f"l.fold = {FOLD.replace('user_id', 'b.user_id').replace('night', 'b.night')}" if on == "fold" else "l.user_id = b.user_id AND l.night = b.night"
    return f"""
    {name}_e AS MATERIALIZED (SELECT b.user_id, b.night, b.win, b.i, b.n, {', '.join(f'ln(greatest(1e-10, least(1.0, b.p{j}))) AS e{j}' for j in cols)}, l.* EXCLUDE ({'fold' if on == 'fold' else KEYS}) FROM {source} b JOIN {tables} l ON {match}),
    {name}_f AS (SELECT {KEYS}, win, i, n, {', '.join(f'e{j} + s{j} AS v{j}' for j in cols)}, {', '.join(f'0 AS b{j}' for j in cols)} FROM {name}_e WHERE i = 1
      UNION ALL SELECT e.user_id, e.night, e.win, e.i, e.n, {', '.join(f'{best(j)} + e.e{j}' for j in cols)}, {', '.join(back(j) for j in cols)}
      FROM {name}_f f JOIN {name}_e e ON e.user_id = f.user_id AND e.night = f.night AND e.i = f.i + 1),
    {name}_m AS MATERIALIZED (SELECT * FROM {name}_f),
    {name} AS (SELECT {KEYS}, win, i, CASE {last} END AS state, {', '.join(f'b{j}' for j in cols)} FROM {name}_m WHERE i = n
      UNION ALL SELECT f.user_id, f.night, f.win, f.i, CASE t.state {' '.join(f'WHEN {j} THEN t.b{j}' for j in cols)} END, {', '.join(f'f.b{j}' for j in cols)}
      FROM {name} t JOIN {name}_m f ON f.user_id = t.user_id AND f.night = t.night AND f.i = t.i - 1)"""


def floor_sql(name: str, source: str, state: int, least: int, agree: bool) -> str:
    """Runs of ``state`` shorter than ``least`` take the run before, or with ``agree`` light unless both sides agree."""
    new = "CASE WHEN coalesce(bef, 1) = coalesce(aft, 1) THEN coalesce(bef, 1) ELSE 1 END" if agree else "coalesce(bef, 1)"
    return f"""
    {name}_n AS (SELECT {KEYS}, win, state, sum(c) OVER (PARTITION BY {KEYS} ORDER BY win) AS run FROM (
      SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY {KEYS} ORDER BY win) THEN 0 ELSE 1 END AS c FROM {source})),
    {name}_r AS (SELECT *, lag(state) OVER w AS bef, lead(state) OVER w AS aft FROM (SELECT {KEYS}, run, any_value(state) AS state, count(*) AS length FROM {name}_n GROUP BY ALL) WINDOW w AS (PARTITION BY {KEYS} ORDER BY run)),
    {name} AS MATERIALIZED (SELECT n.user_id, n.night, n.win, CASE WHEN r.state = {state} AND r.length < {least} THEN {new} ELSE n.state END AS state
      FROM {name}_n n JOIN {name}_r r ON r.user_id = n.user_id AND r.night = n.night AND r.run = n.run)"""


def weighted(classes: tuple, values: list[str], source: str) -> str:
    """Shares of ``values`` times the prior of the window's bin to the power 0.6, as shares."""
    k = range(len(classes))
    total = " + ".join(f"y{j}" for j in k)
    priors = " ".join(f"JOIN held_prior r{j} ON r{j}.fold = e.fold AND r{j}.bin = e.bin AND r{j}.k = {c}" for j, c in enumerate(classes))
    shared = f"SELECT *, {', '.join(f'x{j} / greatest({' + '.join(f'x{m}' for m in k)}, 1e-10) AS z{j}' for j in k)} FROM (SELECT *, {', '.join(f'{v} AS x{j}' for j, v in enumerate(values))} FROM {source})"
    return f"""SELECT {KEYS}, win, {', '.join(f'y{j} / greatest({total}, 1e-10) AS p{j}' for j in k)} FROM (
      SELECT e.user_id, e.night, e.win, {', '.join(f'z{j} * pow(r{j}.r, 0.6) AS y{j}' for j in k)} FROM ({shared}) e {priors})"""


_FLOORS = lambda agree, source: floor_sql("f1", source, 2, 4, agree) + "," + floor_sql("f2", "f1", 3, 3, agree)


@query("q11_cascade_decode", sql("SELECT user_id, night, win, state FROM f2", "ef lt_ld held_prior", recursive=True, extra=f"""
    open AS MATERIALIZED ({weighted((1, 2), ['p1', 'p2'], '(SELECT * FROM ef WHERE p_awake < 0.7 AND p_rem < 0.5)')}),
    {blend_sql('bl', 'open', 2)}, {path_sql('pa', 'bl', 'lt_ld', 2)},
    gated AS (SELECT {KEYS}, win, CASE WHEN p_awake >= 0.7 THEN 0 ELSE 3 END AS state FROM ef WHERE p_awake >= 0.7 OR p_rem >= 0.5 UNION ALL SELECT {KEYS}, win, state + 1 FROM pa),
    {_FLOORS(False, 'gated')}"""))
def q11(spark, sf):
    return decoding.cascade_decode(folded(spark, sf), 0.7, 0.5, "prior", "ld_trans", "ld_start")


@query("q12_hierarchical_decode", sql("""
    SELECT e.user_id, e.night, e.win, CASE WHEN p_awake >= 0.7 THEN 0 ELSE state END AS state FROM ef e JOIN f2 f ON f.user_id = e.user_id AND f.night = e.night AND f.win = e.win""",
    "ef lt_ldr held_prior", recursive=True, extra=f"""
    post AS MATERIALIZED ({weighted((1, 2, 3), ['p1', 'p2', '0.4 * p3 + 0.6 * p_rem'], 'ef')}),
    {blend_sql('bl', 'post', 3)}, {path_sql('pa', 'bl', 'lt_ldr', 3)},
    stages AS (SELECT {KEYS}, win, state + 1 AS state FROM pa), {_FLOORS(True, 'stages')}"""))
def q12(spark, sf):
    return decoding.hierarchical_decode(folded(spark, sf), 0.7, "prior", "ldr_trans", "ldr_start")


def _posterior(source: str) -> str:
    """The gated posterior times the prior, not yet shares, as q0.."""
    total = "(0.4 * p0 + 0.6 * p_awake + p1 + p2 + 0.4 * p3 + 0.6 * p_rem)"
    values = ["0.4 * p0 + 0.6 * p_awake", "p1", "p2", "0.4 * p3 + 0.6 * p_rem"]
    priors = " ".join(f"JOIN held_prior r{k} ON r{k}.fold = e.fold AND r{k}.bin = e.bin AND r{k}.k = {k}" for k in range(4))
    return f"SELECT e.user_id, e.night, e.win, {', '.join(f'({v}) / greatest({total}, 1e-10) * pow(r{k}.r, 0.6) AS q{k}' for k, v in enumerate(values))} FROM {source} e {priors}"


def quota_sql(steps: int) -> str:
    """The bisection written out: each step decodes the nights that still search."""
    out = [f"post AS MATERIALIZED ({_posterior('ef')})", f"n0 AS MATERIALIZED (SELECT {KEYS}, ln(0.3) AS lo, ln(40.0) AS hi, 0.25 AS goal FROM ef GROUP BY ALL)"]
    for s in range(1, steps + 1):
        t = f"(q0 * exp((lo + hi) / 2) + q1 * 0.8 + q2 + q3)"
        out.append(f"""g{s} AS MATERIALIZED (SELECT p.user_id, p.night, p.win, q0 * exp((lo + hi) / 2) / greatest({t}, 1e-10) AS p0, q1 * 0.8 / greatest({t}, 1e-10) AS p1, q2 / greatest({t}, 1e-10) AS p2, q3 / greatest({t}, 1e-10) AS p3
            FROM post p JOIN n{s - 1} n ON n.user_id = p.user_id AND n.night = p.night)""")
        out += [blend_sql(f"bl{s}", f"g{s}", 4), path_sql(f"pa{s}", f"bl{s}", "lt_all", 4), floor_sql(f"fa{s}", f"pa{s}", 2, 4, True), floor_sql(f"fb{s}", f"fa{s}", 3, 3, True)]
        out.append(f"""c{s} AS MATERIALIZED (SELECT n.*, avg(CASE WHEN state = 0 THEN 1.0 ELSE 0.0 END) AS share FROM fb{s} f JOIN n{s - 1} n ON n.user_id = f.user_id AND n.night = f.night GROUP BY ALL)""")
        out.append(f"""n{s} AS MATERIALIZED (SELECT {KEYS}, CASE WHEN share < goal THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN share < goal THEN hi ELSE (lo + hi) / 2 END AS hi, goal FROM c{s} WHERE abs(share - goal) >= 0.01)""")
    done = [f"SELECT f.user_id, f.night, f.win, f.state FROM fb{s} f" + (f" ANTI JOIN n{s} n ON n.user_id = f.user_id AND n.night = f.night" if s < steps else "") for s in range(1, steps + 1)]
    return ", ".join(out) + f", decoded AS ({' UNION ALL '.join(done)})"


@query("q14_quota_decode", sql("SELECT user_id, night, win, state FROM decoded", "ef lt_all held_prior", recursive=True, extra=quota_sql(decoding.QUOTA_STEPS)))
def q14(spark, sf):
    return decoding.quota_decode(folded(spark, sf).withColumn("awake_target", F.lit(0.25)), "prior", "all_trans", "all_start")


# ------------------------------------------------------------------ leave one night out


_FEATURES = _CHECK_A.split()
_COLS = ", ".join(f"coalesce({f}, 0) AS {f}" for f in _FEATURES)
cte("lo", "w_st rest wl position", f"""
    SELECT f.user_id, f.night, f.win, l.label, p.fraction_of_night, {', '.join(f'f.{f}' for f in _FEATURES)} FROM (
      SELECT s.user_id, s.night, s.win, CASE WHEN n_hr > 10 THEN hr_slope * n_hr ELSE 0 END AS hr_trend, hr_max - hr_min AS hr_range, hr_masd, hr_std / hr_mean AS hr_cv, CASE WHEN n_rr > 3 AND n_d300 > 2 THEN rmssd300 ELSE 0 END AS rmssd,
        CASE WHEN n_rr > 3 AND n_d300 > 2 THEN 100.0 * n20 / n_d300 ELSE 0 END AS pnn20, CASE WHEN n_rr > 10 THEN rr_slope * n_rr ELSE 0 END AS rr_trend, mv_changes / n_rows AS mv_zcr, mv_bursts AS mv_burst_count, spo2_min,
        hr_mean - coalesce(lag(hr_mean) OVER w, hr_mean) AS delta_hr, CASE WHEN count(*) OVER f3 = 3 THEN stddev_pop(hr_mean) OVER f3 ELSE 0 END AS roll_hr_std, CASE WHEN count(*) OVER f10 = 10 THEN avg(hr_mean) OVER f10 ELSE hr_mean END AS roll10_hr_mean,
        coalesce(lag(hr_mean, 3) OVER w, hr_mean) AS prev3_hr, (row_number() OVER w - 1) / 60.0 AS cumulative_sleep_hrs, (hr_mean - rhr) * mv_mean AS hr_mv_interaction
      FROM w_st s JOIN rest r ON r.user_id = s.user_id AND r.night = s.night
      WINDOW w AS (PARTITION BY s.user_id, s.night ORDER BY win), f3 AS (PARTITION BY s.user_id, s.night ORDER BY win ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), f10 AS (PARTITION BY s.user_id, s.night ORDER BY win ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) f
    JOIN wl l ON l.user_id = f.user_id AND l.night = f.night AND l.win = f.win JOIN position p ON p.user_id = f.user_id AND p.night = f.night AND p.win = f.win""")
cte("lo_x", "lo", f"SELECT * FROM (SELECT {KEYS}, win, label, {', '.join(f'CAST(coalesce({f}, 0) AS DOUBLE) AS {f}' for f in _FEATURES)} FROM lo) UNPIVOT (x FOR f IN ({', '.join(_FEATURES)}))")
cte("lo_nights", "lo", f"SELECT DISTINCT {KEYS} FROM lo")
cte("lo_m", "lo_x lo_nights", f"""
    SELECT t.user_id, t.night, t.f, t.k, t.n - coalesce(o.n, 0) AS n, t.s - coalesce(o.s, 0) AS s, t.q - coalesce(o.q, 0) AS q FROM (
      SELECT * FROM lo_nights CROSS JOIN (SELECT f, label AS k, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lo_x GROUP BY 1, 2)) t
    LEFT JOIN (SELECT {KEYS}, f, label AS k, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM lo_x GROUP BY 1, 2, 3, 4) o ON o.user_id = t.user_id AND o.night = t.night AND o.f = t.f AND o.k = t.k""")
cte("lo_fit", "lo_m", """
    SELECT user_id, night, f, k, n / all_n AS share, m, greatest(q / n - m * m, 0) + 1e-3 * greatest(all_q / all_n - (all_s / all_n) * (all_s / all_n), 0) + 1e-9 AS v FROM (
      SELECT *, s / n AS m, sum(n) OVER g AS all_n, sum(s) OVER g AS all_s, sum(q) OVER g AS all_q FROM lo_m WINDOW g AS (PARTITION BY user_id, night, f)) WHERE n > 0""")
cte("lo_p", "lo_x lo_fit", """
    SELECT user_id, night, win, any_value(label) AS label, {0} FROM (
      SELECT *, exp(l - max(l) OVER (PARTITION BY user_id, night, win)) AS e FROM (
        SELECT x.user_id, x.night, x.win, k, any_value(label) AS label, ln(any_value(share)) - 0.5 * sum(ln(v) + (x - m) * (x - m) / v) AS l
        FROM lo_x x JOIN lo_fit p ON p.user_id = x.user_id AND p.night = x.night AND p.f = x.f GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3""".format(
    ", ".join(f"coalesce(sum(CASE WHEN k = {k} THEN e END), 0) / sum(e) AS p{k}" for k in range(4))))
cte("lo_pairs", "lo", f"SELECT {KEYS}, label AS b, lag(label) OVER (PARTITION BY {KEYS} ORDER BY win) AS a, row_number() OVER (PARTITION BY {KEYS} ORDER BY win) AS i FROM lo")
cte("lo_tables", "lo_pairs lo_nights", f"""
    SELECT {KEYS}, {', '.join(f't{i}{j}' for i in range(4) for j in range(4))}, {', '.join(f's{k}' for k in range(4))} FROM (
      SELECT {KEYS}, {', '.join(f'ln((c{i}{j} + 0.1) / ({" + ".join(f"c{i}{m}" for m in range(4))} + 0.4)) AS t{i}{j}' for i in range(4) for j in range(4))},
             {', '.join(f'ln((f{k} + 0.1) / (f0 + f1 + f2 + f3 + 0.4)) AS s{k}' for k in range(4))} FROM (
        SELECT n.user_id, n.night, {', '.join(f'any_value(t.c{i}{j}) - sum(CASE WHEN a = {i} AND b = {j} THEN 1 ELSE 0 END) AS c{i}{j}' for i in range(4) for j in range(4))},
               {', '.join(f'any_value(t.f{k}) - sum(CASE WHEN i = 1 AND b = {k} THEN 1 ELSE 0 END) AS f{k}' for k in range(4))}
        FROM lo_nights n JOIN lo_pairs p ON p.user_id = n.user_id AND p.night = n.night CROSS JOIN (
          SELECT {', '.join(f'sum(CASE WHEN a = {i} AND b = {j} THEN 1 ELSE 0 END) AS c{i}{j}' for i in range(4) for j in range(4))}, {', '.join(f'sum(CASE WHEN i = 1 AND b = {k} THEN 1 ELSE 0 END) AS f{k}' for k in range(4))} FROM lo_pairs) t
        GROUP BY 1, 2))""")


def lono_report(scored):
    """Accuracy per night of the smoothed best classes and of the Viterbi paths, which all read the scores once written."""
    scored = cut_lineage(scored.select(*NIGHT_WIN, "label", "p0", "p1", "p2", "p3", "trans", "start"), "scored")
    raw = models.best_class(scored)
    smooth = sequence.smooth_isolated(raw.select(*NIGHT_WIN, "pred"), "pred", agree=True)
    paths = decoding.viterbi(scored, "trans", "start")
    return held_out.night_report(scored.select(*NIGHT_WIN, "label").join(smooth, NIGHT_WIN), paths)


@query("m7_leave_one_night_out", sql(f"""
    SELECT s.user_id, s.night, count(*) AS n, avg(CASE WHEN phase = label THEN 1.0 ELSE 0.0 END) AS raw_accuracy, avg(CASE WHEN state = label THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM smooth s JOIN lo_p o ON o.user_id = s.user_id AND o.night = s.night AND o.win = s.win JOIN pa p ON p.user_id = s.user_id AND p.night = s.night AND p.win = s.win GROUP BY 1, 2""",
    "lo_p lo_tables", "raw_accuracy accuracy", recursive=True, extra=f"""
    pm AS MATERIALIZED (SELECT {KEYS}, win, p0, p1, p2, p3, row_number() OVER (PARTITION BY {KEYS} ORDER BY win) AS i, count(*) OVER (PARTITION BY {KEYS}) AS n FROM lo_p),
    {path_sql('pa', 'pm', 'lo_tables', 4, 'night')},
    """ + smooth_sql("SELECT user_id, night, win, CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS phase FROM pm", True)))
def m7_lono(spark, sf):
    return lono_report(held_out.leave_one_night_out(training_table(spark, sf), _FEATURES))


@query("m7_leave_one_night_out_all")
def m7_lono_all(spark, sf):
    return lono_report(held_out.leave_one_night_out(training_table(spark, sf), features.FEATURES_A))


@query("m12_gain_search")
def m12_search(spark, sf):
    gains, steps = held_out.tune_gains(folded(spark, sf), {0: [1, 2, 4], 3: [1, 1.5], 1: [0.8, 1], 2: [1, 1.3]}, [0, 3, 1, 2], 2)
    return spark.createDataFrame(
        [(i, s["class"], float(s["score"]), *[s[f"g{k}"] for k in range(4)]) for i, s in enumerate(steps)], "step int, tuned int, score double, g0 double, g1 double, g2 double, g3 double"
    )


# ------------------------------------------------------------------ a night as deployed


@query("m14_deployed_stages", sql(f"""
    SELECT user_id, night, win, CASE WHEN asleep = 1 AND length <= 2 AND run > 1 AND run < runs THEN 'awake' ELSE phase END AS phase FROM (
      SELECT *, count(*) OVER (PARTITION BY {KEYS}, run) AS length, max(run) OVER (PARTITION BY {KEYS}) AS runs FROM (
        SELECT *, sum(c) OVER (PARTITION BY {KEYS} ORDER BY win) AS run FROM (
          SELECT *, CASE WHEN asleep = lag(asleep) OVER (PARTITION BY {KEYS} ORDER BY win) THEN 0 ELSE 1 END AS c FROM (
            SELECT *, CASE WHEN phase <> 'awake' THEN 1 ELSE 0 END AS asleep FROM (
              SELECT e.user_id, e.night, e.win, CASE WHEN p_awake >= 0.68 AND (phase <> 'rem' OR p_awake >= 0.75) THEN 'awake' ELSE phase END AS phase
              FROM ef e JOIN ruled p ON p.user_id = e.user_id AND p.night = e.night AND p.win = e.win)))))""", "ef folds", recursive=True, extra=f"""
    {blend_sql('bl', 'ef', 4)},
    tp AS (SELECT fold, a, b, ln((n + 0.1) / sum(n + 0.1) OVER (PARTITION BY fold, a)) AS lt FROM (
      SELECT f.fold, x.a, y.b, count(p.fold) AS n FROM folds f CROSS JOIN (SELECT unnest(range(4)) AS a) x CROSS JOIN (SELECT unnest(range(4)) AS b) y
      LEFT JOIN (SELECT fold, lag(label) OVER (PARTITION BY {KEYS} ORDER BY win) AS a, label AS b FROM ef) p ON p.fold <> f.fold AND p.a = x.a AND p.b = y.b GROUP BY 1, 2, 3)),
    night_tables AS MATERIALIZED (SELECT b.user_id, b.night, {', '.join(f'ln(greatest(1e-10, any_value(b.m{k}))) AS s{k}' for k in range(4))}, {', '.join(f'max(CASE WHEN a = {i} AND b.b = {j} THEN lt END) AS t{i}{j}' for i in range(4) for j in range(4))}
      FROM (SELECT m.*, tp.a, tp.b, tp.lt FROM (SELECT {KEYS}, {', '.join(f'avg(p{k}) AS m{k}' for k in range(4))} FROM bl GROUP BY ALL) m JOIN tp ON tp.fold = {FOLD.replace('user_id', 'm.user_id').replace('night', 'm.night')}) b GROUP BY 1, 2),
    {path_sql('pa', 'bl', 'night_tables', 4, 'night')},
    """ + smooth_sql(f"""SELECT {KEYS}, win, CASE WHEN state = 3 AND win * 0.5 < 1.0 AND count(*) OVER (PARTITION BY {KEYS}) >= 3 THEN 'light' ELSE ['awake', 'light', 'deep', 'rem'][state + 1] END AS phase FROM pa""", True) + f""",
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY {KEYS} ORDER BY win) AS run FROM (
      SELECT {KEYS}, win, phase, CASE WHEN phase = lag(phase) OVER (PARTITION BY {KEYS} ORDER BY win) THEN 0 ELSE 1 END AS c FROM smooth)),
    ruled AS MATERIALIZED (SELECT {KEYS}, win, CASE WHEN phase = 'awake' AND length <= 2 AND run > 1 AND run < runs AND total >= 3 THEN 'light' ELSE phase END AS phase FROM (
      SELECT *, count(*) OVER (PARTITION BY {KEYS}, run) AS length, max(run) OVER (PARTITION BY {KEYS}) AS runs, count(*) OVER (PARTITION BY {KEYS}) AS total FROM numbered))"""))
def m14_deployed(spark, sf):
    rows = folded(spark, sf).withColumn("hours_since_onset", F.col("win") * 0.5)
    return models.deployed_stages(rows, "trans", 0.68, 0.75, 2).select(*NIGHT_WIN, "phase")


@query("m14_score_nights")
def m14(spark, sf):
    """Models of the other folds score fold 0: class model on the first feature set, gate on the augmented set with z-columns."""
    t = augmented_table(spark, sf)
    train, test = t.where(fold_of() != 0), t.where(fold_of() == 0)
    gate_features = [*features.FEATURES_A, *features.FEATURES_EXTRA, *features.NIGHT_Z]
    trans = held_out.decoder_tables(held_out.label_counts(train.withColumn("all", F.lit(1)), ["all"])).select("trans")
    path = work_folder(spark, "model")
    models.save_model(models.fit_stages(train, features.FEATURES_A, 5), trans, path)
    (model, trans), gate = models.load_model(spark, path), models.fit_gate(train, gate_features, 0, 12.0, rounds=2)
    scored = models.gate_probability(gate, models.stage_probabilities(model, test, features.FEATURES_A), gate_features, "p_awake")
    # one row of sixteen numbers
    scored = scored.withColumn("trans", F.array(*[F.lit(p) for p in trans.first()[0]]))
    return models.deployed_stages(scored, "trans", 0.3, 0.6, 2).select(*NIGHT_WIN, "phase", "p_awake")


def augmented_table(spark, sf):
    key = ("augmented", spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        whole = features.features_extra(windows(spark, sf), frame_a(spark, sf))
        _SAVED[key] = cut_lineage(whole.select(*NIGHT_WIN, "label", *features.FEATURES_A, *features.FEATURES_EXTRA, *features.NIGHT_Z), "augmented")
    return _SAVED[key]


# ------------------------------------------------------------------ models that see other nights only


@query("m9_bayes_posterior", sql("SELECT user_id, night, win, p0, p1, p2, p3 FROM lo_p", "lo_p", "p0 p1 p2 p3", digits=4), digits=4)
def m9(spark, sf):
    return held_out.leave_one_night_out(training_table(spark, sf), _FEATURES).select(*NIGHT_WIN, "p0", "p1", "p2", "p3")


@query("m4_stage_classifier", sql(f"SELECT label, count(*) AS windows, count(*) AS proper, 0 AS shared_nights FROM lo WHERE {FOLD} = 0 GROUP BY 1", "lo"))
def m4(spark, sf):
    """Boosted trees on all features: every held-out window gets shares that add up to 1, and no night is on both sides."""
    train, test = train_and_test(spark, sf)
    scored = models.boosted_probabilities(models.fit_boosted(train, features.FEATURES_A), test, features.FEATURES_A)
    p = [F.col(f"p{k}") for k in range(4)]
    proper = (F.abs(p[0] + p[1] + p[2] + p[3] - 1) < 1e-9) & (F.least(*p) >= 0)
    both = train.select(*NIGHT).distinct().join(test.select(*NIGHT).distinct(), NIGHT).count()
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(proper, 1)).alias("proper")).withColumn("shared_nights", F.lit(both))


@query("io17_model_artefacts", sql("""
    SELECT pred, count(*) AS n, any_value(nights) AS nights FROM (
      SELECT CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS pred, (SELECT count(*) FROM lo_nights) AS nights FROM lo_p) GROUP BY 1""", "lo_p lo_nights"))
def io17(spark, sf):
    """Models of all nights written, read back and used."""
    t, path = training_table(spark, sf), work_folder(spark, "models")
    held_out.night_models(t, _FEATURES).write.parquet(path)
    loaded = spark.read.parquet(path)
    scored = models.best_class(held_out.score_by_night(t, loaded, _FEATURES))
    return scored.groupBy("pred").agg(F.count(F.lit(1)).alias("n")).withColumn("nights", F.lit(loaded.count()))
