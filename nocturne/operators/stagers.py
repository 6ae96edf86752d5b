"""Sleep stages per window by rule sets (ST1-ST16).

A rule set is data: the window geometry, the guard for thin windows, and either
an ordered list of conditions or groups of scored conditions. Conditions are
SQL text over ``window_stats`` columns and the extra columns built below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators import positions, sequence, spectral
from nocturne.operators.nights import NIGHT
from nocturne.operators.series import with_resting_hr
from nocturne.operators.window_stats import with_beats, window_stats

Scored = list[tuple[str, dict[str, float]]]


@dataclass(frozen=True)
class RuleSet:
    name: str
    rows: int
    stride: int | None = None
    hr_above: int = 30
    thin: str = "n_hr < 5"
    thin_stage: str = "light"
    when: list[tuple[str, str]] = field(default_factory=list)
    otherwise: str = "light"
    groups: list[Scored] = field(default_factory=list)
    ties: tuple[str, ...] = ("deep", "light", "rem", "awake")
    spectrum_beats: int | None = None
    spectrum_seconds: float = 15.0
    smooth: bool = False
    derived: dict[str, str] = field(default_factory=dict)


def score_sql(groups: list[Scored], stage: str) -> str:
    """Sum over the groups; in each group the first condition that holds scores."""
    terms = []
    for group in groups:
        if any(stage in points for _, points in group):
            cases = " ".join(f"WHEN {c} THEN {float(p.get(stage, 0.0))}E0" for c, p in group)
            terms.append(f"CASE {cases} ELSE 0.0E0 END")
    return " + ".join(terms) if terms else "0.0E0"


def phase_sql(rules: RuleSet) -> str:
    """The stage of one window as a SQL expression."""
    if rules.groups:
        best = f"greatest({', '.join('s_' + s for s in rules.ties)})"
        cases = " ".join(f"WHEN s_{s} = {best} THEN '{s}'" for s in rules.ties)
        body = f"CASE {cases} END"
    else:
        cases = " ".join(f"WHEN {c} THEN '{s}'" for c, s in rules.when)
        body = f"CASE {cases} ELSE '{rules.otherwise}' END"
    return f"CASE WHEN {rules.thin} THEN '{rules.thin_stage}' ELSE {body} END"


IQR = "CASE WHEN n_hr > 10 THEN hr_p75 - hr_p25 ELSE coalesce(hr_std, 0.0E0) END"
RMSSD = "CASE WHEN n_rr > 5 AND n_d300 > 3 THEN rmssd300 ELSE 0.0E0 END"
RMSSD_ALL = "CASE WHEN n_rr > 5 THEN rmssd_all ELSE 0.0E0 END"
ELAPSED = "CAST(mid_ts - night_first AS DOUBLE)"
FRACTION = "CAST(mid_ts - night_first AS DOUBLE) / greatest(night_last - night_first, 1)"
CYCLE = f"CASE WHEN mid_ts > night_first THEN sin(2 * pi() * ({ELAPSED}) / 5400) ELSE 0.0E0 END"
MEDIAN_BASE = {"ha": "hr_med - rhr", "iqr": IQR, "hrv": RMSSD}
MEAN_BASE = {"ha": "hr_mean - rhr", "hrv": RMSSD}
TIMED = {"fraction": FRACTION, "cycle": CYCLE}

# ------------------------------------------------------------- threshold rules

THRESHOLD = RuleSet(
    "threshold", 300, hr_above=0, thin="n_hr < 10", thin_stage="unknown", otherwise="awake",
    when=[
        ("hr_mean > rhr + 15 AND mv_mean > 0.4", "awake"),
        ("ha < 4 AND hr_std < 3 AND mv_mean < 0.4", "deep"),
        ("hr_std > 5 AND mv_mean < 0.5", "rem"),
        ("ha < 12", "light"),
    ],
    derived=MEAN_BASE,
)


def calibrated(name: str, rows: int, moving: tuple[float, float], awake: float,
               deep: tuple[float, float, float], rem_iqr: float, rem_mv: float, rem_hrv: float) -> RuleSet:
    """Median and quartile rules; every threshold is a parameter (sweeps reuse this)."""
    is_moving = f"(mv_mean > {moving[0]} OR mv_max > {moving[1]})"
    return RuleSet(
        name, rows, thin_stage="unknown",
        when=[
            (f"{is_moving} AND ha > {awake}", "awake"),
            (f"ha <= {deep[0]} AND iqr < {deep[1]} AND mv_mean < {deep[2]}", "deep"),
            (f"iqr > {rem_iqr} AND mv_mean < {rem_mv}", "rem"),
            (f"hrv > {rem_hrv} AND mv_mean < {rem_mv}", "rem"),
        ],
        derived=MEDIAN_BASE,
    )


CALIBRATED = calibrated("calibrated", 600, (0.8, 2.4), 24.7, (14.2, 5.7, 2.8), 10.2, 0.7, 152.6)
APP = calibrated("app", 600, (0.6, 1.7), 16.3, (0.9, 9.9, 1.4), 12.8, 0.4, 84.1)
APP = RuleSet(
    **{**APP.__dict__, "derived": {
        **MEDIAN_BASE,
        "iqr": "CASE WHEN n_hr > 10 THEN hr_f75 - hr_f25 ELSE coalesce(hr_std, 0.0E0) END",
    }}
)

HR_ONLY = RuleSet(
    "hr_only", 120, 60, thin="n_hr < 10", smooth=True,
    when=[
        ("mv_mean > 1.0 OR mv_max > 3.0", "awake"),
        ("ha > 20", "awake"),
        ("ha < 2 AND hr_std < 3.0 AND mv_mean < 0.15", "deep"),
        ("hr_std > 8 AND mv_mean < 0.5", "rem"),
        ("hrv > 100 AND mv_mean < 0.5", "rem"),
    ],
    derived=MEDIAN_BASE,
)

EPOCH30 = RuleSet(
    "epoch30", 30, thin="n_hr < 3", smooth=True,
    when=[
        ("ha > 15 OR hr_std > 10", "awake"),
        ("ha < -2 AND hr_std < 3 AND hrv > 40", "deep"),
        ("hr_std > 5 OR (hrv < 25 AND hrv > 0)", "rem"),
    ],
    derived={"ha": "hr_med - rhr", "hrv": "CASE WHEN n_rr > 5 AND n_d300 > 2 THEN rmssd300 ELSE 0.0E0 END"},
)

FALLBACK = RuleSet(
    "fallback", 60, smooth=True,
    when=[
        ("ha > 15 OR mv_mean > 0.5", "awake"),
        ("ha < 4 AND hr_std < 3 AND hrv > 30", "deep"),
        ("hr_std > 5 AND hrv > 20 AND ha > 3", "rem"),
    ],
    derived={"ha": "hr_mean - rhr", "hrv": "CASE WHEN n_rr >= 5 AND n_d300 >= 3 THEN rmssd300 ELSE 0.0E0 END"},
)

TWO_TIER = RuleSet(
    "two_tier", 300, hr_above=0, thin="n_hr = 0", thin_stage="unknown", otherwise="awake",
    when=[
        ("hr_mean > rhr + 15 AND mv_mean > 0.4", "awake"),
        ("ha < 3 AND hr_std < 3 AND mv_mean < 0.3", "deep"),
        ("ha < 4 AND hr_std < 3 AND mv_mean < 0.4", "deep"),
        ("hr_std > 5 AND mv_mean < 0.5", "rem"),
        ("ha < 8 AND mv_mean < 0.6", "light"),
        ("ha < 12", "light"),
    ],
    derived=MEAN_BASE,
)

# ---------------------------------------------------------------- scored rules

MOVING = "(mv_mean > 0.8 OR mv_max > 2.4)"

SCORED = RuleSet(
    "scored", 600, thin_stage="unknown", ties=("deep", "rem", "awake", "light"),
    groups=[
        [("ha < 0", {"deep": 3}), ("ha < 5", {"deep": 2})],
        [("iqr < 5", {"deep": 2})],
        [(f"NOT {MOVING} AND mv_mean < 0.2", {"deep": 2})],
        [("hrv > 0 AND hrv < 30", {"deep": 1})],
        [("iqr > 10", {"rem": 3})],
        [("hrv > 80", {"rem": 2})],
        [(f"NOT {MOVING}", {"rem": 1})],
        [(f"{MOVING} AND ha > 24.7", {"awake": 5}), (MOVING, {"awake": 2})],
        [("ha > 20", {"awake": 3})],
        [(f"ha >= 5 AND ha < 15 AND NOT {MOVING}", {"light": 3})],
        [("iqr >= 5 AND iqr <= 10", {"light": 1})],
    ],
    derived=MEDIAN_BASE,
)

SCORED_GYRO = RuleSet(
    "scored_gyro", 300, hr_above=0, thin="n_hr < 10", thin_stage="unknown",
    ties=("deep", "rem", "awake", "light"),
    groups=[
        [("ha < 5", {"deep": 3})],
        [("hr_std < 3", {"deep": 2})],
        [("mv_mean < 0.2", {"deep": 2})],
        [("mv_max < 0.5", {"deep": 1})],
        [("hrv < 30", {"deep": 1})],
        [("hr_std > 4", {"rem": 3})],
        [("hrv > 40", {"rem": 2})],
        [("mv_mean < 0.3", {"rem": 2})],
        [("ha > 3 AND ha < 15", {"rem": 1})],
        [("rr_cv > 0.05", {"rem": 1})],
        [("ha > 15", {"awake": 3})],
        [("mv_mean > 0.4", {"awake": 3})],
        [("mv_max > 1.0", {"awake": 2})],
        [("gyro_abs > 0.5", {"awake": 1})],
        [("ha >= 5 AND ha < 15", {"light": 2})],
        [("mv_mean >= 0.2 AND mv_mean < 0.4", {"light": 2})],
        [("hr_std >= 2 AND hr_std < 5", {"light": 1})],
    ],
    derived={
        "ha": "hr_mean - rhr", "hrv": RMSSD_ALL,
        "rr_cv": "CASE WHEN n_rr > 5 THEN rr_std / rr_mean ELSE 0.0E0 END",
    },
)

_LEVEL: Scored = [
    ("ha < -2", {"deep": 3}),
    ("ha < 3", {"deep": 1.5, "light": 1}),
    ("ha < 10", {"light": 2}),
    ("ha < 18", {"rem": 1.5, "light": 0.5}),
    ("true", {"awake": 3}),
]
_SPREAD: Scored = [
    ("hr_std < 2.5", {"deep": 2}),
    ("hr_std < 5", {"light": 1.5}),
    ("hr_std > 8", {"rem": 2.5}),
    ("true", {"rem": 1}),
]
_CYCLE: Scored = [("cycle < -0.5", {"deep": 1}), ("cycle > 0.5", {"rem": 1})]

SPECTRAL = RuleSet(
    "spectral", 60, smooth=True, spectrum_beats=20,
    groups=[
        _LEVEL,
        _SPREAD,
        [("mv_mean > 1.0 OR mv_max > 3.0", {"awake": 4}), ("mv_mean > 0.3", {"awake": 1.5}),
         ("mv_mean < 0.05", {"deep": 1.5})],
        [("lf_hf < 0.8", {"deep": 3}), ("lf_hf < 1.5", {"deep": 1.5, "light": 1})],
        [("lf_hf > 2.5", {"rem": 2.5}), ("lf_hf > 1.8", {"rem": 1.5})],
        [("lf_hf >= 1.0 AND lf_hf <= 2.0", {"light": 1.5})],
        [("hf_pct > 50", {"deep": 1.5}), ("hf_pct < 20", {"rem": 1})],
        [("hrv > 120", {"deep": 1.5}), ("hrv > 80", {"light": 1}), ("hrv > 0 AND hrv < 30", {"rem": 1})],
        [("fraction < 0.35", {"deep": 1.5}), ("fraction > 0.65", {"rem": 1.5})],
        _CYCLE,
    ],
    derived={**MEDIAN_BASE, **TIMED},
)

SPECTRAL_SLIDING = RuleSet(
    "spectral_sliding", 120, 60, thin="n_hr < 10", smooth=True, spectrum_beats=30, spectrum_seconds=30.0,
    groups=[
        [("ha < -2", {"deep": 3}), ("ha < 3", {"deep": 1.5, "light": 1}), ("ha < 10", {"light": 2}),
         ("ha < 18", {"light": 1, "rem": 1.5}), ("true", {"awake": 3})],
        _SPREAD,
        [("mv_mean > 1.0 OR mv_max > 3.0", {"awake": 4}), ("mv_mean > 0.3", {"awake": 1.5, "light": 0.5}),
         ("mv_mean < 0.05", {"deep": 1.5}), ("true", {"light": 0.5})],
        [("NOT has_power", {}), ("lf_hf < 0.8", {"deep": 3}), ("lf_hf < 1.5", {"deep": 1.5, "light": 1})],
        [("NOT has_power", {}), ("lf_hf > 2.5", {"rem": 2.5}), ("lf_hf > 1.8", {"rem": 1.5})],
        [("has_power AND lf_hf >= 1.0 AND lf_hf <= 2.0", {"light": 1.5})],
        [("NOT has_power", {}), ("hf_pct_all > 50", {"deep": 1.5}), ("hf_pct_all < 20", {"rem": 1, "awake": 0.5})],
        [("hrv > 120", {"deep": 1.5}), ("hrv > 80", {"light": 1}), ("hrv > 0 AND hrv < 30", {"rem": 1, "awake": 0.5})],
        [("fraction < 0.35", {"deep": 1.5, "light": 0.5}), ("fraction > 0.65", {"rem": 1.5, "light": 0.5})],
        _CYCLE,
    ],
    derived={**MEDIAN_BASE, **TIMED},
)

NONLINEAR = RuleSet(
    "nonlinear", 60, smooth=True, spectrum_beats=20,
    groups=[
        [("rr_cv < 0.03", {"deep": 3}), ("rr_cv < 0.06", {"deep": 1.5, "light": 1}),
         ("rr_cv < 0.10", {"light": 2}), ("rr_cv < 0.15", {"rem": 2}), ("true", {"awake": 2, "rem": 1})],
        [("sd_ratio < 0.3", {"deep": 2.5}), ("sd_ratio < 0.5", {"deep": 1.5, "light": 0.5}),
         ("sd_ratio < 0.8", {"light": 2}), ("sd_ratio < 1.2", {"rem": 2}), ("true", {"awake": 1.5, "rem": 1})],
        [("hrv > 120", {"deep": 2}), ("hrv > 80", {"deep": 1, "light": 1}), ("hrv > 40", {"light": 1.5}),
         ("hrv > 15", {"rem": 1.5}), ("hrv > 0", {"awake": 1})],
        [("lf_hf < 0.8", {"deep": 2.5}), ("lf_hf < 1.5", {"deep": 1, "light": 1.5}),
         ("lf_hf < 2.5", {"light": 1, "rem": 1.5}), ("true", {"rem": 2.5})],
        [("ha < -2", {"deep": 2}), ("ha < 3", {"deep": 0.5, "light": 1}), ("ha < 10", {"light": 1}),
         ("ha < 18", {"rem": 1.5}), ("true", {"awake": 3})],
        [("fraction < 0.30", {"deep": 1}), ("fraction > 0.70", {"rem": 1})],
    ],
    derived={
        **MEDIAN_BASE, **TIMED,
        "rr_cv": "CASE WHEN n_rr > 10 THEN rr_std / rr_mean ELSE 0.5E0 END",
        "sd_ratio": "CASE WHEN n_rr > 5 AND n_d300 > 3 THEN (sd_d300 / sqrt(2)) / "
                    "sqrt(greatest(2 * rr_std * rr_std - sd_d300 * sd_d300 / 2, 0.01E0)) ELSE 1.0E0 END",
    },
)

NONLINEAR_SLIDING = RuleSet(
    "nonlinear_sliding", 120, 60, thin="n_hr < 10", smooth=True, spectrum_beats=30,
    groups=[
        [("mv_mean > 1.0 OR mv_max > 3.0", {"awake": 5}), ("mv_mean > 0.3", {"awake": 2}),
         ("mv_mean < 0.05", {"deep": 1.5})],
        [("ha < -2", {"deep": 3}), ("ha < 4", {"deep": 1.5, "light": 1}), ("ha < 12", {"light": 2}),
         ("ha < 20", {"rem": 1.5, "light": 0.5}), ("true", {"awake": 3})],
        [("n_rr < 20", {}), ("sampen < 0.5", {"deep": 2.5}), ("sampen < 1.0", {"light": 1.5}),
         ("sampen > 2.0", {"rem": 2, "awake": 1}), ("true", {"rem": 1.5})],
        [("n_rr < 20", {}), ("sd_ratio > 0.7", {"rem": 2}), ("sd_ratio < 0.3", {"deep": 2}), ("true", {"light": 1})],
        [("n_rr < 20", {}), ("rmssd_all > 100", {"deep": 2}), ("rmssd_all > 60", {"light": 1}),
         ("rmssd_all < 25", {"awake": 1.5})],
        [("n_rr < 20", {}), ("lf_hf1 < 0.8", {"deep": 2}), ("lf_hf1 > 2.5", {"rem": 2, "awake": 0.5}),
         ("lf_hf1 >= 1.0 AND lf_hf1 <= 2.0", {"light": 1.5})],
        [("n_rr < 20", {}), ("pnn50 > 40", {"deep": 1.5}), ("pnn50 < 10", {"awake": 1})],
        [("n_rr >= 20", {}), ("hr_std < 2.5", {"deep": 1.5}), ("hr_std > 8", {"rem": 2})],
        [("fraction < 0.35", {"deep": 1}), ("fraction > 0.65", {"rem": 1})],
    ],
    derived={
        "ha": "hr_med - rhr", **TIMED,
        # complexity proxy: variation coefficient times 20, 0 for a constant rhythm
        "sampen": "CASE WHEN 0.2 * rr_std < 0.01 THEN 0.0E0 ELSE rr_std / rr_mean * 20 END",
        "sd_ratio": "CASE WHEN sd_sum / sqrt(2) > 0.01 THEN (sd_d / sqrt(2)) / (sd_sum / sqrt(2)) ELSE 1.0E0 END",
        "pnn50": "100.0E0 * n50_all / n_d",
    },
)

HR_DELTA = RuleSet(
    "hr_delta", 120, smooth=True,
    groups=[
        [("ha < -3", {"deep": 4}), ("ha < 0", {"deep": 2.5, "light": 0.5}), ("ha < 5", {"light": 2.5}),
         ("ha < 12", {"light": 1, "rem": 1.5}), ("ha < 20", {"rem": 1, "awake": 2}), ("true", {"awake": 4})],
        [("hr_std < 2.0", {"deep": 2.5}), ("hr_std < 4.0", {"light": 1.5, "deep": 0.5}),
         ("hr_std < 7.0", {"light": 1, "rem": 1}), ("hr_std < 12.0", {"rem": 2.5}),
         ("true", {"awake": 2, "rem": 0.5})],
        [("hr_delta < -3", {"deep": 1.5}), ("hr_delta < -1", {"deep": 0.5, "light": 0.5}),
         ("hr_delta > 3", {"awake": 1.5, "rem": 0.5}), ("hr_delta > 1", {"rem": 1, "light": 0.5})],
        [("jumps > 15", {"awake": 3}), ("jumps > 8", {"awake": 1, "rem": 0.5}), ("jumps > 3", {"rem": 1}),
         ("jumps <= 1", {"deep": 1})],
        [("fraction < 0.30", {"deep": 1.5}), ("fraction > 0.65", {"rem": 1.5})],
    ],
    derived={
        "ha": "hr_med - rhr", **TIMED,
        "jumps": "CASE WHEN n_hr > 10 THEN hr_jumps ELSE 0 END",
        "hr_delta": "CASE WHEN prev_n_hr >= 5 THEN hr_med - prev_med ELSE 0.0E0 END",
    },
)

RULE_SETS = {
    r.name: r
    for r in (
        THRESHOLD, CALIBRATED, APP, HR_ONLY, EPOCH30, FALLBACK, TWO_TIER, SCORED, SCORED_GYRO,
        SPECTRAL, SPECTRAL_SLIDING, NONLINEAR, NONLINEAR_SLIDING, HR_DELTA,
    )
}


# -------------------------------------------------------------------- operator


def with_floor_quartiles(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Marks the floor-index quartiles of the heart rate, as the app computes them."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("hr_ok", "timestamp")) - 1
    size = F.count("hr_ok").over(W.partitionBy(*keys))
    # NULLs sort first, so the rank of a valid value is shifted by their count
    at = F.when(F.col("hr_ok").isNotNull(), rank - (F.col("rows_in") - size))
    marked = windows.withColumns({"_at": at, "_valid": size})
    return marked.withColumns(
        {
            f"hr_f{q}": F.when(F.col("_at") == F.floor(F.col("_valid") * q / 100), F.col("hr_ok"))
            for q in (25, 75)
        }
    ).drop("_at", "_valid")


def stage_windows(df: DataFrame, rules: RuleSet, rhr: DataFrame | None = None, rows: int | None = None,
                  stride: int | None = None, keys: list[str] = NIGHT, rest_rows: int = 300,
                  rest_step: int = 30, carry: tuple[str, ...] = ("start_ts", "last_ts", "mid_ts")) -> DataFrame:
    """Window statistics, derived columns and ``phase`` of every window of every night.

    ``df`` holds night rows. Without ``rhr`` (one resting heart rate per night) it is
    computed on the way, and all runs on one shuffle by night. ``rows`` and ``stride``
    override the geometry of the rule set. Smoothed rule sets return ``phase`` and
    the ``carry`` columns only.
    """
    rows = rows or rules.rows
    stride = stride or (rules.stride and max(1, rules.stride * rows // rules.rows))
    inline = rhr is None
    if inline:
        df = with_resting_hr(df, keys, rest_rows, rest_step)
    placed = df if inline else positions.with_position(df, keys)
    group = W.partitionBy(*keys)
    placed = placed.withColumns(
        {"night_first": F.min("timestamp").over(group), "night_last": F.max("timestamp").over(group)}
    )
    cut = positions.sliding(placed, rows, stride) if stride else positions.tumbling(placed, rows)
    window_keys = [*keys, "win", "night_first", "night_last", *(["rhr"] if inline else [])]
    windows = with_beats(cut, window_keys, rules.hr_above)
    floors = "hr_f75" in " ".join(rules.derived.values())
    stats = window_stats(with_floor_quartiles(windows, window_keys) if floors else windows, window_keys)
    if not inline:
        stats = stats.join(rhr, keys)
    order = W.partitionBy(*keys).orderBy("win")
    stats = stats.withColumns(
        {"prev_n_hr": F.lag("n_hr").over(order), "prev_med": F.lag("hr_med").over(order)}
    )
    if rules.spectrum_beats:
        power = F.col("power")
        stats = spectral.with_spectrum(stats, rules.spectrum_beats, rules.spectrum_seconds).withColumns(
            {
                "has_power": power["hf"].isNotNull(),
                "lf_hf": spectral.lf_hf(power, 1.5),
                "lf_hf1": spectral.lf_hf(power, 1.0),
                "hf_pct": spectral.hf_percent(power),
                "hf_pct_all": spectral.hf_percent(power, with_vlf=True),
            }
        )
    stats = stats.withColumns({k: F.expr(v) for k, v in rules.derived.items()})
    if rules.groups:
        stats = stats.withColumns(
            {f"s_{s}": F.expr(score_sql(rules.groups, s)) for s in rules.ties}
        )
    staged = stats.withColumn("phase", F.expr(phase_sql(rules)))
    if rules.smooth:
        kept = (*carry, *(["label"] if "label" in staged.columns else []))
        staged = sequence.smooth_isolated(staged, keys=keys, carry=kept)
    return staged


Stager = Callable[[DataFrame, DataFrame], DataFrame]
_STAGERS: dict[str, Stager] = {}


def register_stager(name: str, fn: Stager) -> None:
    """Add a stager: night rows and resting heart rates in, window phases out."""
    _STAGERS[name] = fn


def stagers() -> dict[str, Stager]:
    built_in = {
        name: (lambda df, rhr, r=rules: stage_windows(df, r, rhr)) for name, rules in RULE_SETS.items()
    }
    return {**built_in, **_STAGERS}


def split_external(windows: DataFrame, method: str = "heart_rate") -> DataFrame:
    """Deep or light for windows an external classifier called ``nrem`` (column ``coarse``).

    ``heart_rate``: rules on heart rate, movement and position. ``median``: deep
    where the median is below the resting rate minus one.
    """
    nrem = {
        "heart_rate": F.when(
            ((F.col("ha") < 2) & (F.col("hr_std") < 3) & (F.col("mv_mean") < 0.15))
            | ((F.col("ha") < 0) & (F.col("hrv") > 80))
            | ((F.col("fraction") < 0.4) & (F.col("ha") < 5) & (F.col("hr_std") < 4)),
            "deep",
        ).otherwise("light"),
        "median": F.when((F.col("n_hr") > 0) & (F.col("ha") < -1), "deep").otherwise("light"),
    }[method]
    split = F.when(F.col("coarse") == "nrem", nrem).otherwise(F.col("coarse"))
    if method == "heart_rate":
        split = F.when((F.col("mv_mean") > 1.0) | (F.col("mv_max") > 3.0), "awake").otherwise(split)
    return windows.withColumn("phase", split)


def split_external_fixed(windows: DataFrame, keys: list[str] = NIGHT) -> DataFrame:
    """Stage counts per night with a quarter of ``nrem`` counted as deep."""
    count = {s: F.sum((F.col("coarse") == s).cast("int")) for s in ("awake", "rem", "nrem")}
    counted = windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(s) for s, c in count.items()]
    )
    deep = F.floor(F.col("nrem") * 0.25)
    share = lambda c: F.bround(100.0 * c / F.col("n"), 1)
    return counted.select(
        *keys, "n",
        share(deep).alias("deep_pct"), share(F.col("nrem") - deep).alias("light_pct"),
        share(F.col("rem")).alias("rem_pct"), share(F.col("awake")).alias("awake_pct"),
    )


def awake_overrides(windows: DataFrame, movement: float = 0.3, above: float = 10.0, energy: float = 20.0,
                    crossings: float = 0.3, probability: float = 0.5) -> DataFrame:
    """Model output overridden by awake rules on movement, energy and probability."""
    busy = (F.col("mv_mean") > movement) & (F.col("ha") > above)
    awake = (
        busy
        | (F.col("mv_energy") > energy)
        | ((F.col("mv_zcr") > crossings) & busy)
        | (F.col("p_awake") > probability)
    )
    return windows.withColumn("phase", F.when(awake, F.lit("awake")).otherwise(F.col("phase")))


