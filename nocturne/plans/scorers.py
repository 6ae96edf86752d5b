"""Scorer contract: several scorers side by side, a bad day gives a row with ``error`` and nothing else fails.

Two kinds share one result schema, ``algo``, user, date, ``SCORE_COLUMNS`` and ``error``:

- ``Scorer``: column expressions over one row of inputs per day. All scorers run in one pass over the
  inputs; expressions are evaluated only on days whose inputs are there, numeric and in range.
- a day function: Python over the readings of one user and day, for scorers that columns do not express.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.operators import scores
from nocturne.operators.nights import DAY
from nocturne.plans.compare import SCORE_COLUMNS

ANY = (float("-inf"), float("inf"))
DayFunction = Callable[[pd.DataFrame], dict]


@dataclass(frozen=True)
class Scorer:
    """``needs``: range of every input. ``scores``: builds the columns, named as in ``SCORE_COLUMNS``."""

    needs: dict[str, tuple[float, float]]
    scores: Callable[[], dict[str, Column]]


# What a reading has to lie between to be one.
HRV, RHR, RESP, PERCENT = (1.0, 400.0), (25.0, 150.0), (4.0, 60.0), (0.0, 100.0)
_BODY = {"hrv": HRV, "rhr": RHR, "resp": RESP}
_SLEEP = {"sleep_min": (0.0, 1440.0), "efficiency": PERCENT, "awake_pct": PERCENT}


def _body() -> dict[str, Column]:
    return {"hrv_ms": F.col("hrv"), "rhr_bpm": F.col("rhr"), "resp_rate": F.col("resp")}


def _custom() -> dict[str, Column]:
    sleep = scores.sleep_score_custom()
    return {"recovery": scores.recovery_custom(sleep=sleep), "sleep": sleep, "strain": scores.strain(), **_body()}


def _calibrated() -> dict[str, Column]:
    sleep = scores.sleep_score_calibrated()
    return {"recovery": scores.recovery_calibrated(sleep=sleep), "sleep": sleep, "strain": scores.strain_calibrated(), **_body()}


def _engine() -> dict[str, Column]:
    sleep = scores.sleep_score_engine(F.col("sleep_min") / 60, "efficiency", F.lit(None).cast("int"))
    recovery = scores.recovery_engine(hrv_base=90.0, rhr_base=55.0)
    return {"recovery": recovery["recovery"], "sleep": sleep["sleep_score"], "strain": scores.strain(), **_body()}


def _simple() -> dict[str, Column]:
    return {"recovery": scores.recovery_simple("hrv", "rhr"), "hrv_ms": F.col("hrv"), "rhr_bpm": F.col("rhr")}


_LOAD = {"zone_load": (0.0, float("inf"))}
_SCORERS: dict[str, Scorer] = {
    "custom": Scorer({**_BODY, **_SLEEP, "deep_pct": PERCENT, "rem_pct": PERCENT, **_LOAD}, _custom),
    "calibrated": Scorer({**_BODY, **_SLEEP, **_LOAD, "n_valid": (0.0, float("inf")), "n_rows": (1.0, float("inf"))}, _calibrated),
    "engine": Scorer({**_BODY, "sleep_min": (0.0, 1440.0), "efficiency": PERCENT, **_LOAD}, _engine),
    "simple": Scorer({"hrv": HRV, "rhr": RHR}, _simple),
}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Add a scorer, or replace the one of this name."""
    _SCORERS[name] = scorer


def scorers() -> dict[str, Scorer]:
    return dict(_SCORERS)


def _named(values: dict[str, Column]) -> list[Column]:
    return [values.get(c, F.lit(None)).cast("double").alias(c) for c in SCORE_COLUMNS]


def score_days(days: DataFrame, chosen: dict[str, Scorer] | None = None) -> DataFrame:
    """A row per scorer, user and date of ``days``, which has one row of inputs per day.

    Inputs may be numbers or text. ``error`` names the first input, in the order of ``needs``, that is
    ``missing`` (null, or no such column), ``not_a_number`` or ``out_of_range``, or the first score
    that came out as ``no_result``; all scores are null then. Repeated days are scored each by itself.
    """
    chosen = scorers() if chosen is None else chosen
    have = {c.lower() for c in days.columns}
    inputs = list(dict.fromkeys(c for s in chosen.values() for c in s.needs))
    value = {c: F.col(f"`{c}`").try_cast("double") if c.lower() in have else F.lit(None).cast("double") for c in inputs}
    absent = {c: F.col(f"`{c}`").isNull() if c.lower() in have else F.lit(True) for c in inputs}
    read = days.select(*DAY, *[value[c].alias(c) for c in inputs], F.struct(*[absent[c].alias(c) for c in inputs]).alias("absent"))

    def fault(c: str, low: float, high: float) -> Column:
        x = F.col(c)
        return (
            F.when(F.col("absent")[c], F.lit(f"missing:{c}")).when(x.isNull() | F.isnan(x), F.lit(f"not_a_number:{c}"))
            .when(~x.between(low, high), F.lit(f"out_of_range:{c}"))
        )

    # the faults are columns of their own, so that they are worked out once for all scores of a scorer
    found = {n: F.coalesce(*[fault(c, *bounds) for c, bounds in s.needs.items()], F.lit(None).cast("string")) for n, s in chosen.items()}
    judged = read.select("*", F.struct(*[e.alias(n) for n, e in found.items()]).alias("fault"))

    def row(name: str, scorer: Scorer) -> Column:
        error = F.col("fault")[name]
        made = {c: F.when(error.isNull(), v.cast("double")) for c, v in scorer.scores().items()}
        wanted = F.array(*[F.lit(c) for c in made])
        return F.struct(F.lit(name).alias("algo"), wanted.alias("wanted"), *_named(made), error.alias("error"))

    each = judged.select(*DAY, F.explode(F.array(*[row(n, s) for n, s in chosen.items()])).alias("r")).select(*DAY, "r.*")
    empty = [F.when(F.array_contains("wanted", c) & (F.col(c).isNull() | F.isnan(c)), F.lit(f"no_result:{c}")) for c in SCORE_COLUMNS]
    whole = each.select("algo", *DAY, *SCORE_COLUMNS, F.coalesce("error", *empty).alias("error"))
    return whole.select("algo", *DAY, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in SCORE_COLUMNS], "error")


def score_readings(readings: DataFrame, functions: dict[str, DayFunction], columns: list[str]) -> DataFrame:
    """A row per day function, user and date of ``readings``, which has a column ``date``.

    Every function gets the day's ``columns`` in time order and returns scores by name. Whatever it
    raises is the ``error`` of that day, by the type's name; a name it does not know, a value that is no
    number or no finite one is ``ValueError``. A day has at most 86 400 seconds, so a group is bounded.
    """
    names = [f"{c} double" for c in SCORE_COLUMNS]
    schema = f"algo string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in readings.select(*DAY).schema)}, {', '.join(names)}, error string"

    def run(key: tuple, day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("timestamp", kind="stable", ignore_index=True)
        rows = []
        for name, function in functions.items():
            found, error = {}, None
            try:
                found = {k: float(v) for k, v in function(day).items()}
                unknown = set(found) - set(SCORE_COLUMNS)
                if unknown or any(v - v != 0 for v in found.values()):
                    raise ValueError("unknown or infinite score")
            except Exception as e:  # a scorer's own failure, whatever it is, belongs to its day
                found, error = {}, type(e).__name__
            rows.append((name, *key, *[found.get(c) for c in SCORE_COLUMNS], error))
        return pd.DataFrame(rows, columns=["algo", *DAY, *SCORE_COLUMNS, "error"]).astype(dict.fromkeys(SCORE_COLUMNS, "float64"))

    return readings.select(*DAY, "timestamp", *columns).groupBy(*DAY).applyInPandas(run, schema)


def resting_rate(day: pd.DataFrame, least: int = 20) -> dict:
    """Tenth percentile of the day's heart rates."""
    rates = day["hr"][day["hr"] > 30]
    if len(rates) < least:
        raise LookupError("too few readings")
    return {"rhr_bpm": rates.quantile(0.1)}


def beat_variability(day: pd.DataFrame) -> dict:
    """RMSSD over the day's valid beats in time order."""
    beats = day["rr1_ms"][(day["rr1_ms"] > 200) & (day["rr1_ms"] < 2500)]
    squares = beats.diff().dropna() ** 2
    return {"hrv_ms": (float(squares.sum()) / len(squares)) ** 0.5}
