"""Pluggable scorers and stagers side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.operators import aggregates, nights, scores
from nocturne.operators.nights import DAY, NIGHT

Scorer = Callable[[DataFrame], DataFrame]
SCORE_COLUMNS = ["recovery", "sleep", "strain", "hrv_ms", "rhr_bpm", "resp_rate"]


def daily_strain(df: DataFrame, max_hr: int = 200) -> DataFrame:
    load = aggregates.zone_load(nights.with_date(df), DAY, max_hr)
    return load.select(*DAY, scores.strain().alias("strain"))


def run_scorers(df: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """Scores of every scorer per user and date in one schema.

    A scorer that can not be planned on these columns yields one row with ``error``
    and no day; the others are not affected.
    """
    spark = df.sparkSession
    parts = []
    for name, scorer in scorers.items():
        try:
            out = scorer(df)
            have = [F.col(c).cast("double").alias(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in SCORE_COLUMNS]
            parts.append(out.select(F.lit(name).alias("algo"), *DAY, *have, F.lit(None).cast("string").alias("error")))
        except AnalysisException as e:
            message = (e.getCondition() or "ANALYSIS_ERROR").split(".")[0]
            row = spark.range(1).select(
                F.lit(name).alias("algo"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("date").alias("date"),
                *[F.lit(None).cast("double").alias(c) for c in SCORE_COLUMNS], F.lit(message).alias("error"),
            )
            parts.append(row)
    return reduce(DataFrame.unionByName, parts)


def compare_stagers(night_rows: DataFrame, rhr: DataFrame, stagers: dict[str, Callable], window_min: float) -> DataFrame:
    """Stage summaries of every stager per night with the column ``algo``."""
    parts = [
        aggregates.stage_summary(fn(night_rows, rhr).select(*NIGHT, "win", "phase"), window_min).withColumn("algo", F.lit(name))
        for name, fn in stagers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def stager_errors(shares: DataFrame, official: DataFrame) -> DataFrame:
    """Mean absolute error of the stage shares of every stager and night."""
    own = shares.select("algo", *NIGHT, *[f"{s}_pct" for s in ("deep", "light", "rem", "awake")])
    other = official.select(*NIGHT, *[F.col(f"{s}_pct").alias(f"o_{s}") for s in ("deep", "light", "rem", "awake")])
    diff = [F.abs(F.col(f"{s}_pct") - F.col(f"o_{s}")) for s in ("deep", "light", "rem", "awake")]
    error = F.bround((diff[0] + diff[1] + diff[2] + diff[3]) / 4, 1)
    return own.join(other, NIGHT).select("algo", *NIGHT, error.alias("error"))


