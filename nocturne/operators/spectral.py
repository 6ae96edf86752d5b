"""Spectral heart-rate variability per window (SP1-SP5).

Windows are formed, ordered and shuffled by Spark; each window arrives as one
array and only the short signal transform runs in Arrow batches of NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nocturne.operators.nights import NIGHT

RATE_HZ = 4.0


def welch(x: np.ndarray, segment: int, rate: float = RATE_HZ) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: periodic Hann, half overlap, mean-free segments."""
    hop = segment - segment // 2
    starts = np.arange(0, len(x) - segment + 1, hop)
    parts = x[starts[:, None] + np.arange(segment)]
    parts = parts - parts.mean(axis=1, keepdims=True)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    power = np.abs(np.fft.rfft(parts * hann, axis=1)) ** 2 / (rate * (hann**2).sum())
    power[:, 1 : (-1 if segment % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(segment, 1 / rate), power.mean(axis=0)


def resample(rr: np.ndarray, rate: float = RATE_HZ) -> np.ndarray:
    """Beat intervals on an even time grid, linear between beats."""
    t = np.cumsum(rr) / 1000.0
    t = t - t[0]
    return np.interp(np.arange(0, t[-1], 1.0 / rate), t, rr)


def _band(freq: np.ndarray, power: np.ndarray, mask: np.ndarray) -> float:
    return float(np.trapezoid(power[mask], freq[mask])) if mask.any() else 0.0


def _bands(rr: np.ndarray, min_beats: int, min_seconds: float) -> dict | None:
    if len(rr) < min_beats or (rr.sum() - rr[0]) / 1000.0 < min_seconds:
        return None
    x = resample(rr)
    if len(x) < 32:
        return None
    freq, power = welch(x - x.mean(), min(128, len(x)))
    return {
        "vlf": _band(freq, power, (freq >= 0.003) & (freq < 0.04)),
        "lf": _band(freq, power, (freq >= 0.04) & (freq <= 0.15)),
        "hf": _band(freq, power, (freq >= 0.15) & (freq <= 0.40)),
    }


@F.pandas_udf(T.StructType([T.StructField(b, T.DoubleType()) for b in ("vlf", "lf", "hf")]))
def _band_powers(beats: pd.Series, min_beats: pd.Series, min_seconds: pd.Series) -> pd.DataFrame:
    rows = [
        _bands(np.asarray(rr, dtype=float), n, s) or {"vlf": None, "lf": None, "hf": None}
        for rr, n, s in zip(beats, min_beats, min_seconds)
    ]
    return pd.DataFrame(rows, columns=["vlf", "lf", "hf"], dtype=float)


def band_powers(beats: Column, min_beats: int = 30, min_seconds: float = 15.0) -> Column:
    """Struct of band powers, NULL fields where the guards fail."""
    return _band_powers(beats, F.lit(min_beats), F.lit(float(min_seconds)))


def lf_hf(powers: Column, default: float = 1.0) -> Column:
    """LF/HF: ``default`` without a spectrum, 5 without high-frequency power."""
    return (
        F.when(powers["hf"].isNull(), default)
        .when(powers["hf"] < 1e-10, 5.0)
        .otherwise(powers["lf"] / powers["hf"])
    )


def hf_percent(powers: Column, with_vlf: bool = False, default: float = 33.0) -> Column:
    total = powers["lf"] + powers["hf"] + (powers["vlf"] if with_vlf else 0.0)
    return F.when(powers["hf"].isNull() | (total <= 1e-10), default).otherwise(
        powers["hf"] / total * 100
    )


@F.pandas_udf(T.DoubleType())
def _breathing_peak(beats: pd.Series) -> pd.Series:
    def peak(rr) -> float:
        rr = np.asarray(rr, dtype=float)
        if len(rr) < 60 or (rr.sum() - rr[0]) / 1000.0 < 30:
            return 14.0
        x = resample(rr)
        freq, power = welch(x - x.mean(), min(256, len(x)))
        band = (freq >= 0.15) & (freq <= 0.5)
        return float(freq[band][np.argmax(power[band])] * 60) if band.any() else 14.0

    return beats.map(peak)


def beat_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    """The valid beats of every group in order (a night or a window, both bounded)."""
    ok = (F.col("rr1_ms") > 200) & (F.col("rr1_ms") < 2500)
    rows = F.sort_array(F.collect_list(F.when(ok, F.struct("timestamp", "rr1_ms"))))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(
        *keys, F.col("_rows.rr1_ms").alias("rr_list")
    )


def respiratory_rate(df: DataFrame, keys: list[str] = NIGHT) -> DataFrame:
    """Breaths per minute from the spectral peak of the beat intervals."""
    return beat_arrays(df, keys).select(*keys, _breathing_peak("rr_list").alias("resp"))


def with_spectrum(stats: DataFrame, min_beats: int = 20, min_seconds: float = 15.0) -> DataFrame:
    """Adds the ``power`` struct to a ``window_stats`` frame."""
    return stats.withColumn("power", band_powers(F.col("rr_list"), min_beats, min_seconds))


def respiratory_rate_crossings(df: DataFrame, keys: list[str] = NIGHT) -> DataFrame:
    """Breaths per minute from direction changes of the beat interval, 8 to 25."""
    order = W.partitionBy(*keys).orderBy("timestamp")
    v = df.where("rr1_ms > 200 and rr1_ms < 2500").withColumn(
        "d", F.col("rr1_ms") - F.lag("rr1_ms").over(order)
    )
    turn = (F.col("d") * F.lag("d").over(order) < 0).cast("int")
    v = v.withColumn("turn", F.coalesce(turn, F.lit(0)))
    per_minute = F.sum("turn") / 2 / (F.sum("rr1_ms") / 1000) * 60
    bounded = F.greatest(F.lit(8.0), F.least(F.lit(25.0), F.floor(per_minute * 10 + 0.5) / 10))
    return v.groupBy(*keys).agg(F.when(F.count(F.lit(1)) < 60, 14.0).otherwise(bounded).alias("resp"))


def breathing_irregularity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deviation of successive differences of beats between 300 and 2000 ms."""
    order = W.partitionBy(*keys).orderBy("timestamp")
    v = df.where("rr1_ms > 300 and rr1_ms < 2000").withColumn(
        "d", F.col("rr1_ms") - F.lag("rr1_ms").over(order)
    )
    return v.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 4, F.stddev_pop("d")).otherwise(0.0).alias("breath_irreg")
    )
