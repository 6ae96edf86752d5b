"""Physiological aggregates per day or night."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import clamp, valid_rr
from nocturne.operators.nights import DAY, NIGHT
from nocturne.operators.series import resting_hr_columns, resting_hr_of, sws_hrv
from nocturne.schema import ABSOLUTE_ZONES, HYPNOGRAM_CODE, RELATIVE_BOUNDS, RELATIVE_WEIGHTS, STAGES

# ------------------------------------------------------------------- HR zones


def relative_zone_columns(max_hr: int = 200, hr: str = "hr", above: int = 0,
                          per_minute: float = 60.0) -> dict[str, Column]:
    """Minutes per share-of-maximum zone; the last zone is open at the top."""
    h = F.when(F.col(hr) > above, F.col(hr))
    out = {}
    for i, lo in enumerate(RELATIVE_BOUNDS[:-1]):
        inside = h >= max_hr * lo
        if i < 4:
            inside = inside & (h < max_hr * RELATIVE_BOUNDS[i + 1])
        out[f"zone{i + 1}_min"] = F.count(F.when(inside, 1)) / per_minute
    return out


def zone_load_column(max_hr: int = 200, hr: str = "hr", above: int = 30,
                     per_minute: float = 60.0) -> Column:
    zones = relative_zone_columns(max_hr, hr, above, per_minute)
    load = F.lit(0.0)
    for minutes, weight in zip(zones.values(), RELATIVE_WEIGHTS):
        load = load + minutes * weight
    return load


def zone_load(df: DataFrame, keys: list[str] = DAY, max_hr: int = 200) -> DataFrame:
    zones = relative_zone_columns(max_hr, above=30)
    return df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in zones.items()], zone_load_column(max_hr).alias("zone_load")
    )


def coverage_scale(valid: Column, total: Column) -> Column:
    """Factor that makes up for missing heart rate: ``min(3, total / valid)`` above 10 %."""
    coverage = valid / total
    return F.when(coverage > 0.1, F.least(F.lit(3.0), 1.0 / coverage)).otherwise(1.0)


def coverage(df: DataFrame, keys: list[str] = DAY, above: int = 30) -> DataFrame:
    valid = F.count(F.when(F.col("hr") > above, 1))
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (valid / total).alias("coverage"), coverage_scale(valid, total).alias("scale")
    )


def absolute_zone_load(df: DataFrame, keys: list[str] = DAY) -> DataFrame:
    """Minutes per absolute zone and their weighted load."""
    h = F.when(F.col("hr") > 30, F.col("hr"))
    minutes = [
        F.count(F.when((h >= lo) & (h <= hi), 1)) / 60.0 for lo, hi, _ in ABSOLUTE_ZONES
    ]
    load = F.lit(0.0)
    for m, (_, _, weight) in zip(minutes, ABSOLUTE_ZONES):
        load = load + m * weight
    return df.groupBy(*keys).agg(
        *[m.alias(f"zone{i}_min") for i, m in enumerate(minutes)],
        load.alias("zone_load"),
        F.count(h).alias("n_valid"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def zone_histogram(df: DataFrame, max_hr: int = 189) -> DataFrame:
    """Rows per rest/easy/moderate/hard/max zone with whole-number bounds."""
    bound = [int(max_hr * b) for b in RELATIVE_BOUNDS[:4]]
    zone = (
        F.when(F.col("hr") < bound[0], "rest").when(F.col("hr") < bound[1], "easy")
        .when(F.col("hr") < bound[2], "moderate").when(F.col("hr") < bound[3], "hard").otherwise("max")
    )
    return df.where("hr > 30").groupBy("user_id", zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def zone_chip(hr: Column) -> Column:
    """Live zone 0 to 5 of a heart rate."""
    return (
        F.when(hr < 100, 0).when(hr < 120, 1).when(hr < 140, 2).when(hr < 160, 3).when(hr < 180, 4).otherwise(5)
    )


# ------------------------------------------------------------ HRV time domain


def beat_differences(df: DataFrame, keys: list[str], rr: str = "rr1_ms", order: str | list[str] = "timestamp",
                     above: int = 200, below: int = 2500) -> DataFrame:
    """Valid beats with ``rr`` and the difference ``d`` to the previous valid beat."""
    order = [order] if isinstance(order, str) else order
    v = df.withColumn("rr", valid_rr(F.col(rr), above, below)).where("rr is not null")
    return v.withColumn("d", F.col("rr") - F.lag("rr").over(W.partitionBy(*keys).orderBy(*order)))


def hrv_time_domain(df: DataFrame, keys: list[str] = NIGHT, min_beats: int = 10,
                    artefact_ms: int = 200, min_clean: int = 10) -> DataFrame:
    """RMSSD plain and without artefacts, SDNN, pNN50, pNN20, Poincaré axes in both
    definitions, variation coefficient and the complexity proxy (variation times 20)."""
    v = beat_differences(df, keys).withColumn("s", 2 * F.col("rr") - F.col("d"))
    d = F.col("d")
    clean = F.when(F.abs(d) < artefact_ms, d)
    enough = F.count(F.lit(1)) >= min_beats
    sd = F.stddev_pop("rr")
    sd1 = F.stddev_pop(d) / F.sqrt(F.lit(2.0))
    sd2 = F.stddev_pop("s") / F.sqrt(F.lit(2.0))
    sd1_clean = F.stddev_pop(clean) / F.sqrt(F.lit(2.0))
    sd2_total = F.sqrt(F.greatest(2 * sd * sd - sd1_clean * sd1_clean, F.lit(0.01)))
    return v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rr"),
        F.when(enough, F.sqrt(F.avg(d * d))).otherwise(0.0).alias("rmssd"),
        F.when(F.count(clean) >= min_clean, F.sqrt(F.avg(clean * clean))).otherwise(0.0).alias("rmssd_clean"),
        F.when(enough, sd).otherwise(0.0).alias("sdnn"),
        F.when(enough, 100.0 * F.sum((F.abs(d) > 50).cast("int")) / F.count(d)).otherwise(0.0).alias("pnn50"),
        F.when(enough, 100.0 * F.sum((F.abs(d) > 20).cast("int")) / F.count(d)).otherwise(0.0).alias("pnn20"),
        sd1.alias("sd1"),
        sd2.alias("sd2"),
        F.when(sd2 > 0.01, sd1 / sd2).otherwise(1.0).alias("sd_ratio"),
        sd2_total.alias("sd2_total"),
        (sd / F.avg("rr")).alias("cv"),
        (sd / F.avg("rr") * 20).alias("complexity"),
    )


def daily_rmssd(df: DataFrame, min_beats: int = 10) -> DataFrame:
    """RMSSD per user and UTC day with enough beats between 200 and 2000 ms."""
    day = df.withColumn("date", F.to_date(F.timestamp_seconds("timestamp")))
    v = beat_differences(day, DAY, below=2000)
    return v.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n_rr"), F.bround(F.sqrt(F.avg(F.col("d") * F.col("d"))), 1).alias("rmssd")
    ).where(F.col("n_rr") >= min_beats)


def flattened_hrv(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """RMSSD and SDNN over all beats of a record in order, per 24-hour slice back
    from ``as_of`` (seconds). Slices keep the groups bounded by one day."""
    age = as_of - F.col("timestamp")
    recent = df.where((age > 0) & (age <= days * 86400)).withColumn(
        "slice", F.floor((age - 1) / 86400).cast("int")
    )
    beats = recent.select(
        "user_id", "slice", "timestamp",
        F.posexplode(F.array("rr1_ms", "rr2_ms", "rr3_ms")).alias("at", "beat"),
    )
    v = beat_differences(beats, ["user_id", "slice"], "beat", ["timestamp", "at"], below=2000)
    return v.groupBy("user_id", "slice").agg(
        F.count(F.lit(1)).alias("n_rr"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"),
        F.stddev_pop("rr").alias("sdnn"),
    ).where("n_rr >= 2")


# --------------------------------------------------------- entropy and shapes


def binned_entropy(df: DataFrame, value: str, width: float, keys: list[str]) -> DataFrame:
    """Shannon entropy in bits over bins of ``width`` that start half a bin below the minimum."""
    low = F.min(value).over(W.partitionBy(*keys))
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "bin", F.floor((F.col(value) - (low - width / 2)) / width)
    )
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    p = F.col("n") / total
    return counts.withColumn("part", -p * F.log2(p)).groupBy(*keys).agg(F.sum("part").alias("entropy"))


# ---------------------------------------------------------------- daily row


def daily_features(df: DataFrame, keys: list[str] = DAY, rows: int = 300, step: int = 30,
                   max_hr: int = 200) -> DataFrame:
    """One feature row per user and day; resting heart rate and beat differences are
    window columns of the same shuffle, so a single aggregation follows."""
    order = W.partitionBy(*keys).orderBy("timestamp")
    v = resting_hr_columns(df, keys, rows, step)
    v = v.withColumn("rr", valid_rr(F.col("rr1_ms")))
    previous = F.last("rr", True).over(order.rowsBetween(W.unboundedPreceding, -1))
    v = v.withColumn("d", F.col("rr") - previous)
    hr = F.when(F.col("hr") > 0, F.col("hr"))
    q = F.percentile(hr, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.75, 0.95)]))
    beats = F.count("rr") >= 10
    zones = relative_zone_columns(max_hr)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count(hr).alias("n_valid_hr"),
        zero(F.avg(hr)).alias("hr_mean"),
        zero(F.stddev_pop(hr)).alias("hr_std"),
        F.coalesce(F.min(hr), F.lit(0)).alias("hr_min"),
        F.coalesce(F.max(hr), F.lit(0)).alias("hr_max"),
        q.alias("q"),
        resting_hr_of(rows).alias("rhr"),
        F.when(beats, F.sqrt(F.avg(F.col("d") * F.col("d")))).otherwise(0.0).alias("rmssd"),
        F.when(beats, F.stddev_pop("rr")).otherwise(0.0).alias("hrv_sdnn"),
        F.when(beats, 100.0 * F.sum((F.abs("d") > 50).cast("int")) / F.count("d")).otherwise(0.0).alias("pnn50"),
        F.avg("movement").alias("movement_mean"),
        F.stddev_samp("movement").alias("movement_std"),
        F.max("movement").alias("movement_max"),
        F.percentile("movement", F.lit(0.9)).alias("movement_p90"),
        *[c.alias(n) for n, c in zones.items()],
        zone_load_column(max_hr).alias("zone_load"),
        F.count(F.when(F.col("hr") > 30, 1)).alias("n_hr30"),
        F.coalesce(F.avg("spo2"), F.lit(97.0)).alias("spo2_mean"),
        F.coalesce(F.min("spo2").cast("double"), F.lit(95.0)).alias("spo2_min"),
    )
    return out.select(
        "*", *[zero(F.col("q")[i]).alias(f"hr_p{p}") for i, p in enumerate((5, 25, 75, 95))]
    ).drop("q")


# ------------------------------------------------------------ table statistics


def overall_statistics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Heart-rate and oxygen statistics over valid rows."""
    hr = F.when(F.col("hr") > 0, F.col("hr"))
    spo2 = F.when((F.col("spo2") > 10) & (F.col("spo2") <= 100), F.col("spo2"))
    return df.groupBy(*(keys or [])).agg(
        F.avg(hr).alias("hr_avg"), F.min(hr).alias("hr_min"), F.max(hr).alias("hr_max"),
        F.avg(spo2).alias("spo2_avg"), F.count(hr).alias("n_hr"), F.count(spo2).alias("n_spo2"),
    )


def table_extent(df: DataFrame, keys: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Row count, first and last timestamp, days with data."""
    day = F.floor(F.col("timestamp") / 86400)
    days = F.approx_count_distinct(day) if approximate else F.count_distinct(day)
    return df.where("timestamp > 0").groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"), days.alias("n_days"),
    )


def daily_mean_hr(df: DataFrame) -> DataFrame:
    day = F.to_date(F.timestamp_seconds("timestamp")).alias("date")
    return df.where("hr > 30").groupBy("user_id", day).agg(F.bround(F.avg("hr"), 1).alias("avg_hr"))


# ------------------------------------------------------------- stage summaries


def stage_summary(df: DataFrame, window_min: float, keys: list[str] = NIGHT, value: str = "phase") -> DataFrame:
    """Minutes, shares and efficiency per night, one decimal, half to even."""
    n = {s: F.sum((F.col(value) == s).cast("int")) for s in [*STAGES, "unknown"]}
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[c.alias(s) for s, c in n.items()])
    total = F.col("total")
    asleep = total - F.col("awake") - F.col("unknown")
    minutes = lambda c: F.bround(c * window_min, 1)
    share = lambda c: F.bround(100.0 * c / total, 1)
    return counted.select(
        *keys, "total",
        minutes(total).alias("total_min"), minutes(asleep).alias("sleep_min"),
        share(asleep).alias("efficiency"),
        *[minutes(F.col(s)).alias(f"{s}_min") for s in STAGES],
        *[share(F.col(s)).alias(f"{s}_pct") for s in STAGES],
    )


def hypnogram_statistics(df: DataFrame, window_s: int, keys: list[str] = NIGHT, value: str = "phase") -> DataFrame:
    """Total sleep time, sleep efficiency and stage shares of a hypnogram."""
    summary = stage_summary(df, window_s / 60.0, keys, value)
    sleep = (F.col("total") - F.round(F.col("awake_min") / (window_s / 60.0))) * (window_s / 60.0)
    return summary.select(
        *keys, F.bround(sleep, 1).alias("tst_min"),
        F.format_string("%d:%02d", F.floor(sleep / 60).cast("int"), F.floor(sleep % 60).cast("int")).alias("tst_hours"),
        F.bround(100.0 * sleep / (F.col("total") * (window_s / 60.0)), 1).alias("se"),
        *[F.col(f"{s}_pct") for s in STAGES], *[F.col(f"{s}_min") for s in STAGES],
    )


def hypnogram_code(stage: Column) -> Column:
    out = F.lit(2)
    for name, code in HYPNOGRAM_CODE.items():
        out = F.when(stage == name, code).otherwise(out)
    return out


def baselines(df: DataFrame, most: int = 300, min_rows: int = 300, min_hr: int = 100) -> DataFrame:
    """Median nightly HRV (above 10) and median of nightly (p25 + median) / 2 per user,
    90 and 55 where there is none."""
    gated = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*NIGHT))).where(F.col("_n") >= min_rows)
    hrv = sws_hrv(gated, NIGHT, most)
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    rest = gated.groupBy(*NIGHT).agg(
        F.when(
            F.count(hr) > min_hr, (F.percentile(hr, F.lit(0.25)) + F.percentile(hr, F.lit(0.5))) / 2
        ).alias("rest")
    )
    half = F.lit(0.5)
    return rest.join(hrv, NIGHT, "left").groupBy("user_id").agg(
        F.coalesce(F.percentile(F.when(F.col("hrv") > 10, F.col("hrv")), half), F.lit(90.0)).alias("hrv_base"),
        F.coalesce(F.percentile("rest", half), F.lit(55.0)).alias("rhr_base"),
    )


def bounded_score(c: Column) -> Column:
    """Whole score between 0 and 100, half to even."""
    return clamp(F.bround(c, 0), 0.0, 100.0)
