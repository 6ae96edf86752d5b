"""Per-window physiology: one set of derived columns, one aggregation.

``with_beats`` adds successive differences inside each group, ``window_stats``
aggregates a group to one row. Both list everything the stagers and feature
builders use; Catalyst drops what a caller does not select, and all of it runs
on the partitioning of the group keys without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import valid_hr, valid_rr

NIGHT_WIN = ["user_id", "night", "win"]


def previous_valid(c: Column, order) -> Column:
    """Last non-NULL value before this row."""
    return F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))


def with_beats(df: DataFrame, keys: list[str] = NIGHT_WIN, hr_above: int = 30,
               rr_above: int = 200, rr_below: int = 2500) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("timestamp")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy(*keys)
    df = df.withColumns(
        {
            "hr_ok": valid_hr(F.col("hr"), hr_above),
            "rr_ok": valid_rr(F.col("rr1_ms"), rr_above, rr_below),
            "acc_mag": F.sqrt(
                F.col("acc_x") * F.col("acc_x") + F.col("acc_y") * F.col("acc_y")
                + F.col("acc_z") * F.col("acc_z")
            ),
        }
    )
    df = df.withColumns(
        {
            "row_in": F.row_number().over(order) - 1,
            "rows_in": F.count(F.lit(1)).over(group),
            "hr_at": F.count("hr_ok").over(running),
            "rr_at": F.count("rr_ok").over(running),
            "d_hr": F.col("hr_ok") - previous_valid(F.col("hr_ok"), order),
            "d_rr": F.col("rr_ok") - previous_valid(F.col("rr_ok"), order),
            "d_mag": F.abs(F.col("acc_mag") - F.lag("acc_mag").over(order)),
            "mag_sign": F.signum(F.col("acc_mag") - F.avg("acc_mag").over(group)),
            "hr_low": F.min("hr_ok").over(group),
            "rr_low": F.min("rr_ok").over(group),
            "was_moving": F.lag(F.col("movement") > 0.1).over(order),
            "was_burst": F.lag(F.col("movement") > 0.08).over(order),
        }
    )
    return df.withColumns(
        {
            "d2_hr": F.col("d_hr") - previous_valid(F.col("d_hr"), order),
            "sum_rr": F.col("rr_ok") + previous_valid(F.col("rr_ok"), order),
            "mag_cross": (F.col("mag_sign") != F.lag("mag_sign").over(order)).cast("int"),
            "hr_bin": F.floor((F.col("hr_ok") - (F.col("hr_low") - 2.5)) / 5.0),
            "rr_bin": F.floor((F.col("rr_ok") - (F.col("rr_low") - 25.0)) / 50.0),
        }
    )


def with_bins(df: DataFrame, keys: list[str] = NIGHT_WIN) -> DataFrame:
    """Rows per occupied bin, for the entropies: ``-avg(log2(rows in bin / rows))``."""
    hr_bin = F.count("hr_ok").over(W.partitionBy(*keys, "hr_bin"))
    rr_bin = F.count("rr_ok").over(W.partitionBy(*keys, "rr_bin"))
    hr_all = F.count("hr_ok").over(W.partitionBy(*keys))
    rr_all = F.count("rr_ok").over(W.partitionBy(*keys))
    return df.withColumns(
        {
            "hr_surprise": F.when(F.col("hr_ok").isNotNull(), -F.log2(hr_bin / hr_all)),
            "rr_surprise": F.when(F.col("rr_ok").isNotNull(), -F.log2(rr_bin / rr_all)),
        }
    )


def window_stats(df: DataFrame, keys: list[str] = NIGHT_WIN) -> DataFrame:
    """One row per group of a ``with_beats`` (and for entropies ``with_bins``) frame."""
    d = F.col("d_rr")
    clean = F.when(F.abs(d) < 300, d)
    tight = F.when(F.abs(d) < 200, d)
    mv = F.col("movement")
    gyro = F.col("gyro")
    gyro_nz = F.when(F.abs(gyro) > 0.001, gyro)
    mag_nz = F.when(F.col("acc_mag") > 0.01, F.col("acc_mag"))
    quantiles = F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("last_ts"),
        F.max(F.when(F.col("row_in") == F.floor(F.col("rows_in") / 2), F.col("timestamp"))).alias("mid_ts"),
        F.count("hr_ok").alias("n_hr"),
        F.avg("hr_ok").alias("hr_mean"),
        F.stddev_pop("hr_ok").alias("hr_std"),
        F.min("hr_ok").alias("hr_min"),
        F.max("hr_ok").alias("hr_max"),
        F.percentile("hr_ok", quantiles).alias("hr_q"),
        F.regr_slope(F.col("hr_ok").cast("double"), F.col("hr_at").cast("double")).alias("hr_slope"),
        F.avg(F.abs("d_hr")).alias("hr_masd"),
        F.stddev_pop(F.abs("d_hr")).alias("hr_masd_std"),
        F.skewness("hr_ok").alias("hr_skew"),
        F.kurtosis("hr_ok").alias("hr_kurt"),
        F.avg(F.abs("d2_hr")).alias("hr_accel"),
        F.var_pop("d2_hr").alias("hr_accel_var"),
        F.sum((F.abs("d_hr") > 5).cast("int")).alias("hr_jumps"),
        F.count("rr_ok").alias("n_rr"),
        F.avg("rr_ok").alias("rr_mean"),
        F.stddev_pop("rr_ok").alias("rr_std"),
        F.regr_slope(F.col("rr_ok"), F.col("rr_at").cast("double")).alias("rr_slope"),
        F.count(clean).alias("n_d300"),
        F.sqrt(F.avg(clean * clean)).alias("rmssd300"),
        F.stddev_pop(clean).alias("sd_d300"),
        F.sum((F.abs(clean) > 50).cast("int")).alias("n50"),
        F.sum((F.abs(clean) > 20).cast("int")).alias("n20"),
        F.count(tight).alias("n_d200"),
        F.sqrt(F.avg(tight * tight)).alias("rmssd200"),
        F.count(d).alias("n_d"),
        F.sqrt(F.avg(d * d)).alias("rmssd_all"),
        F.sum((F.abs(d) > 50).cast("int")).alias("n50_all"),
        F.stddev_pop(d).alias("sd_d"),
        F.stddev_pop("sum_rr").alias("sd_sum"),
        F.avg(mv).alias("mv_mean"),
        F.stddev_pop(mv).alias("mv_std"),
        F.max(mv).alias("mv_max"),
        F.percentile(mv, F.array(F.lit(0.9), F.lit(0.95))).alias("mv_q"),
        F.sum(mv * mv).alias("mv_energy"),
        F.sum(((mv > 0.1) != F.col("was_moving")).cast("int")).alias("mv_changes"),
        F.sum(((mv > 0.08) & ~F.col("was_burst")).cast("int")).alias("mv_bursts"),
        F.avg((mv > 0.05).cast("double")).alias("mv_active"),
        F.stddev_pop("acc_x").alias("acc_x_std"),
        F.stddev_pop("acc_y").alias("acc_y_std"),
        F.stddev_pop("acc_mag").alias("acc_mag_std"),
        F.var_pop("acc_z").alias("acc_z_var"),
        F.avg(mag_nz).alias("mag_mean"),
        F.stddev_pop(mag_nz).alias("mag_std"),
        F.avg(mag_nz * mag_nz).alias("mag_energy"),
        F.max("d_mag").alias("jerk_max"),
        F.percentile("d_mag", F.lit(0.95)).alias("jerk_p95"),
        F.sum("mag_cross").alias("mag_crossings"),
        F.avg(F.abs(gyro)).alias("gyro_abs"),
        F.stddev_pop(gyro).alias("gyro_std"),
        F.max(F.abs(gyro)).alias("gyro_max"),
        F.avg(F.abs(gyro_nz)).alias("gyro_nz_abs"),
        F.stddev_pop(gyro_nz).alias("gyro_nz_std"),
        F.sum((F.abs(gyro) > 0.05).cast("int")).alias("gyro_spikes"),
        F.avg("spo2").alias("spo2_mean"),
        F.min("spo2").alias("spo2_min"),
        F.count("spo2").alias("n_spo2"),
        F.stddev_pop("spo2").alias("spo2_std"),
        F.sort_array(
            F.collect_list(F.when(F.col("rr_ok").isNotNull(), F.struct("timestamp", "rr_ok")))
        ).alias("rr_rows"),
    ]
    if "hr_surprise" in df.columns:
        aggs += [
            F.avg("hr_surprise").alias("hr_entropy"),
            F.avg("rr_surprise").alias("rr_entropy"),
        ]
    if "hr_f25" in df.columns:
        aggs += [F.max("hr_f25").alias("hr_f25"), F.max("hr_f75").alias("hr_f75")]
    if "label" in df.columns:
        aggs.append(F.mode("label", True).alias("label"))
    stats = df.groupBy(*keys).agg(*aggs)
    return (
        stats.withColumns(
            {
                "hr_p10": F.col("hr_q")[0],
                "hr_p25": F.col("hr_q")[1],
                "hr_med": F.col("hr_q")[2],
                "hr_p75": F.col("hr_q")[3],
                "hr_p90": F.col("hr_q")[4],
                "mv_p90": F.col("mv_q")[0],
                "mv_p95": F.col("mv_q")[1],
                "rr_list": F.col("rr_rows.rr_ok"),
            }
        )
        .drop("hr_q", "mv_q", "rr_rows")
    )


def iqr(rows_needed: int = 10) -> Column:
    """Interquartile range of the heart rate; its deviation in thin windows."""
    return F.when(F.col("n_hr") > rows_needed, F.col("hr_p75") - F.col("hr_p25")).otherwise(
        F.coalesce(F.col("hr_std"), F.lit(0.0))
    )


def local_rmssd(min_rr: int = 5, min_diffs: int = 3) -> Column:
    """RMSSD over differences below 300 ms, 0 where too few beats are left."""
    enough = (F.col("n_rr") > min_rr) & (F.col("n_d300") > min_diffs)
    return F.when(enough, F.col("rmssd300")).otherwise(0.0)
