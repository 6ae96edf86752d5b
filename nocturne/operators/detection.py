"""Detection of sleep bounds, activity bouts, sleep periods and stress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.functions.scalars import stress_level
from nocturne.operators import positions, spectral
from nocturne.operators.aggregates import zone_load_column
from nocturne.operators.nights import DAY, NIGHT
from nocturne.operators.scores import calories, strain


def sleep_bounds(df: DataFrame, rows: int = 300, step: int = 60, hr_drop: float = 5.0, gyro_limit: float = 0.1,
                 head: int = 1800, min_head: int = 60, min_valid: int = 30, min_rows: int = 600,
                 min_span_s: int = 10800, keys: list[str] = NIGHT) -> DataFrame:
    """Onset and offset per night with the bounds to use.

    Baseline: median heart rate of the first ``min(head, n // 3)`` rows. Onset: first
    window at ``step`` whose mean is ``hr_drop`` below it with a still gyro. Offset:
    from the end backwards, the first window that moves and is within 3 of the drop.
    Detected bounds count only where they span ``min_span_s``.
    """
    group = W.partitionBy(*keys)
    order = group.orderBy("timestamp")
    v = positions.with_position(df, keys)
    early = F.col("pos") < F.least(F.lit(head), F.floor(F.col("n") / 3))
    v = v.withColumns(
        {
            "h": F.when(F.col("hr") > 30, F.col("hr")),
            "base_n": F.count(F.when(early & (F.col("hr") > 30), 1)).over(group),
            "base": F.percentile(F.when(early & (F.col("hr") > 30), F.col("hr")), F.lit(0.5)).over(group),
        }
    )
    v = positions.forward_sum(v, F.col("h").cast("long"), rows, "h_sum", keys)
    v = positions.forward_sum(v, F.when(F.col("h").isNotNull(), 1), rows, "h_n", keys)
    v = positions.forward_sum(v, F.when(F.abs("gyro") >= gyro_limit, 1), rows, "g_n", keys)
    v = positions.forward_sum(v, F.when(F.abs("gyro") > gyro_limit, 1), rows, "g_over", keys)
    ok = (F.col("base_n") >= min_head) & (F.col("n") >= min_rows) & (F.col("h_n") >= min_valid)
    mean = F.col("h_sum") / F.col("h_n")
    opens = (
        ok & (F.col("pos") % step == 0) & (F.col("pos") < F.col("n") - rows)
        & (F.col("base") - mean >= hr_drop) & (F.col("g_n") == 0)
    )
    # a window [i - rows, i) that ends at row i = n - 1, n - 1 - step, …
    at = F.col("pos") + rows
    closes = (
        ok & (at <= F.col("n") - 1) & (at > rows) & ((F.col("n") - 1 - at) % step == 0)
        & (F.col("g_over") > 0) & (mean > F.col("base") - hr_drop + 3)
    )
    v = v.withColumn("ts_at", F.lead("timestamp", rows).over(order))
    found = v.withColumns({"_opens": opens, "_closes": closes}).groupBy(*keys).agg(
        F.min(F.when(F.col("_opens"), F.col("timestamp"))).alias("onset_ts"),
        F.max(F.when(F.col("_closes"), F.col("ts_at"))).alias("offset_ts"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    on, off = F.col("onset_ts"), F.col("offset_ts")
    both = on.isNotNull() & off.isNotNull() & (off > on)
    long_both = both & (off - on >= min_span_s)
    long_on = ~F.coalesce(both, F.lit(False)) & on.isNotNull() & (F.col("last_ts") - on >= min_span_s)
    long_off = on.isNull() & (off > F.col("first_ts")) & (off - F.col("first_ts") >= min_span_s)
    return found.withColumns(
        {
            "sleep_start": F.when(long_both | long_on, on).otherwise(F.col("first_ts")),
            "sleep_end": F.when(long_both | long_off, off).otherwise(F.col("last_ts")),
        }
    )


def activity_bouts(df: DataFrame, max_hr: int = 200, gap_rows: int = 30, min_s: int = 300,
                   keys: list[str] = DAY) -> DataFrame:
    """Bouts at or above half of the maximum heart rate.

    Fewer than ``gap_rows`` rows below the threshold are bridged; missing heart rate
    counts as below. A bout runs from its first to its last row above.
    """
    order = W.partitionBy(*keys).orderBy("timestamp")
    v = positions.with_position(df, keys).withColumn("above", F.col("hr") >= max_hr * 0.5)
    before = F.max(F.when(F.col("above"), F.col("pos"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.col("above") & (F.coalesce(F.col("pos") - before, F.lit(gap_rows + 1)) > gap_rows)
    v = v.withColumn("_start", starts.cast("int"))
    v = v.withColumn("bout", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    v = v.withColumn(
        "_last", F.max(F.when(F.col("above"), F.col("pos"))).over(W.partitionBy(*keys, "bout"))
    ).where("bout > 0")
    inside = v.where(F.col("pos") <= F.col("_last"))
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    return (
        inside.groupBy(*keys, "bout")
        .agg(
            F.min("timestamp").alias("start_ts"),
            F.max("timestamp").alias("end_ts"),
            F.bround(F.avg(hr), 1).alias("avg_hr"),
            F.max(hr).alias("max_hr"),
            zone_load_column(max_hr).alias("zone_load"),
            F.count(hr).alias("n_hr30"),
            F.count(F.when(hr > max_hr * 0.8, 1)).alias("n_high"),
        )
        .where(F.col("end_ts") - F.col("start_ts") >= min_s)
        .select(
            *keys, "start_ts", "end_ts",
            F.bround((F.col("end_ts") - F.col("start_ts")) / 60, 1).alias("duration_min"),
            "avg_hr", "max_hr", strain().alias("strain"), F.bround(calories(), 0).alias("calories"),
        )
    )


def sleep_periods(df: DataFrame, rows: int = 60, hr_below: float = 70.0, variance_below: float = 0.01,
                  min_chunks: int = 5) -> DataFrame:
    """Consecutive calm chunks of a UTC day merged to periods."""
    day = df.withColumn("date", F.to_date(F.timestamp_seconds("timestamp")))
    cut = positions.tumbling(positions.with_position(day, DAY), rows)
    mag = F.sqrt(F.col("acc_x") ** 2 + F.col("acc_y") ** 2 + F.col("acc_z") ** 2)
    hr = F.when(F.col("hr") > 30, F.col("hr"))
    chunk = cut.groupBy(*DAY, "win").agg(
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
        F.avg(hr).alias("chunk_hr"), F.var_pop(mag).alias("chunk_var"),
    ).where("chunk_hr is not null")
    calm = (F.col("chunk_hr") < hr_below) & (F.col("chunk_var") < variance_below)
    order = W.partitionBy(*DAY).orderBy("win")
    marked = chunk.withColumn("calm", calm.cast("int"))
    changed = F.coalesce((F.col("calm") != F.lag("calm").over(order)).cast("int"), F.lit(1))
    marked = marked.withColumn("_c", changed).withColumn(
        "period", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    periods = marked.where("calm = 1").groupBy(*DAY, "period").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.count(F.lit(1)).alias("chunks"), (F.bround(F.avg(F.bround(F.col("chunk_hr") * 10, 0)), 0) / 10).alias("avg_hr"),
    ).where(F.col("chunks") >= min_chunks)
    minutes = F.bround((F.col("end_ts") - F.col("start_ts")) / 60, 0)
    return periods.withColumn("duration_min", minutes).withColumn(
        "total_min", F.sum("duration_min").over(W.partitionBy(*DAY))
    ).drop("period")


def stress_windows(df: DataFrame, rows: int = 300, keys: list[str] = NIGHT) -> DataFrame:
    """LF/HF and stress level per window."""
    cut = positions.tumbling(positions.with_position(df, keys), rows)
    starts = cut.groupBy(*keys, "win").agg(F.min("timestamp").alias("start_ts"))
    beats = spectral.beat_arrays(cut, [*keys, "win"])
    ratio = spectral.lf_hf(F.col("power"), 1.0)
    return (
        beats.withColumn("power", spectral.band_powers(F.col("rr_list"), 30))
        .withColumn("lf_hf", ratio)
        .join(starts, [*keys, "win"])
        .select(*keys, "win", "start_ts", F.bround("lf_hf", 2).alias("stress"), stress_level(F.col("lf_hf")).alias("level"))
    )


def stress_summary(windows: DataFrame, keys: list[str] = NIGHT) -> DataFrame:
    high = F.sum((F.col("level") == "HIGH").cast("int"))
    return windows.groupBy(*keys).agg(
        F.bround(F.avg("stress"), 2).alias("stress_avg"),
        F.bround(100.0 * high / F.count(F.lit(1)), 1).alias("stress_high_pct"),
    )
