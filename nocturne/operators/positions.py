"""Row positions, windows of rows and windows of time.

All functions partition by the given keys. Hash partitioning on (user, night)
also satisfies (user, night, win), so positions, windows and per-window
aggregates cost one shuffle together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators.nights import NIGHT


def with_position(df: DataFrame, keys: list[str] = NIGHT, order: str = "timestamp") -> DataFrame:
    """``pos`` counts from 0 within the group, ``n`` is the group size."""
    return df.withColumns(
        {
            "pos": F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1,
            "n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        }
    )


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of about ``each`` rows, enough of them for every core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def sliced_position(df: DataFrame, key: str, slice_by: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """0-based position within ``key`` when one key may hold most of the rows.

    ``slice_by`` must be the leading order column. Rows are numbered inside
    (key, slice); slice sizes, one row each, are summed up in order and added.
    No task ever sorts a whole hot key. ``tasks`` sets how many tasks sort the rows, else the session does.
    """
    sizes = df.groupBy(key, slice_by).agg(F.count(F.lit(1)).alias("_size"))
    before = (
        F.sum("_size").over(
            W.partitionBy(key).orderBy(slice_by).rowsBetween(W.unboundedPreceding, -1)
        )
    )
    starts = sizes.select(key, slice_by, F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(key, slice_by).orderBy(*order)) - 1
    dealt = df.repartition(tasks, key, slice_by) if tasks else df
    return (
        dealt.withColumn("_inside", inside)
        .join(starts, [key, slice_by])
        .withColumn("pos", F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )


def tumbling(df: DataFrame, rows: int) -> DataFrame:
    """Windows of ``rows`` rows; as in the scored algorithms a window must start
    before ``n - rows``, which drops the tail and an exactly filled last window."""
    win = F.floor(F.col("pos") / rows).cast("int")
    return df.withColumn("win", win).where(F.col("win") * rows < F.col("n") - rows)


def sliding(df: DataFrame, rows: int, stride: int) -> DataFrame:
    """Overlapping windows; each row repeats in at most ``ceil(rows / stride)`` of them."""
    if stride > rows:
        raise ValueError("stride must not exceed the window")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - rows) / stride) + 1)
    last = F.floor(F.col("pos") / stride)
    return (
        df.withColumn("win", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .where(F.col("win") * stride < F.col("n") - rows)
    )


def chunks(df: DataFrame, rows: int) -> DataFrame:
    """Consecutive chunks that keep the tail."""
    return df.withColumn("win", F.floor(F.col("pos") / rows).cast("int"))


def time_windows(df: DataFrame, seconds: int = 120) -> DataFrame:
    """Windows ``[start + k*seconds, …)`` aligned to the ``start_ts`` column;
    only windows that end by ``end_ts``."""
    win = F.floor((F.col("timestamp") - F.col("start_ts")) / seconds).cast("int")
    return df.withColumn("win", win).where(
        (F.col("win") >= 0) & (F.col("start_ts") + (F.col("win") + 1) * seconds <= F.col("end_ts"))
    )


def window_spine(bounds: DataFrame, seconds: int = 120) -> DataFrame:
    """Every whole window of every bounded night, with or without data."""
    count = F.floor((F.col("end_ts") - F.col("start_ts")) / seconds).cast("int")
    return bounds.withColumn("_n", count).where("_n > 0").withColumn(
        "win", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    ).drop("_n")


def running_sum(c: Column, keys: list[str], order: str = "timestamp") -> Column:
    return F.sum(c).over(
        W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )


def forward_sum(df: DataFrame, value: Column, rows: int, name: str, keys: list[str],
                order: str = "timestamp") -> DataFrame:
    """Sum over this row and the ``rows - 1`` following ones, NULL where fewer follow.

    Running sums and one ``lead`` make it linear in the group size; a sliding
    frame would add up ``rows`` values per row.
    """
    running = f"_run_{name}"
    df = df.withColumn(name, F.coalesce(value, F.lit(0)))
    df = df.withColumn(running, running_sum(F.col(name), keys, order))
    ahead = F.lead(running, rows - 1).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, ahead - (F.col(running) - F.col(name))).drop(running)


def downsample(df: DataFrame, keys: list[str], max_points: int, order: str = "timestamp") -> DataFrame:
    """At most ``max_points`` rows per group, at indices ``floor(k * n / max_points)``."""
    ranked = with_position(df, keys, order)
    pos, n = F.col("pos").cast("long"), F.col("n")
    k = F.floor((pos * max_points + n - 1) / n)
    keep = (n <= max_points) | ((k < max_points) & (F.floor(k * n / max_points) == pos))
    return ranked.where(keep).drop("pos", "n")


def chunk_means(df: DataFrame, keys: list[str], rows: int, hr_above: int = 0) -> DataFrame:
    """Chart series: means per chunk of rows, 0 where no heart rate is valid."""
    cut = chunks(with_position(df, keys), rows)
    hr = F.when(F.col("hr") > hr_above, F.col("hr"))
    return cut.groupBy(*keys, "win").agg(
        F.min("timestamp").alias("start_ts"),
        F.coalesce(F.avg(hr), F.lit(0.0)).alias("hr"),
        F.avg("movement").alias("movement"),
        F.avg("spo2").alias("spo2"),
        F.avg("rr1_ms").alias("rr_ms"),
        F.min_by("acc_x", "timestamp").alias("acc_x"),
    )
