"""Sensor tables: scan, clean-up, merge, pages and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.scalars import movement, valid_rr
from nocturne.operators.trends import keep_one
from nocturne.sources.packets import decode_frames

# Column names of the capture tables and their canonical names.
RAW_COLUMNS = {
    "timestamp": "timestamp", "heartRate": "hr", "rrCount": "rr_count", "rr1Ms": "rr1_ms", "rr2Ms": "rr2_ms",
    "rr3Ms": "rr3_ms", "accelX": "acc_x", "accelY": "acc_y", "accelZ": "acc_z", "gyro": "gyro",
    "spo2Percent": "spo2", "rawHex": "raw_hex",
}
APP_COLUMNS = {
    "timestamp": "timestamp", "heart_rate": "hr", "rr1": "rr1_ms", "rr2": "rr2_ms", "rr3": "rr3_ms",
    "accel_x": "acc_x", "accel_y": "acc_y", "accel_z": "acc_z", "gyro": "gyro", "spo2": "spo2", "raw_hex": "raw_hex",
}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A capture table in any Spark format (parquet, csv, json, orc, jdbc)."""
    return spark.read.options(**options).format(fmt).load(path)


def seconds(ts: Column) -> Column:
    """Whole seconds from seconds or milliseconds."""
    return F.when(ts > 1_000_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def _within(c: Column, limit: float) -> Column:
    return F.when(F.abs(c) < limit, c.cast("double")).otherwise(0.0)


def stored_columns() -> dict[str, Column]:
    """Values stored beside a frame, with range checks."""
    ax, ay, az = (_within(F.col(c), 20.0) for c in ("acc_x", "acc_y", "acc_z"))
    nothing = F.lit(None).cast("double")
    return {
        "timestamp": seconds(F.col("timestamp")), "hr": F.col("hr").cast("int"), "rr_count": F.coalesce("rr_count", F.lit(0)),
        "rr1_ms": valid_rr(F.col("rr1_ms").cast("double")), "rr2_ms": nothing, "rr3_ms": nothing,
        "acc_x": ax, "acc_y": ay, "acc_z": az, "movement": movement(ax, ay, az), "gyro": _within(F.col("gyro"), 50.0),
        "spo2": F.when((F.col("spo2") > 50) & (F.col("spo2") < 110), F.col("spo2").cast("int")),
    }


def scan(raw: DataFrame) -> DataFrame:
    """Canonical rows: decoded from the frame where it decodes, else from stored columns.

    Stored rows without a heart rate are dropped. One row per user and second; the first in
    table order (``id``) wins.
    """
    is_frame = (F.length("raw_hex") >= 32) & ~F.startswith("raw_hex", F.lit("hr_ble:"))
    frames = decode_frames(raw.withColumn("frame", F.when(is_frame, F.upper("raw_hex"))))
    stored = stored_columns()
    fields = [
        F.when(F.col("d_ok"), F.col("d")[f.name]).otherwise(stored[f.name].cast(f.dataType)).alias(f.name) for f in frames.schema["d"].dataType.fields
    ]
    rows = frames.select("user_id", "id", *fields, F.expr("d_ok OR hr > 30").alias("usable"))
    return keep_one(rows, ["user_id", "timestamp"], ["id"], where="usable").drop("id")


def recompute_hr(df: DataFrame) -> DataFrame:
    """Heart rate from the beat interval where none is stored, half to even."""
    from_beat = F.bround(60000.0 / F.when((F.col("rr1_ms") > 200) & (F.col("rr1_ms") < 2000), F.col("rr1_ms")), 0)
    return df.withColumn(
        "hr", F.when(F.col("hr") > 0, F.col("hr")).otherwise(F.coalesce(from_beat.cast("int"), F.lit(0)))
    )


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """Rows of several tables, the earlier table wins per user and second.

    The pick is combined before the shuffle, so copies of one key stay cheap.
    """
    ranked = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    merged = ranked[0]
    for r in ranked[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    return keep_one(merged, ["user_id", "timestamp"], ["source"])


def page(df: DataFrame, order: list[str], size: int, offset: int) -> DataFrame:
    """One page in a fixed order. For whole exports use ``write_csv`` instead."""
    return df.orderBy(*order).offset(offset).limit(size)


def export_frame(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sensor rows with the column names of the CSV export."""
    return df.select(
        *(keys or []), "timestamp", F.col("hr").alias("heart_rate"), F.col("rr1_ms").alias("rr1"), F.col("rr2_ms").alias("rr2"),
        F.col("rr3_ms").alias("rr3"), "spo2", F.col("acc_x").alias("accel_x"), F.col("acc_y").alias("accel_y"),
        F.col("acc_z").alias("accel_z"), "gyro",
    )


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Ordered CSV parts with a header, written in parallel by timestamp ranges."""
    out = df.select(*columns) if columns else df
    out.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by date, files sorted for timestamp pruning.

    Rows of a date are spread over files by user, so one user with most of the rows
    does not fill a single task: the spread key also takes the hour.
    """
    hour = F.floor(F.col("timestamp") / 3600)
    (
        df.repartition("date", "user_id", hour)
        .sortWithinPartitions("date", "user_id", "timestamp")
        .write.mode(mode).partitionBy("date").parquet(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)

