"""Canonical tables derived from the star-schema test tables.

``lineitem`` becomes a dense sensor series: the supplier is the user, its rows
in shipping order are the samples. However many rows one supplier holds, they are
one series; numbering splits it by shipping date. ``events`` becomes daily scores on
real dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators.positions import sliced_position, tasks_for

FIRST_SAMPLE_S = 1704135600
SENSOR_ROWS = 200_000  # sensor rows that one task sorts, however many there are


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_tasks(spark: SparkSession, sf_dir: str, each: int = SENSOR_ROWS) -> int:
    """Tasks of about ``each`` sensor rows; the count comes from the file footers."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count(), each)


def sensor(spark: SparkSession, sf_dir: str, step_s: int = 300) -> DataFrame:
    """Sensor rows from ``lineitem`` with a sample every ``step_s`` seconds."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    ranked = sliced_position(
        items, "l_suppkey", "l_shipdate",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], sensor_tasks(spark, sf_dir),
    )
    hr = F.when(F.col("l_discount") < 0.005, 0).otherwise((40 + F.col("l_quantity")).cast("int"))
    x, y = F.col("l_discount") * 2, F.col("l_tax") * 3
    return ranked.select(
        F.col("l_suppkey").alias("user_id"),
        (FIRST_SAMPLE_S + F.col("pos") * step_s).cast("long").alias("timestamp"),
        hr.alias("hr"),
        F.when(hr > 0, 1).otherwise(0).alias("rr_count"),
        F.when(hr > 0, 60000.0 / hr + (F.col("l_linenumber") - 4) * 15.0).alias("rr1_ms"),
        F.when((hr > 0) & (F.col("l_linenumber") > 4), 60000.0 / hr - 10.0).alias("rr2_ms"),
        F.lit(None).cast("double").alias("rr3_ms"),
        x.alias("acc_x"),
        y.alias("acc_y"),
        F.lit(1.0).alias("acc_z"),
        F.abs(F.sqrt(x * x + y * y + 1.0) - 1.0).alias("movement"),
        (F.col("l_tax") - 0.04).alias("gyro"),
        F.when(F.col("l_linenumber") != 3, (90 + F.col("l_linenumber")).cast("int")).alias("spo2"),
        (F.col("l_orderkey") % 4).cast("int").alias("label"),
    )


def event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse heart-rate rows from ``events``, one per user and second.

    The earliest event of a second wins; the minimum is combined before the
    shuffle, so a user with a third of all events stays cheap.
    """
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        F.floor(F.unix_micros(ts) / 1_000_000).alias("timestamp"),
        F.struct("event_id", "event_type", "value").alias("e"),
    )
    first = rows.groupBy("user_id", "timestamp").agg(F.min("e").alias("e"))
    return first.select(
        "user_id", "timestamp",
        (40 + F.col("e.value").cast("int") % 60).alias("hr"),
        F.col("e.event_id").alias("event_id"),
        F.col("e.event_type").alias("event_type"),
    )


def daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of own scores per user and date, from integer sums of ``events``."""
    ts = F.col("ts").cast("timestamp")
    cents = F.round(F.col("value") * 100).cast("long")
    sums = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date(ts).alias("date"))
        .agg(
            F.sum(cents).alias("v"),
            F.sum("event_id").alias("e"),
            F.count(F.lit(1)).alias("n_events"),
            F.max((F.col("event_type") == "view").cast("int")).alias("has_view"),
            F.max((F.col("event_type") == "purchase").cast("int")).alias("has_purchase"),
        )
    )
    v, e = F.col("v"), F.col("e")
    return sums.select(
        "user_id", "date",
        (v % 101).cast("double").alias("recovery"),
        (e % 101).cast("double").alias("sleep"),
        ((v % 211) / 10.0).alias("strain"),
        (20 + e % 100).cast("double").alias("hrv"),
        (45 + v % 25).cast("double").alias("rhr"),
        (12 + e % 7).cast("double").alias("resp"),
        (4 + (e % 60) / 10.0).alias("sleep_hours"),
        (70 + v % 31).cast("double").alias("efficiency"),
        (v % 13).cast("double").alias("awake_pct"),
        (4000 + v % 9000).cast("double").alias("kilojoule"),
        "n_events", "has_view", "has_purchase",
    )


def official_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official scores: only days with a view; recovery only with a purchase too."""
    d = daily_scores(spark, sf_dir).where("has_view = 1")
    shift = F.col("n_events") % 5 - 2
    return d.select(
        "user_id", "date",
        F.when(F.col("has_purchase") == 1, F.col("recovery") + shift * 4.0).alias("recovery"),
        (F.col("sleep") + shift * 3.0).alias("sleep"),
        (F.col("strain") + shift * 0.5).alias("strain"),
        "hrv", "rhr", "resp", "sleep_hours", "efficiency",
    )
