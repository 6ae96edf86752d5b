"""Sinks of the live operators: inserts that count what is new, and tables whose rows are replaced.

Both run in ``foreachBatch``. A batch that runs again after a failure writes the same result once more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


def _files(spark: SparkSession, path: str):
    """Hadoop path and file system of ``path``, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` below ``path`` that were written to their end."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, path: str) -> None:
    at, fs = _files(spark, path)
    fs.delete(at, True)


def _drain(stream: DataFrame, folder: str, mode: str, write) -> None:
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


# ------------------------------------------------------------------ inserts with a ledger


def insert_new(stream: DataFrame, folder: str, keys: list[str], order: list[str], day: str = "timestamp") -> str:
    """Inserts each key once, the first row of a batch by ``order``; returns the folder with ``table`` and ``ledger``.

    The table is split by day (of ``day``, in seconds), and a batch is compared with the rows of its own days only. The ledger
    has for each batch how many rows were offered, inserted and ignored. Null keys are keys like others.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("_n")).select(*keys, "_r.*", "_n")
        one = one.withColumn("day", F.coalesce(F.floor(F.col(day) / 86400), F.lit(-1)))
        seen = [v for v in versions(spark, f"{folder}/table", "batch") if v < number]
        if seen:
            old = spark.read.schema(schema).parquet(f"{folder}/table").where(F.col("batch").isin(seen))
            days = one.select(F.col("day").alias("_day")).distinct()
            old = old.join(days, F.col("day") == F.col("_day"), "left_semi").select(*keys, F.lit(True).alias("_old"))
            one = one.join(old, _same(one, old, keys), "left").select(*[one[c] for c in one.columns], "_old")
        else:
            one = one.withColumn("_old", F.lit(None).cast("boolean"))
        # written once, then counted and split: the comparison is not made twice
        one.write.mode("overwrite").parquet(f"{folder}/compared")
        compared = spark.read.schema(one.schema).parquet(f"{folder}/compared")
        compared.where("_old IS NULL").drop("_old", "_n").select(*batch.columns, "day").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/table/batch={number}")
        counts = compared.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("offered"), F.count(F.when(F.col("_old").isNull(), 1)).alias("inserted"))
        counts.withColumn("ignored", F.col("offered") - F.col("inserted")).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    _drain(stream, folder, "append", write)
    return folder


def inserted(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.LongType())])
    return spark.read.schema(full).parquet(f"{folder}/table")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, offered, inserted, ignored)``."""
    return spark.read.schema("offered long, inserted long, ignored long, batch long").parquet(f"{folder}/ledger")


# ------------------------------------------------------------------ tables whose rows are replaced


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int | None, dict[int, int]]:
    """The newest manifest (older than ``before``) and its map from bucket to version, a row for each bucket."""
    found = [v for v in versions(spark, f"{folder}/manifest", "version") if before is None or v < before]
    if not found:
        return None, {}
    rows = spark.read.schema("bucket int, at long").parquet(f"{folder}/manifest/version={found[-1]}").collect()
    return found[-1], {r["bucket"]: r["at"] for r in rows}


def _read(spark: SparkSession, folder: str, schema: T.StructType, at: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/data/version={v}/_bucket={b}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(stream: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS) -> str:
    """Keeps one row per key of a stream in update mode, the newest.

    Rows lie in ``buckets`` by a hash of the key. A batch rewrites the buckets it touches under its own version, then
    writes a manifest that names the version of every bucket; readers follow the newest manifest. Versions that neither this
    nor the manifest before names are dropped, so reading costs the same after any number of batches.
    A batch that runs again starts from the manifest before it.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, at = _current(spark, folder, number)
        target = f"{folder}/data/version={number}"
        # the batch is stateful and is used twice, so it is written first
        batch.write.mode("overwrite").parquet(f"{folder}/update")
        new = spark.read.schema(schema).parquet(f"{folder}/update")
        touched = sorted(r[0] for r in new.select(_bucket(keys, buckets)).distinct().collect())  # at most ``buckets``
        if not touched and before is not None:
            return
        old = _read(spark, folder, schema, {b: v for b, v in at.items() if b in touched})
        kept = old.join(new, _same(old, new, keys), "left_anti")
        kept.unionByName(new).withColumn("_bucket", _bucket(keys, buckets)).repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
        now = at | {b: number for b in touched}
        spark.createDataFrame(list(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")
        wanted = set(now.values()) | set(at.values())
        for v in versions(spark, f"{folder}/data", "version"):
            if v not in wanted:
                _drop(spark, f"{folder}/data/version={v}")
        for v in versions(spark, f"{folder}/manifest", "version"):
            if v not in (number, before):
                _drop(spark, f"{folder}/manifest/version={v}")

    _drain(stream, folder, "update", write)
    return folder


def latest(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest manifest."""
    return _read(spark, folder, schema, _current(spark, folder)[1])
