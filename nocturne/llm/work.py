"""Intermediate tables in the shared folder, and text columns as bytes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.session import work_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LAST_ID = 2**63 - 1


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that end inside the block leave no shuffle files behind.

    The session's own setting is put back afterwards.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back.

    Lost executors then redo a read, and the shuffles behind ``df`` are dropped. ``narrow`` says that rows are a few
    numbers each: an eighth of the shuffle partitions, but two a core at least, then make a file.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = work_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``table`` has written, once a later table holds all that is needed of it."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity(doc_id: str, text: str) -> list[Column]:
    """Columns ``doc`` and ``tie`` that name and order rows.

    Rows without an id come last; rows that share an id are ordered by the CRC-32 of
    their texts, then by 31 bits of another hash; rows equal in all three are the same document listed again. So two different
    texts are taken for one only if they share an id (or lack it) and 63 bits of hash.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"),
        (F.shiftleft(F.crc32(said.cast("binary")), 31) + F.xxhash64(said).bitwiseAND(F.lit((1 << 31) - 1))).alias("tie"),
    ]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 bounds of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def texts(column: pa.Array):
    """Yields the UTF-8 bytes of each row; null is empty."""
    data, bounds = utf8(column)
    whole = memoryview(data)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield bytes(whole[a:b])


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))
