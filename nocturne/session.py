"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "nocturne", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}  # of applications without a shared folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and intermediate tables.

    On a cluster the folder lies below ``spark.checkpoint.dir``, which every
    executor can reach. A machine-local folder is used only in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        key = spark.sparkContext.applicationId
        root = _LOCAL[key] = _LOCAL.get(key) or tempfile.mkdtemp(prefix="nocturne-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` to the shared folder and read it back.

    Used where a plan is scanned more than once (training folds, sweeps), so
    lost executors only redo the read.
    """
    path = work_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
