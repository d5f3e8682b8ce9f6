"""Session helpers for tests, the bench and local runs.

Library functions never create a session; they take and return DataFrames.
``build_session`` exists for the callers that do own the process (tests,
``bench.py``, command-line jobs).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "versio", extra: dict | None = None, shared: str | None = None) -> SparkSession:
    """``shared``: the folder for stored intermediates, seen by the driver and all executors."""
    master = master or "local[%s]" % os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Where intermediates are stored: the folder the cluster names in ``spark.checkpoint.dir``; where a
    session names none, a folder of the warehouse, which Spark shares by definition."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/versio-shared"


#: Paths that this process has stored under a shared folder, for ``discard``.
_STORED: list[str] = []


def stored_path(spark: SparkSession, what: str = "stored") -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/versio-{what}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Store a DataFrame whose values must not be computed twice, and read it back.

    A parquet table in the shared folder: a later reader takes the columns it
    needs, and a lost executor does not run the stage (or the model) again.
    """
    path = stored_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what this process has stored in the shared folder; how many tables went. To be called when no
    DataFrame over them is used any more (at a job's end)."""
    gone = 0
    while _STORED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone += bool(fs.exists(path) and fs.delete(path, True))
    return gone
