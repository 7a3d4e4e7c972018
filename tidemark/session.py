"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join splitting on.

    ``conf`` keys use ``__`` for dots, so ``spark__driver__memory="8g"`` works.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder named in ``spark.checkpoint.dir``, which must be set: a
    folder of one machine would be out of the other executors' reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{base.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted.

    Spark deletes them once its driver finds that nothing refers to them, which only a garbage collection tells; a driver
    with little to do may run none for long, and all shuffles of a query would stay on the executors' disks.
    """
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared Parquet and read it back.

    Cuts lineage so that a lost executor replays a file read, and lets several consumers share one
    computation while keeping column pruning and filter pushdown. What was shuffled for it is deleted.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
