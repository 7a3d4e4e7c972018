"""A keyed store: rows in buckets of their key, added batch by batch, compacted into generations.

An upsert reads only the buckets that incoming keys fall into, and of these, where the keys are few, only the row groups
whose bloom filter may have one. Batches write folders of their own name, so a replay leaves the same rows. The log
names the generation that counts; a compaction that is killed leaves the former one in place. One writer at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.blocks import only_among
from tidemark.operators.etl import distinct_rows, unseen
from tidemark.session import materialize

BUCKETS = 64


class KeyedStore(NamedTuple):
    path: str
    key: str
    buckets: int = BUCKETS


def generation(spark: SparkSession, store: KeyedStore) -> int:
    """Number of the generation that counts: that of the last finished compaction, 0 before the first."""
    try:
        return spark.read.schema("generation int").parquet(f"{store.path}/log").agg(F.max("generation")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def _folder(spark: SparkSession, store: KeyedStore) -> str:
    return f"{store.path}/rows/generation={generation(spark, store)}"


def _stored(spark: SparkSession, store: KeyedStore) -> DataFrame | None:
    """All rows, with the folders ``bucket`` and ``batch``; None while nothing is stored."""
    try:
        return spark.read.parquet(_folder(spark, store)).withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_keyed(spark: SparkSession, store: KeyedStore) -> DataFrame | None:
    rows = _stored(spark, store)
    return None if rows is None else rows.drop("bucket", "batch")


def stored_with_keys(store: KeyedStore, incoming: DataFrame, batch: str = "") -> DataFrame | None:
    """Stored rows that may have one of the incoming keys, but not those of ``batch`` itself."""
    rows = _stored(incoming.sparkSession, store)
    if rows is None:
        return None
    touched = [r[0] for r in incoming.select(_bucket(store).alias("bucket")).distinct().collect()]
    return only_among(rows.where(F.col("bucket").isin(touched) & (F.col("batch") != batch)), store.key, incoming)


def _bucket(store: KeyedStore):
    return F.pmod(F.xxhash64(store.key), F.lit(store.buckets)).cast("int")


def _write(rows: DataFrame, folder: str, store: KeyedStore, mode: str) -> None:
    # A rebalance cuts a hot bucket to several files and joins small ones; files are sorted by key.
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", store.key)
     .write.option(f"parquet.bloom.filter.enabled#{store.key}", "true").option("partitionOverwriteMode", mode)
     .mode("overwrite").partitionBy("bucket", "batch").parquet(folder))


def upsert_keyed(batch: DataFrame, store: KeyedStore, name: str) -> None:
    """Add the distinct rows of ``batch`` whose key is not stored yet; all rows of a new key are let in.

    Rows with a null key are never known, so they are added by every batch that has them.
    """
    spark = batch.sparkSession
    fresh = materialize(distinct_rows(batch), "incoming")
    known = stored_with_keys(store, fresh, name)
    if known is not None:
        fresh = unseen(fresh, known, [store.key])
    fresh = fresh.withColumns({"bucket": _bucket(store), "batch": F.lit(name)})
    _write(fresh, _folder(spark, store), store, "dynamic")


def compact(spark: SparkSession, store: KeyedStore) -> int:
    """Rewrite all batches as one, the next generation; returns its number."""
    rows, number = _stored(spark, store), generation(spark, store)
    if rows is None:
        return number
    _write(rows.withColumn("batch", F.lit("compacted")), f"{store.path}/rows/generation={number + 1}", store, "static")
    spark.createDataFrame([(number + 1,)], "generation int").coalesce(1).write.mode("append").parquet(f"{store.path}/log")
    return number + 1
