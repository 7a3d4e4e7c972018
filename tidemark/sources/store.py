"""Compute-if-absent store: only keys that are not stored yet are computed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import materialize


class StoreResult(NamedTuple):
    rows: DataFrame
    computed: DataFrame


def read_store(spark: SparkSession, store: str, plan_hash: str) -> DataFrame | None:
    """Stored rows of one plan, or None while nothing is stored."""
    try:
        return spark.read.option("basePath", store).parquet(f"{store}/plan_hash={plan_hash}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def materialize_missing(
    keys: DataFrame,
    store: str,
    plan_hash: str,
    compute: Callable[[DataFrame], DataFrame],
    on: list[str],
    batch: str | None = None,
) -> StoreResult:
    """Answer ``keys`` from the store, computing and appending what is absent.

    ``compute`` takes the absent key rows and returns rows with the key columns and a boolean ``ok``.
    Rows that are not ok come back to the caller but are not stored, so the next call tries again.
    A replay with the same ``batch`` overwrites its own output instead of adding to it.
    """
    spark = keys.sparkSession
    batch = batch or uuid.uuid4().hex
    stored = read_store(spark, store, plan_hash)
    if stored is not None:
        stored = stored.filter(F.col("batch") != batch).drop("plan_hash", "batch")
    todo = keys.distinct()
    if stored is not None:
        # Cut the store to the keys at hand first: a small request scans it and does not shuffle it.
        stored = stored.join(keys.select(*on).distinct(), on, "left_semi")
        todo = todo.join(stored.select(*on), on, "left_anti")
    fresh = materialize(compute(todo), "computed")
    fresh.filter("ok").drop("ok").write.mode("overwrite").parquet(
        f"{store}/plan_hash={plan_hash}/batch={batch}"
    )
    answer = fresh.drop("ok")
    if stored is not None:
        answer = answer.unionByName(stored)
    return StoreResult(answer, fresh)
