"""Scans: Parquet, JSON arrays, NDJSON, response files, packed tables and task splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.lists import json_from_literal

# The prediction tasks and the splits each one has.
TASKS = [
    "trial_approval", "trial_approval_phase1", "trial_approval_phase2", "trial_approval_phase3",
    "trial_approval_phase4", "adverse_event_phase1", "patient_dropout_phase1", "mortality_phase1",
]
SPLITS = ["train", "val", "test"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row work on a scan of few files; a scan with enough partitions is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_ndjson(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object per line. Without a schema every row is read once more to infer it."""
    reader = spark.read.option("samplingRatio", 1.0)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Files that each hold one JSON array. One task reads one file, so write Parquet right after."""
    reader = spark.read.option("multiLine", True).option("samplingRatio", 1.0)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batch_rows: int = 10_000,
) -> DataFrame:
    """Apply ``fn`` to batches of ``batch_rows`` rows (the last of a partition may be shorter), however many
    rows Spark hands over at a time. A task holds one batch, never a whole partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            start = 0
            while start < len(pdf):
                part = pdf.iloc[start:start + batch_rows - rows]
                held.append(part)
                start, rows = start + len(part), rows + len(part)
                if rows == batch_rows:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, rows = [], 0
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


def explode_responses(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per element of any of the given array columns, missing fields filled with null.

    The arrays are brought to one struct type and joined in the row, so the files are read once.
    """
    kinds: dict[str, str] = {}
    for c in columns:
        for field in df.schema[c].dataType.elementType.fields:
            kinds.setdefault(field.name, field.dataType.simpleString())

    def common(c: str) -> Column:
        own = set(df.schema[c].dataType.elementType.names)
        return F.transform(F.coalesce(F.col(c), F.array()), lambda r: F.struct(*[
            (r[name] if name in own else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]))

    return df.select(F.explode(F.concat(*map(common, columns))).alias("r")).select("r.*")


def unpack_tables(df: DataFrame, columns: list[str], payload: str = "data") -> DataFrame:
    """Packed rows (task, phase, type, table literal) to ``table_name, row_index, <columns>``.

    The literal is column -> index -> value. It is parsed as JSON with single quotes, never evaluated.
    """
    parsed = df.select(
        F.concat_ws("_", "task", "phase", "type").alias("table_name"),
        json_from_literal(F.col(payload), "map<string,map<string,string>>").alias("cols"),
    )
    cells = parsed.select("table_name", F.explode("cols").alias("column_name", "cells")).select(
        "table_name", "column_name", F.explode("cells").alias("row_index", "value")
    )
    picks = [F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in columns]
    return cells.groupBy("table_name", "row_index").agg(*picks)


def load_split(df: DataFrame, task: str, split: str | None = None, known_tasks: list[str] = TASKS) -> DataFrame:
    """Rows of one task (and one split); unknown names are errors. Prunes if partitioned by both."""
    if task not in known_tasks:
        raise ValueError(f"unknown task {task!r}, expected one of {known_tasks}")
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    out = df.filter(F.col("task") == task)
    return out if split is None else out.filter(F.col("split") == split)
