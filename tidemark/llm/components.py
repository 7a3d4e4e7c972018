"""Distributed union-find over links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches
from tidemark.session import materialize

CHUNK_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends of the edges and the smallest end that each is connected with."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return ids, ids[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held):
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        ids, root = roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "root"])

    held, rows = [], 0
    for batch in in_batches(batches):
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK_EDGES:
            yield flush(held)
            held, rows = [], 0
    if held:
        yield flush(held)


def connected_components(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """(id, component) for every end of the links ``a``, ``b`` (longs): the smallest id that is reachable.

    Each task unites the links it holds and sends one (id, root) row per id, so an id has at most one row
    per task, however many links it has. Where roots of an id differ, the roots are linked to the least
    of them; these fewer links are united in the same way on the next level, until none is left. Levels
    are written to the shared folder. Rows with a null end are ignored. An empty table gives no rows.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    levels: list[DataFrame] = []
    for _ in range(max_levels):
        star = edges.mapInArrow(_forest, "id long, root long")
        by_id = Window.partitionBy("id")
        star = materialize(star.withColumn("low", F.min("root").over(by_id)), "components")
        levels.append(star.groupBy("id").agg(F.min("low").alias("root")))
        edges = materialize(
            star.where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct(), "links"
        )
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("the links were not united")
    labels = levels[-1].select("id", F.col("root").alias("component"))
    for level in reversed(levels[:-1]):
        above = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        labels = level.join(above, "root", "left").select("id", F.coalesce("above", "root").alias("component"))
    return labels if len(levels) == 1 else materialize(labels, "labels")
