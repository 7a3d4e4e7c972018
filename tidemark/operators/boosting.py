"""Boosted trees with a learnt branch for gaps: histograms per task, summed by a shuffle, one small job per level.

A split sends values up to its edge to the left, and gaps to the side that lowers the loss more. Rows stay where they
are: a task bins its rows, works out their margins from the trees so far, and adds gradients per (node, feature, bin).
The driver holds edges, trees and the histograms of one level (2 ** depth nodes x features x bins), whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize

# Penalty on leaf values and least sum of second derivatives in a child.
PENALTY = 1.0
LEAST_CHILD = 1.0

BINS = 64
ACCURACY = 10_000


class Tree(NamedTuple):
    """Nodes by heap number (1 is the root): feature (-1 for a leaf), edge number, side of gaps, leaf value."""

    feature: np.ndarray
    edge: np.ndarray
    gap_left: np.ndarray
    value: np.ndarray

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after so many levels."""
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[node]
            own = bins[rows, np.maximum(feature, 0)]
            left = np.where(own < 0, self.gap_left[node], own <= self.edge[node])
            node = np.where(feature >= 0, 2 * node + ~left, node)
        return node


class Boosted(NamedTuple):
    names: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    gains: list[list[float]]
    depth: int


def find_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each feature, its greatest value among them; features of few values get them all."""
    shares = [i / bins for i in range(bins + 1)]
    found = rows.agg(*[
        F.percentile_approx(F.nanvl(F.col("features")[i], F.lit(None).cast("double")), shares, ACCURACY) for i in range(len(names))
    ]).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in found]


def _binned(column: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features): the number of edges below each value, -1 for a gap."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), len(edges))
    out = np.stack([np.searchsorted(e, flat[:, i]) for i, e in enumerate(edges)], axis=1)
    return np.where(np.isnan(flat), -1, out)


def _margins(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += tree.value[tree.walk(bins, depth)]
    return total


def _histograms(state):
    """(node, feature, bin, g, h) of a task's rows for the nodes of the level that is grown; the gap bin is -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, trees, tree, level, depth = state.value
        width, nodes = max(map(len, edges)) + 2, 2**level
        g_sum, h_sum = (np.zeros((nodes, len(edges), width)) for _ in range(2))
        seen = np.zeros((nodes, len(edges), width), bool)
        for batch in batches:
            bins = _binned(batch.column("features"), edges)
            p = 1 / (1 + np.exp(-_margins(trees, bins, depth)))
            node = tree.walk(bins, level) - nodes
            at = node >= 0  # rows whose leaf lies higher are done
            g, h = (p - batch.column("label").to_numpy())[at], (p * (1 - p))[at]
            for i in range(len(edges)):
                place = (node[at], i, bins[at, i] + 1)
                np.add.at(g_sum, place, g)
                np.add.at(h_sum, place, h)
                seen[place] = True
        node, feature, place = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (node, feature, place - 1, g_sum[seen], h_sum[seen])], ["node", "feature", "bin", "g", "h"])
    return run


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, bool]:
    """Gain, feature, edge and side of gaps of the best split of one node, from (features, 1 + bins) sums, gaps first.

    Ties go to the first feature, then the first edge, then gaps to the left. Without a split, the gain is 0.
    """
    def worth(a, b):
        return a**2 / (b + PENALTY)

    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gains = []
    for gap in (1, 0):
        left_g, left_h = (np.cumsum(x[:, 1:], axis=1) + gap * x[:, :1] for x in (g, h))
        gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
        gains.append(np.where((left_h >= LEAST_CHILD) & (all_h - left_h >= LEAST_CHILD), gain, 0.0))
    gain = np.round(np.stack(gains, axis=2), 9)
    feature, edge, side = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[feature, edge, side]), int(feature), int(edge), side == 0


def fit(rows: DataFrame, names: list[str], trees: int = 100, depth: int = 6, rate: float = 0.3, bins: int = BINS) -> Boosted:
    """Trees for rows of ``features`` (array of doubles, null or NaN for a gap) and a 0/1 ``label``.

    Rows without a label are left out; a feature without values is never split on; without rows, all trees are one leaf of 0.
    """
    rows = materialize(rows.filter("label is not null").select("features", F.col("label").cast("double").alias("label")), "boosting")
    edges = find_edges(rows, names, bins)
    model = Boosted(names, edges, [], [], depth)
    width = max(map(len, edges)) + 2
    for _ in range(trees):
        size = 2 ** (depth + 1)
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size))
        gains = [0.0] * size
        for level in range(depth + 1):
            state = rows.sparkSession.sparkContext.broadcast((edges, model.trees, tree, level, depth))
            sums = rows.mapInArrow(_histograms(state), "node long, feature long, bin long, g double, h double").groupBy(
                "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            g, h = (np.zeros((2**level, len(edges), width)) for _ in range(2))
            place = tuple(sums[c].to_numpy() for c in ("node", "feature"))
            g[(*place, sums["bin"].to_numpy() + 1)] = sums["g"].to_numpy()
            h[(*place, sums["bin"].to_numpy() + 1)] = sums["h"].to_numpy()
            split = False
            for n in np.unique(place[0]):
                own = 2**level + n
                tree.value[own] = -rate * g[n, 0].sum() / (h[n, 0].sum() + PENALTY)
                gain, feature, edge, left = best_split(g[n], h[n]) if level < depth else (0.0, 0, 0, False)
                if gain > 0:
                    tree.feature[own], tree.edge[own], tree.gap_left[own] = feature, edge, left
                    gains[own], split = gain, True
            if not split:
                break
        model.trees.append(tree)
        model.gains.append(gains)
    return model


def score(model: Boosted, rows: DataFrame, keep: list[str] = ("id",)) -> DataFrame:
    """``keep`` columns, class-1 probability ``prob`` and 0/1 ``prediction``. One pass, no shuffle."""
    state = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.select(*keep, "features")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep] + ["prob double", "prediction int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        for batch in batches:
            bins = _binned(batch.column("features"), model.edges)
            prob = 1 / (1 + np.exp(-_margins(model.trees, bins, model.depth)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(prob), pa.array((prob > 0.5).astype(np.int32))],
                [*keep, "prob", "prediction"])

    return kept.mapInArrow(run, schema)


def splits(spark, model: Boosted) -> DataFrame:
    """Every split: tree, node, feature name, edge value (left if not above it), side of gaps, gain."""
    found = [(t, int(n), model.names[f], float(model.edges[f][tree.edge[n]]), bool(tree.gap_left[n]), model.gains[t][n])
             for t, tree in enumerate(model.trees) for n, f in enumerate(tree.feature) if f >= 0]
    return spark.createDataFrame(found, "tree int, node int, feature string, edge double, gap_left boolean, gain double")
