"""Boosted trees against a plain split search over all rows, with gaps."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boosting, metrics

SCHEMA = "id long, features array<double>, label int"


def sample(n=600):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.2] = np.nan
    signal = np.where(np.isnan(x[:, 0]), 9, x[:, 0]) + np.where(np.isnan(x[:, 1]), 0, x[:, 1])
    return x, (signal + rng.normal(0, 2, n) > 11).astype(int)


def table(spark, x, y):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(x, g, h):
    """Greatest gain over every feature, value and side of gaps."""
    best = 0.0
    for f in range(x.shape[1]):
        for edge in np.unique(x[~np.isnan(x[:, f]), f]):
            for gaps in (True, False):
                left = np.where(np.isnan(x[:, f]), gaps, x[:, f] <= edge)
                if min(h[left].sum(), h[~left].sum()) >= 1:
                    worth = [g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left, np.full(len(x), True))]
                    best = max(best, worth[0] + worth[1] - worth[2])
    return best


def test_equal_to_a_plain_search(spark):
    x, y = sample()
    model = boosting.fit(table(spark, x, y), ["a", "b", "c"], trees=2, depth=2)
    margin = np.zeros(len(x))
    bins = np.where(np.isnan(x), -1, np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(model.edges)], axis=1))
    for tree, gains in zip(model.trees, model.gains):
        p = 1 / (1 + np.exp(-margin))
        for level in (0, 1):
            node = tree.walk(bins, level)
            for n in np.unique(node):
                at = node == n
                assert abs(brute(x[at], (p - y)[at], (p * (1 - p))[at]) - gains[n]) < 1e-6
        leaf = tree.walk(bins, 2)
        for n in np.unique(leaf):
            at = leaf == n
            value = -0.3 * (p - y)[at].sum() / ((p * (1 - p))[at].sum() + 1)
            assert abs(tree.value[n] - value) < 1e-9
        margin += tree.value[leaf]
    scored = {r["id"]: r["prob"] for r in boosting.score(model, table(spark, x, y)).collect()}
    assert np.allclose([scored[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)))
    root = boosting.splits(spark, model).filter("tree = 0 and node = 1").first()
    assert root["feature"] in ("a", "b") and root["gap_left"] == (root["feature"] == "b")


def test_odd_rows(spark):
    none = spark.createDataFrame([(1, [None, None, 2.0], None)], SCHEMA)
    empty = boosting.fit(none, ["a", "b", "c"], trees=1, depth=2)
    assert [r["prob"] for r in boosting.score(empty, none).collect()] == [0.5]
    x, y = sample(60)
    x[:, 2] = np.nan
    rows = table(spark, x, y).withColumn("other", F.lit("kept"))
    model = boosting.fit(rows.withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(float("nan"))))),
                         ["a", "b", "c"], trees=3, depth=2)
    assert boosting.splits(spark, model).filter("feature = 'c'").count() == 0
    scored = boosting.score(model, rows, ["id", "label", "other"])
    assert metrics.roc_auc(scored).first()[0] > 0.75 and scored.columns == ["id", "label", "other", "prob", "prediction"]
