"""Classifiers on the document features: quality bounds, not values."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.plans.feature_plan import SubFeature
from tidemark.session import scratch_path

PLAN = [SubFeature(0, "f", "x", "float", ()), SubFeature(0, "f", "kind", "categorical", ("a", "b"))]


@pytest.fixture(scope="module")
def wide(spark):
    i = F.col("id")
    return spark.range(400).select(
        i, ((i * 37 % 100) / 100).alias("f--x"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("f--kind"),
        ((i * 37 % 100) + F.when(i % 3 == 0, 15).otherwise(0) > 55).cast("int").alias("label"),
        F.when(i % 10 < 6, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"),
    )


@pytest.fixture(scope="module")
def run(wide):
    params = {"xgb": {"maxIter": 8}, "rf": {"numTrees": 20, "maxDepth": 5}}
    return models.run_experiment(wide, PLAN, params=params)


def test_all_kinds_learn(run):
    rows = run.metrics.collect()
    assert {(r["model"], r["split"]) for r in rows} == {(m, s) for m in ("xgb", "lr", "rf") for s in ("val", "test")}
    assert all(r["roc_auc"] > 0.9 for r in rows)
    assert run.best in run.models


def test_importances_match_inputs(spark, run):
    for fitted in run.models.values():
        rows = models.importances(spark, fitted).collect()
        assert [r["feature"] for r in rows] and len(rows) == len(fitted.names)
        values = [r["importance"] for r in rows]
        assert values == sorted(values, reverse=True)


def test_saved_model_predicts_the_same(spark, run, wide):
    best, path = run.models[run.best], scratch_path(spark, "model")
    models.save(best, path)
    loaded = models.load(best.kind, path, best.plan, best.names)
    ids = wide.filter("id < 10").select("id")
    assert sorted(models.predict(loaded, wide, ids).collect()) == sorted(models.predict(best, wide, ids).collect())
    assert models.predict(loaded, wide).count() == 400


def test_skip_list(wide):
    fitted = models.fit("lr", wide, PLAN + [SubFeature(1, "gone", "y", "float", ())], skip=["gone"])
    assert fitted.names == ["f--x", "f--kind=a", "f--kind=b"]
