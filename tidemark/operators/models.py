"""Spark ML classifiers over design matrices, scoring, experiments and prediction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.features import MODEL_KINDS, design_matrix
from tidemark.operators.metrics import best_model, evaluate
from tidemark.operators.topk import rank_importance
from tidemark.plans.feature_plan import SubFeature
from tidemark.session import materialize

# Fixed value: the forest seed.
SEED = 42

# Spark's own limit; override with ``maxDepth``.
FOREST_DEPTH = 30


class Fitted(NamedTuple):
    kind: str
    plan: list[SubFeature]
    names: list[str]
    model: object


class Experiment(NamedTuple):
    """``metrics``: model, split, roc_auc, f1, pr_auc. ``best``: the kind best on validation."""

    models: dict[str, Fitted]
    predictions: DataFrame
    metrics: DataFrame
    best: str


def _classifier(kind: str, n: int):
    if kind == "lr":
        # 1/n is the penalty that corresponds to an inverse strength of 1 over summed losses.
        return LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100)
    if kind == "rf":
        return RandomForestClassifier(numTrees=100, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=SEED)
    if kind == "xgb":
        return GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.3, seed=SEED)
    raise ValueError(f"unknown model kind {kind!r}, expected one of {MODEL_KINDS}")


def fit(kind: str, train: DataFrame, plan: list[SubFeature], skip: list[str] = (), label: str = "label", **params) -> Fitted:
    """Train one kind on a wide feature table. ``params`` override the classifier's settings."""
    matrix, names = design_matrix(train, plan, kind, skip, keep=["id", label])
    rows = materialize(
        matrix.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), f"train-{kind}"
    )
    classifier = _classifier(kind, rows.count()).setLabelCol(label).setParams(**params)
    used = [s for s in plan if s.feature not in skip]
    return Fitted(kind, used, names, classifier.fit(rows))


def score(fitted: Fitted, wide: DataFrame, keep: list[str] = ("id",)) -> DataFrame:
    """``keep`` columns, class-1 probability ``prob`` and 0/1 ``prediction``."""
    matrix, _ = design_matrix(wide, fitted.plan, fitted.kind, keep=list(keep))
    scored = fitted.model.transform(matrix)
    return scored.select(
        *keep, vector_to_array("probability")[1].alias("prob"), F.col("prediction").cast("int").alias("prediction")
    )


def importances(spark, fitted: Fitted) -> DataFrame:
    """Signed coefficients or tree importances, largest first. One row per model input."""
    vector = fitted.model.coefficients if fitted.kind == "lr" else fitted.model.featureImportances
    values = [float(x) for x in vector.toArray()]
    if len(values) != len(fitted.names):
        raise ValueError("importances and feature names differ in number")
    return rank_importance(spark.createDataFrame(list(zip(fitted.names, values)), "feature string, importance double"))


def run_experiment(
    wide: DataFrame, plan: list[SubFeature], kinds: list[str] = MODEL_KINDS, params: dict[str, dict] | None = None
) -> Experiment:
    """Train every kind on the train split, score val and test, keep the best by validation AUC.

    ``wide`` has id, label, split and the planned columns; it is computed once and stored. All scores go to
    one table, and all metrics come from one pass over it.
    """
    wide = materialize(wide, "wide")
    train = wide.filter("split = 'train'")
    held_out = wide.filter("split in ('val', 'test') and label is not null")
    models = {kind: fit(kind, train, plan, **(params or {}).get(kind, {})) for kind in kinds}
    parts = [
        score(m, held_out, ["id", "label", "split"]).withColumn("model", F.lit(kind)) for kind, m in models.items()
    ]
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    predictions = materialize(predictions, "predictions")
    metrics = materialize(evaluate(predictions, ["model", "split"]), "metrics")
    best = best_model(metrics.filter("split = 'val'")).first()["model"]
    return Experiment(models, predictions, metrics, best)


def save(fitted: Fitted, path: str) -> None:
    fitted.model.write().overwrite().save(path)


def load(kind: str, path: str, plan: list[SubFeature], names: list[str]) -> Fitted:
    from pyspark.ml.classification import (
        GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
    )

    loader = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel, "xgb": GBTClassificationModel}[kind]
    return Fitted(kind, plan, names, loader.load(path))


def predict(fitted: Fitted, wide: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Scores of the given records, or of all of them, with a stored model."""
    return score(fitted, wide if ids is None else wide.join(ids.select("id").distinct(), "id", "left_semi"))
