"""Exact ranking metrics by prefix sums over distinct scores, and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.topk import range_buckets, sample_rows

def curve_points(
    df: DataFrame, label: str = "label", score: str = "prob", by: list[str] = (), ranges: int | None = None
) -> DataFrame:
    """Per distinct score, falling: ``pos, neg`` at it, running ``tp, fp`` down to it, totals.

    Rows are counted per score first. Distinct scores are cut to ranges, each summed on its own, and
    range totals (few) carry over, so no task ever sees all scores.
    """
    by = list(by)
    positive = F.sum((F.col(label) == 1).cast("long"))
    counted = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(positive.alias("pos"), F.count(F.lit(1)).alias("rows"))
        .select(*by, "score", "pos", (F.col("rows") - F.col("pos")).alias("neg"))
    )
    per_score = range_buckets(counted, by, [F.desc("score")], ranges)

    totals = per_score.groupBy(*by, "bucket").agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    above = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "bucket",
        F.coalesce(F.sum("b_pos").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("b_neg").over(above), F.lit(0)).alias("fp_above"),
        F.sum("b_pos").over(group).alias("n_pos"),
        F.sum("b_neg").over(group).alias("n_neg"),
    )
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    running = per_score.select(
        *by, "bucket", "score", "pos", "neg",
        F.sum("pos").over(within).alias("tp_in"), F.sum("neg").over(within).alias("fp_in"),
    )
    return running.join(offsets, [*by, "bucket"]).select(
        *by, "score", "pos", "neg",
        (F.col("tp_above") + F.col("tp_in")).alias("tp"), (F.col("fp_above") + F.col("fp_in")).alias("fp"),
        "n_pos", "n_neg",
    )


def _auc() -> Column:
    """Pairs ranked right, ties half, over all pairs; null unless both classes are there."""
    right = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.first("n_pos").cast("double") * F.first("n_neg")
    return F.when(pairs > 0, right / pairs)


def _average_precision() -> Column:
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    n_pos = F.first("n_pos")
    return F.when(n_pos > 0, F.sum(F.col("pos") * precision) / n_pos).otherwise(0.0)


def curve_metrics(points: DataFrame, by: list[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("pr_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob", by: list[str] = ()) -> DataFrame:
    return curve_metrics(curve_points(df, label, score, by), by).select(*by, "roc_auc")


def average_precision(df: DataFrame, label: str = "label", score: str = "prob", by: list[str] = ()) -> DataFrame:
    return curve_metrics(curve_points(df, label, score, by), by).select(*by, "pr_auc")


def f1(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """F1 of class 1, 0 where it is undefined."""
    hit = F.sum(((F.col(label) == 1) & (F.col(prediction) == 1)).cast("long"))
    said = F.sum((F.col(prediction) == 1).cast("long"))
    true = F.sum((F.col(label) == 1).cast("long"))
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(2.0 * hit, said + true), F.lit(0.0)).alias("f1"))


def evaluate(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """roc_auc, f1 and pr_auc per group of a prediction table (label, prob, prediction)."""
    by = list(by)
    ranked = curve_metrics(curve_points(pred, by=by), by)
    if not by:
        return ranked.withColumn("f1", f1(pred).scalar())
    return ranked.join(f1(pred, by=by), by)


def best_model(metrics: DataFrame, by: list[str] = (), order: tuple[str, ...] = ("xgb", "lr", "rf")) -> DataFrame:
    """The model with the best validation AUC; ties go to the first in ``order``."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = F.max_by(F.struct(*[c for c in metrics.columns if c not in by]), F.struct("roc_auc", -place))
    return metrics.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def wrong_predictions(pred: DataFrame, truth: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows whose prediction is not the label, matched by key when the truth is a table of its own."""
    both = pred if truth is None else pred.join(truth, key)
    return both.filter(F.col("prediction") != F.col("label"))


def error_report(wrong: DataFrame, records: DataFrame, reasons: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """A sample of wrong rows with record detail and the reasons of their missing values."""
    picked = sample_rows(wrong, "id", n, seed).withColumn("should_be", F.when(F.col("prediction") == 0, 1).otherwise(0))
    return picked.join(records, "id", "left").join(reasons, "id", "left")
