"""Ranking metrics against direct formulas, and the experiment tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiments, metrics, topk


def fixture(n, seed, distinct):
    rng = random.Random(seed)
    return [(i, int(rng.random() < 0.4), rng.randint(0, distinct) / distinct) for i in range(n)]


def direct_auc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def direct_ap(rows):
    total, n_pos, seen, tp = 0.0, sum(y for _, y, _ in rows), 0, 0
    for score in sorted({s for _, _, s in rows}, reverse=True):
        at = [y for _, y, s in rows if s == score]
        seen, tp = seen + len(at), tp + sum(at)
        total += sum(at) / n_pos * tp / seen
    return total


@pytest.mark.parametrize("distinct, ranges", [(5, None), (400, None), (400, 9)])
def test_curves(spark, distinct, ranges):
    rows = fixture(300, distinct, distinct)
    df = spark.createDataFrame(rows, "id int, label int, prob double")
    got = metrics.curve_metrics(metrics.curve_points(df, ranges=ranges)).first()
    assert got["roc_auc"] == pytest.approx(direct_auc(rows))
    assert got["pr_auc"] == pytest.approx(direct_ap(rows))
    flipped = df.withColumn("prob", -F.col("prob"))
    assert metrics.roc_auc(flipped).first()["roc_auc"] == pytest.approx(1 - got["roc_auc"])


def test_grouped_equals_single(spark):
    rows = fixture(200, 9, 30)
    df = spark.createDataFrame(rows, "id int, label int, prob double").withColumn("prediction", (F.col("prob") > 0.5).cast("int"))
    both = df.withColumn("m", F.lit("a")).unionByName(df.filter("id < 80").withColumn("m", F.lit("b")))
    by = {r["m"]: r for r in metrics.evaluate(both, ["m"]).collect()}
    alone = metrics.evaluate(df).first()
    for name in ("roc_auc", "pr_auc", "f1"):
        assert by["a"][name] == pytest.approx(alone[name])
    assert by["b"]["roc_auc"] == pytest.approx(direct_auc(rows[:80]))


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0), (2, 0, 0.4, 0)], "id int, label int, prob double, prediction int")
    row = metrics.evaluate(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0 and row["f1"] == 0.0


def test_best_model_ties(spark):
    df = spark.createDataFrame([("rf", 0.7), ("lr", 0.7), ("xgb", 0.6)], "model string, roc_auc double")
    assert metrics.best_model(df).first()["model"] == "lr"


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("side", F.when(F.col("id") % 3 == 0, "positive").otherwise("rest"))
    assert topk.sample_rows(df, "id", 5).collect() == topk.sample_rows(df.repartition(7), "id", 5).collect()
    draws = topk.sample_balanced(df, "id", "side", 3).collect()
    assert len(draws) == 6 and all((r["id"] % 3 == 0) == (r["side"] == "positive") for r in draws)


def test_history_in_ranges_equals_whole(spark):
    """One run holds most rollouts; nine ranges give the same history as one range."""
    rng = random.Random(4)
    rows = [
        (run, i, i, f"0-{i}", "x" if rng.random() < 0.2 else None, rng.randint(0, 9) / 10, rng.random(), rng.random(), rng.random())
        for run, n in (("big", 400), ("small", 15)) for i in range(n)
    ]
    columns = "run_id string, seq int, rollout int, node_id string, error string, val_roc_auc double, test_roc_auc double, test_f1 double, test_pr_auc double"
    nodes = spark.createDataFrame(rows, columns)
    whole = sorted(experiments.leaderboard_history(nodes).collect())
    assert sorted(experiments.leaderboard_history(nodes, ranges=9).collect()) == whole
    last = next(r for r in whole if r["run_id"] == "big" and r["rollout"] == 399)
    best = sorted((r for r in rows if r[0] == "big" and r[4] is None), key=lambda r: (-r[5], r[1]))[:5]
    assert last["top5_ids"] == ",".join(r[3] for r in best)


def test_path_max_ties(spark):
    rows = [("r", "0", None, 0.5), ("r", "0-1", None, 0.7), ("r", "0-1-0", None, 0.7), ("r", "0-2", "bad", 0.9)]
    nodes = spark.createDataFrame(rows, "run_id string, node_id string, error string, val_roc_auc double")
    got = {r["leaf_id"]: (r["best_id"], r["max_reward"]) for r in experiments.path_max(nodes, max_depth=2).collect()}
    assert got == {"0-1-0": ("0-1-0", 0.7), "0-2": ("0", 0.5)}


def test_ranks_of_a_hot_key(spark):
    """One key holds nearly all rows and one score repeats; ranges give the ranks of a plain window."""
    from pyspark.sql import Window

    i = F.col("id")
    df = spark.range(3000).select(F.when(i % 50 == 0, i % 7).otherwise(-1).alias("k"), (i % 3 == 0).cast("int").alias("s"), i.alias("seq"))
    order = [F.desc("s"), F.asc("seq")]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    ranked = topk.rank_per_key(df, ["k"], order, ranges=7)
    assert sorted(ranked.collect()) == sorted(plain.collect())
    sizes = [r["count"] for r in topk.range_buckets(df, ["k"], order, 7).groupBy("bucket").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 3000 / 3
