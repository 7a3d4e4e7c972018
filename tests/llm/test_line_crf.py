"""Line field: marginals against enumeration, features by hand, held-out accuracy, odd rows."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import line_crf


def test_marginals_like_enumeration():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 1, 4, 9])
    unary, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs = line_crf.forward_backward(unary, bounds, moves)
    expected = np.zeros((2, 2))
    for a, b in itertools.pairwise(bounds):
        weights = {}
        for labels in itertools.product((0, 1), repeat=b - a):
            weights[labels] = math.exp(sum(u for u, x in zip(unary[a:b], labels, strict=True) if x)
                                       + sum(moves[x, y] for x, y in itertools.pairwise(labels)))
        total = sum(weights.values())
        for i in range(b - a):
            assert math.isclose(good[a + i], sum(w for x, w in weights.items() if x[i]) / total)
        for x, w in weights.items():
            for pair in itertools.pairwise(x):
                expected[pair] += w / total
    assert np.allclose(pairs, expected)


def test_features():
    lines, chars, bounds = line_crf.line_features(pa.array(["Ab CD!\n\nÉé é# 1|", None, "x x x"]))
    assert bounds.tolist() == [0, 3, 4, 5] and chars.tolist() == [6, 0, 8, 0, 5]
    at = {name: i for i, name in enumerate(line_crf.FEATURES)}
    assert math.isclose(lines[0, at["upper"]], 3 / 4) and lines[0, at["exclamation"]] == 1 / 6
    assert lines[2, at["symbols"]] == 2 / 8 and lines[2, at["pipes"]] == 1 / 3 and lines[2, at["digits"]] == 1 / 8
    assert lines[1, at["blank"]] == lines[3, at["blank"]] == 1
    assert math.isclose(lines[4, at["repeated_words"]], 2 / 3) and math.isclose(lines[4, at["same_as_previous"]], 2 / 3)


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    fold = line_crf.remainder("doc_id", 4)
    rows = line_crf.score(docs, line_crf.fit(docs, labels.where(fold != 2))).join(labels, "doc_id").where(fold == 2)
    rows = [(r.score >= 0.7, r.label) for r in rows.collect()]
    assert len(rows) > 50 and sum(a == bool(b) for a, b in rows) / len(rows) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (None, "a b", 3.0), (4, "x\n" * 3000, 3.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, label int")
    model = line_crf.fit(docs, labels)  # one kind of label only
    rows = line_crf.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(len(r.good_lines) for r in rows) == [1, 1, 1, 1, 3001]
    assert line_crf.score(docs.limit(0), model).count() == 0
    assert line_crf.score_rows(docs, model).columns == ["doc_id", "text", "score", "good_lines"]
