"""Language-model scores: base counts by brute force, probabilities that add up to 1, gain on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import log_bilinear
from tidemark.llm.line_crf import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def learn(i):
    return zlib.crc32(str(i).encode()) % 10 != 0


def check_base(docs, rows):
    words = [(i, WORD.findall((t or "").translate(LOWER)) + ["\n"]) for i, t in docs]
    counts = Counter(w for i, ws in words if i is not None and learn(i) for w in ws)
    total, types = sum(counts.values()), len(counts)
    want = sorted((
        -1 if i is None else i, len(ws), sum(counts[w] > 0 for w in ws), total,
        round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in ws), 6)) for i, ws in words)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens,
                  round(r.base_score, 6)) for r in rows)
    assert got == want


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = log_bilinear.score(docs, remainder("doc_id", 10) != 0).collect()
    check_base([tuple(r) for r in docs.collect()], rows)
    assert all(r.learn == learn(r.doc_id) for r in rows)


def test_odd_rows_and_few_frequent_words(spark):
    docs = [(1, "a B a c"), (1, "a B a c"), (2, None), (3, ""), (None, "a zz"), (11, "a b \x85 d"), (13, "q " * 5000),
            (14, "b c d e f g h"), (40, "a unseen")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row_key int")
    for frequent in (1, 3, 100):
        check_base(docs, log_bilinear.score(table, remainder("doc_id", 10) != 0, classes=4, frequent=frequent).collect())
    assert log_bilinear.score(table.limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in log_bilinear.score(table, F.lit(False)).collect())


def test_normalisers_and_shares_of_the_other_class(spark):
    model = log_bilinear.Model.start(np.arange(1, 7) / 21)
    near, far, norm = model.tables()
    assert np.allclose(np.exp(near[:, None, :] + far[None, :, :] - norm[:, :, None]).sum(axis=2), 1)
    train = [(i, t) for i, t in enumerate(["a a b a c", "b a a d", "c c a b e f", "a b"] * 8)]
    counts = Counter(w for _, t in train for w in t.split())
    probes = {1000: "d", 1001: "e", 1002: "unseen", 1003: "f"}
    table = spark.createDataFrame(train + list(probes.items()), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in log_bilinear.score(
        table, F.col("doc_id") < 1000, classes=5, frequent=4).collect()}
    for i, w in probes.items():  # all in the class of other words, so only their counts differ
        assert math.isclose(scores[i] - scores[1000], math.log10((counts[w] + 0.1) / (counts["d"] + 0.1)), abs_tol=1e-9)


def test_training_beats_unigrams(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(300):
        words = [["ab", "cd", "ef", "gh"], ["st", "uv", "wx", "yz"]][i % 2]
        texts.append((i, " ".join(words[j] for j in rng.integers(0, 4, 60))))
    rows = log_bilinear.score(spark.createDataFrame(texts, "doc_id long, text string"),
                              F.col("doc_id") < 250, classes=16).collect()
    held = [r for r in rows if not r.learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 10


def test_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learnt = remainder("doc_id", 10) != 0
    scores = [{r.doc_id: r.score for r in log_bilinear.score(docs.repartition(n), learnt, classes=64).collect()}
              for n in (1, 50)]
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-6) for i in scores[0])


def test_words_found_twice_are_modelled(spark):
    """Only words that training has once, or not at all, are others."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(j)}" for j in rng.zipf(1.5, 40) if j < 90)) for i in range(200)]
    texts += [(500, "once"), (501, "twice twice")]
    counts = Counter(w for _, t in texts for w in t.split())
    words = [*sorted(counts), "unseen"]
    probes = [(1000 + i, w) for i, w in enumerate(words)]
    table = spark.createDataFrame(texts + probes, "doc_id long, text string")
    learnt = F.col("doc_id") < 1000
    rows = {r.doc_id: r for r in log_bilinear.score(table, learnt, classes=8, frequent=1000).collect()}
    assert {w for (i, w) in probes if rows[i].n_other == 1} == {w for w in counts if counts[w] == 1} | {"unseen"}
    hashes, times, least = log_bilinear._most_frequent(
        table.where(learnt).select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy(
            F.xxhash64("w").alias("word")).agg(F.count("*").alias("times")), 1000)
    assert least == 2 and len(hashes) == sum(n > 1 for n in counts.values()) and times.sum() == sum(
        n for n in counts.values() if n > 1)


def test_factors_of_words_add_up_to_1_in_every_class_and_context():
    ids = np.array([((3 * 50 + at) * 9 + near) for at in (4, 7, 30) for near in (0, 2, 7)])
    fitted = log_bilinear._fit_class(3, ids, np.arange(1, 10), 50, 9)
    assert list(fitted["at"][0]) == [4, 7, 30]
    contexts, own = fitted["contexts"][0].reshape(9, -1), fitted["own"][0].reshape(3, -1)
    inner = log_bilinear.Words(contexts[None], own, fitted["bias"][0], fitted["norm"][0][None])
    for near in range(9):
        logs = inner.logs(np.zeros(3, np.int64), np.full(3, near), np.arange(3))
        assert math.isclose(np.exp(logs).sum(), 1, abs_tol=1e-5)


def test_words_of_equal_counts_are_modelled_all_or_none(spark):
    counts = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, 1)], "word long, times long")
    assert list(log_bilinear._most_frequent(counts, 2)[0]) == [1]
    assert list(log_bilinear._most_frequent(counts, 3)[0]) == [1, 2, 3]
    assert len(log_bilinear._most_frequent(counts, 0)[0]) == 0
