"""Repeated strings against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm.suffix_dedup import _cut, difference_cover, remove_repeats

DOCS = "doc_id long, text string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def check(spark, texts, length, order, large=4096):
    rows = remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS), length, order, large).collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == brute(texts, length)


@pytest.mark.parametrize("order", [2, 3, 5, 7, 17])
def test_cover_has_every_difference(order):
    v, residues = difference_cover(order)
    assert len(residues) == order + 1
    assert {(a - b) % v for a in residues.tolist() for b in residues.tolist()} == set(range(v))


def texts_of(seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(5, 120))) for _ in range(12)]
    texts = [None, "", "short"]
    for _ in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 90)))
                 for _ in range(rng.randint(1, 8))]
        texts.append("".join(parts))
    return texts + [texts[5], "ab" * 200, "z" * 90]


@pytest.mark.parametrize("seed,length,order,large", [(1, 40, 5, 4096), (2, 40, 5, 3), (3, 60, 7, 10)])
def test_like_brute_force(spark, seed, length, order, large):
    check(spark, texts_of(seed), length, order, large)


def test_whole_table(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400, 17)


def test_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 500, 1), (1, "x" * 500, 2), (None, None, 3)], DOCS + ", text_key int")
    rows = remove_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 500), (1, 500)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_last_step_holds_few_texts_at_a_time():
    rows = [{"doc_id": i, "text": "x" * 300_000, "runs": [{"first": 0, "past": 1}], "whole": None} for i in range(20)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("whole", pa.bool_()),
                        ("runs", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))])
    out = list(_cut(400)(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    assert [r["n_removed"] for b in out for r in b.to_pylist()] == [400] * 20
    assert max(b.nbytes for b in out) < 2 << 20
