"""Chunking and search against brute force on small fixtures."""

import collections
import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, dense, hybrid, keyword
from tidemark.operators.chunking import chunk
from tidemark.session import scratch_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def random_texts(n, seed):
    rng = random.Random(seed)
    separators = [" ", " ", " ", ". ", "! ", "\n", "\n\n", "  ", ""]
    return [
        "".join(rng.choice(WORDS) * rng.randint(1, 3) + rng.choice(separators) for _ in range(rng.randint(0, 60)))
        for _ in range(n)
    ] + ["", "x" * 95, "\n\n\n", "äöü " * 30, ". . . " * 20]


def test_chunks_join_back(spark):
    texts = random_texts(150, 1)
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "id bigint, text string")
    for size in (7, 40, 2048):
        joined: dict[int, list] = {}
        for row in chunk(df, "text", size).orderBy("id", "chunk_no").collect():
            assert 0 < len(row["chunk"]) <= size
            joined.setdefault(row["id"], []).append(row["chunk"])
        assert {i: "".join(c) for i, c in joined.items()} == {i: t for i, t in enumerate(texts) if t}


def test_neighbours_are_joined_greedily(spark):
    df = spark.createDataFrame([(1, "aaaa\nbb\ncccccc\nd\n")], "id bigint, text string")
    assert [r["chunk"] for r in chunk(df, "text", 8).orderBy("chunk_no").collect()] == ["aaaa\nbb\n", "cccccc\n", "d\n"]
    assert [r["chunk"] for r in chunk(df, "text", 9).orderBy("chunk_no").collect()] == ["aaaa\nbb\n", "cccccc\nd\n"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of which a third are copies, so that scores tie in bulk."""
    texts = random_texts(200, 2)
    texts += [texts[3] or "alpha beta"] * 100
    rows = [(i, dt.date(2000, 1, 1) + dt.timedelta(days=i * 7 % 300) if i % 11 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id bigint, doc_date date, text string"), rows


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(3)
    rows = [
        (q, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 320)) if q % 5 else None, " ".join(rng.sample(WORDS, 4)))
        for q in range(30)
    ]
    return spark.createDataFrame(rows, "query_id bigint, as_of date, text string"), rows


def brute_bm25(corpus_rows, query_rows, k):
    tokens = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, _, t in corpus_rows if t}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    dates = {i: d for i, d, _ in corpus_rows}
    df: dict[str, int] = {}
    for toks in tokens.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, bound, text in query_rows:
        hits = []
        for i, toks in tokens.items():
            if bound is not None and (dates[i] is None or dates[i] >= bound):
                continue
            score = 0.0
            for t in set(text.split()):
                tf = toks.count(t)
                if tf:
                    score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))
            if score > 0:
                hits.append((-round(score, 6), i))
        out[q] = [i for _, i in sorted(hits)[:k]]
    return out


def ids_by_query(hits):
    out: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("block_terms, cells", [(1_000_000, 4_000_000), (25, 100)])
def test_keyword_search(spark, corpus, queries, monkeypatch, block_terms, cells):
    """Also with query blocks and row steps forced small."""
    monkeypatch.setattr(keyword, "MAX_BLOCK_TERMS", block_terms)
    monkeypatch.setattr(blocks, "SCORE_CELLS", cells)
    expected = {q: ids for q, ids in brute_bm25(corpus[1], queries[1], 5).items() if ids}
    tokens = keyword.token_table(chunk(corpus[0], "text", 100_000)).cache()
    assert ids_by_query(keyword.search_keyword(queries[0], tokens, 5)) == expected
    index = keyword.KeywordIndex(tokens, keyword.build_postings(tokens))
    assert ids_by_query(keyword.search_postings(queries[0], index, 5)) == expected


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8))
    base[100:200] = base[7]
    base[0] = 0
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 100, 300)]
    rows = [(i, 0, days[i], base[i].tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, chunk_no int, doc_date date, vec array<double>"), base, days


def brute_cosine(base, days, query_rows, k):
    unit = np.divide(base, np.linalg.norm(base, axis=1, keepdims=True), out=np.zeros_like(base), where=np.linalg.norm(base, axis=1, keepdims=True) > 0)
    out = {}
    for q, bound, vec in query_rows:
        scores = np.round(unit @ (np.array(vec) / np.linalg.norm(vec)), 6)
        hits = sorted((-s, i) for i, s in enumerate(scores) if bound is None or days[i] < bound)
        out[q] = [i for _, i in hits[:k]]
    return out


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_dense_search(spark, vectors, monkeypatch, block_rows):
    monkeypatch.setattr(dense, "QUERY_BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(6)
    rows = [(q, None if q % 4 == 0 else dt.date(2000, 2, q + 1), rng.normal(size=8).tolist()) for q in range(12)]
    queries = spark.createDataFrame(rows, "query_id int, as_of date, qvec array<double>")
    expected = brute_cosine(vectors[1], vectors[2], rows, 10)
    assert ids_by_query(dense.search_dense(queries, vectors[0], 10)) == expected
    index = dense.build_cells(vectors[0], cells=5)
    assert ids_by_query(dense.search_ann(queries, index, 10, nprobe=5).drop("compared")) == expected
    few = ids_by_query(dense.search_ann(queries, index, 10, nprobe=2))
    recall = [len(set(few[q]) & set(expected[q])) / len(expected[q]) for q in expected]
    assert sum(recall) / len(recall) > 0.3


def test_as_of_holds_and_repeats_agree(spark, corpus, queries):
    index = hybrid.build_index(corpus[0], dim=32)
    dated = {i: d for i, d, _ in corpus[1]}
    bounds = {q: b for q, b, _ in queries[1]}
    first = hybrid.search_hybrid(queries[0], index, 5).collect()
    assert first and all(bounds[r["query_id"]] is None or dated[r["id"]] < bounds[r["query_id"]] for r in first)
    again = hybrid.search_hybrid(queries[0], index, 5).collect()
    assert sorted(first) == sorted(again)
    many = hybrid.search_hybrid(queries[0], index, 20).collect()
    assert sorted(r for r in many if r["rank"] <= 5) == sorted(first)


def test_cached_search_runs_once_per_question(spark, corpus, queries):
    tokens = keyword.token_table(chunk(corpus[0], "text", 100_000)).cache()
    asked, store = [], scratch_path(spark, "cached")

    def search(todo):
        asked.append(todo.count())
        return keyword.search_keyword(todo, tokens, 3)

    one = hybrid.search_cached(queries[0], store, "c", search)
    two = hybrid.search_cached(queries[0].withColumn("query_id", F.col("query_id") + 1000), store, "c", search)
    assert asked == [30, 0]
    shifted = {q - 1000: ids for q, ids in ids_by_query(two).items()}
    assert ids_by_query(one) == shifted


def test_row_queries_find_nine_tenths_of_their_neighbours(spark, sf_dir):
    from tidemark.queries import retrieval

    asked, vectors = retrieval.row_queries(spark, sf_dir), retrieval.vector_table(spark, sf_dir)
    exact = {(r.query_id, r.id) for r in dense.search_dense(asked, vectors, 10).collect()}
    found = {(r.query_id, r.id) for r in retrieval.ann_row_hits(spark, sf_dir).collect()}
    assert {q for q, _ in exact} == {r.id for r in vectors.collect() if r.id % 20 == 0}
    assert len(found & exact) >= 0.9 * len(exact)


def test_query_blocks_leave_one_plan(spark, corpus, queries, vectors, monkeypatch):
    """Hits of many blocks are one stored table: the plan is as long as for two blocks, the hits those of one."""
    index = hybrid.build_index(corpus[0], dim=32)
    whole = sorted(hybrid.search_hybrid(queries[0], index, 5).collect())
    lengths = []
    for rows in (16, 4):
        monkeypatch.setattr(hybrid, "QUERY_BLOCK_ROWS", rows)
        found = hybrid.search_hybrid(queries[0], index, 5)
        lengths.append(len(found._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        assert sorted(found.collect()) == whole
    assert lengths[0] == lengths[1]


def test_tasks_take_few_rows_with_token_lists_at_a_time(spark):
    rows = spark.range(5000).coalesce(1).selectExpr("id", "array('a', 'b') AS tokens")

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"n": [len(part)], "name": [part["tokens"].iloc[0][1]]})

    found = [tuple(r) for r in blocks.map_parts(rows, run, "n int, name string").collect()]
    assert sum(n for n, _ in found) == 5000 and max(n for n, _ in found) <= blocks.PART_ROWS
    assert {name for _, name in found} == {"b"}


def test_postings_are_counted_without_a_table_of_all_of_them(spark):
    """Rows of one chunk count together, null keys too, wherever a batch or a part of it ends."""
    rng = random.Random(3)
    rows = [(i // 3 if i > 6 else None, 0, None, 2, [rng.choice("abcd") for _ in range(2)] if i % 5 else []) for i in range(60)]
    kind = pa.schema([("id", pa.int64()), ("chunk_no", pa.int32()), ("doc_date", pa.date32()), ("doc_len", pa.int32()), ("tokens", pa.list_(pa.string()))])
    table = pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
    expected = collections.Counter((r[0], t) for r in rows for t in r[4])
    for size in (1, 2, 7, 60):
        found = pa.Table.from_batches(keyword._count_terms(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert {(r["id"], r["term"]): r["tf"] for r in found} == expected and len(found) == len(expected)
    df = spark.createDataFrame(rows, "id long, chunk_no int, doc_date date, doc_len int, tokens array<string>")
    assert {(r["id"], r["term"]): r["tf"] for r in keyword.build_postings(df).collect()} == expected
    assert "HashAggregate" not in keyword.build_postings(df)._jdf.queryExecution().executedPlan().toString()
