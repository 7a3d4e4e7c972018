"""Hybrid search, result rendering and repeat searches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.lists import first_items
from tidemark.functions.text import encode_json, tokenize
from tidemark.operators.chunking import DEFAULT_MAX_CHARS, chunk
from tidemark.operators.dense import (
    DEFAULT_DIM, QUERY_BLOCK_ROWS, bucket_idf, hashed_tfidf, token_buckets, unit_tfidf,
)
from tidemark.operators.etl import recode_outcome
from tidemark.operators.blocks import (
    SCORE_CELLS, SCORE_DECIMALS, before_all, local_top_k, map_parts, one_table, only_among,
)
from tidemark.operators.keyword import (
    MAX_BLOCK_TERMS, bm25_scorer, query_terms, terms_with_frequency, token_table, with_tokens,
)
from tidemark.operators.topk import top_k_per_key
from tidemark.session import materialize
from tidemark.sources.store import materialize_missing

# Hits per search, and the line between rendered hits.
HITS = 10
DIVIDER = "\n\n---------\n\n"


class SearchIndex(NamedTuple):
    """``chunks`` (id, chunk_no, doc_date, chunk, tokens, buckets), token table, vectors, bucket idf."""

    chunks: DataFrame
    tokens: DataFrame
    vectors: DataFrame
    idf: np.ndarray


def build_index(corpus: DataFrame, max_chars: int = DEFAULT_MAX_CHARS, dim: int = DEFAULT_DIM) -> SearchIndex:
    """Chunk, tokenize and encode a corpus (id, doc_date, text) into shared tables.

    Rows without a date are left out, as no as-of search could return them.
    """
    dated = corpus.select("id", "doc_date", "text").dropna(subset=["doc_date"])
    tokens = with_tokens(chunk(dated, "text", max_chars))
    chunks = materialize(tokens.withColumn("buckets", token_buckets(F.col("tokens"), dim)), "chunks")
    hashed = chunks.select("id", "chunk_no", "doc_date", "buckets")
    idf = bucket_idf(hashed, "buckets", dim)
    vectors = materialize(hashed_tfidf(hashed, "buckets", idf), "vectors")
    return SearchIndex(chunks, token_table(chunks), vectors, idf)


def encode_queries(queries: DataFrame, index: SearchIndex) -> DataFrame:
    buckets = token_buckets(tokenize(F.col("text")), len(index.idf))
    hashed = queries.select("query_id", "as_of", buckets.alias("buckets"))
    return hashed_tfidf(hashed, "buckets", index.idf).withColumnRenamed("vec", "qvec")


def _scaled(scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows scaled to 0..1 between their bounds; a constant row scales to 1."""
    wide = high > low
    span = np.where(wide, high - low, 1.0)[:, None]
    return np.where(wide[:, None], (scores - np.where(wide, low, 0.0)[:, None]) / span, 1.0)


def _both_sides(vectors: pd.DataFrame, terms: pd.DataFrame, idf: np.ndarray, n: int, mean_len: float):
    """Function from chunk rows to the rounded dense and keyword scores (queries x rows) and the mask of keyword
    hits, with the query ids and bounds, for one block of queries."""
    queries = np.stack([np.asarray(v, dtype=np.float64) for v in vectors["qvec"]])
    ids = vectors["query_id"].tolist()
    bounds = vectors["as_of_day"].astype("float64").fillna(np.inf).to_numpy()
    place = {q: i for i, q in enumerate(ids)}
    keyword, named, _ = bm25_scorer(terms, n, mean_len) if len(terms) else (None, [], None)
    rows = np.array([place[q] for q in named], dtype=np.int64)

    def score(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dense = np.round(queries @ unit_tfidf(part["buckets"].tolist(), idf).T, SCORE_DECIMALS)
        scores, hit = np.zeros_like(dense), np.zeros(dense.shape, dtype=bool)
        if keyword is not None:
            found, mask = keyword(part)
            scores[rows], hit[rows] = np.round(found, SCORE_DECIMALS), mask
        return dense, scores, hit

    return score, ids, bounds


def _score_bounds(score, ids: list, bounds: np.ndarray):
    """Batch function: the least and greatest score of each side over what each query may see in this task."""
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    names = ["dense_low", "dense_high", "keyword_low", "keyword_high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(ids), 1))
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start:start + step]
                dense, keyword, hit = score(part)
                open_ = (part["day"].to_numpy(dtype=np.float64) < bounds[:, None]) | np.isinf(bounds)[:, None]
                for at, scores, mask in ((0, dense, open_), (2, keyword, open_ & hit)):
                    seen[:, at] = np.minimum(seen[:, at], np.where(mask, scores, np.inf).min(axis=1, initial=np.inf))
                    seen[:, at + 1] = np.maximum(
                        seen[:, at + 1], np.where(mask, scores, -np.inf).max(axis=1, initial=-np.inf))
        yield pd.DataFrame(seen, columns=names).assign(query_no=np.arange(len(ids)))[["query_no", *names]]

    return run


def search_hybrid(queries: DataFrame, index: SearchIndex, k: int = HITS, weight: float = 0.5) -> DataFrame:
    """``queries`` (query_id, text, as_of) to the ``k`` best chunks each, dated before ``as_of``.

    The score is the weighted sum of both sides' scores, each min-max scaled over all chunks that the query
    may see; a chunk without any query term counts 0 on the keyword side. Nothing is cut before ranking, so
    the first hits do not depend on ``k``. Both sides are scored in the same task: one pass over the
    chunks for the bounds and one for the hits, per block of queries. Runs jobs when called.
    """
    encoded = materialize(encode_queries(queries, index).select(
        "query_id", F.unix_date("as_of").alias("as_of_day"), "qvec"), "queries")
    terms = materialize(query_terms(queries), "query-terms")
    blocks = max(1, -(-encoded.count() // QUERY_BLOCK_ROWS), -(-terms.count() // MAX_BLOCK_TERMS))
    place = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    n, mean_len = index.tokens.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    rows = before_all(index.chunks, queries).select(
        "id", "chunk_no", F.unix_date("doc_date").alias("day"), F.size("tokens").alias("doc_len"), "tokens", "buckets")
    fields = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *index.chunks.schema.fields]}
    schema = f"query_id {fields['query_id']}, id {fields['id']}, chunk_no {fields['chunk_no']}, score double"
    names = ["dense_low", "dense_high", "keyword_low", "keyword_high"]

    def part(b: int) -> DataFrame | None:
        vectors = encoded.filter(place == b).toPandas()
        if not len(vectors) or not n:
            return None
        used = terms_with_frequency(terms.filter(place == b), index.tokens).toPandas()
        score, ids, bounds = _both_sides(vectors, used, index.idf, n, mean_len)
        seen = map_parts(rows, _score_bounds(score, ids, bounds), "query_no long, " + ", ".join(f"{c} double" for c in names))
        least = seen.groupBy("query_no").agg(*[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in names])
        edges = least.toPandas().set_index("query_no").reindex(range(len(ids)))[names].to_numpy().T

        def combined(chunk_rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            dense, keyword, hit = score(chunk_rows)
            total = weight * _scaled(dense, edges[0], edges[1])
            total = total + (1 - weight) * np.where(hit, _scaled(keyword, edges[2], edges[3]), 0.0)
            return total, np.ones_like(total, dtype=bool)

        return map_parts(rows, local_top_k(combined, ids, bounds, k), schema)

    found = one_table(queries.sparkSession, (p for p in map(part, range(blocks)) if p is not None), schema)
    return top_k_per_key(found, ["query_id"], [F.desc("score"), F.asc("id"), F.asc("chunk_no")], k)


def attach_parent(hits: DataFrame, parent: DataFrame) -> DataFrame:
    """Add the parent record of each hit. The ids of few hits are a filter of the parent's scan, so row groups
    without one are not read and nothing but the hits is shuffled."""
    hits = materialize(hits, "hits")
    return hits.join(only_among(parent, "id", hits), "id")


def attach_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    hits = materialize(hits, "hits")
    return hits.join(only_among(chunks.select("id", "chunk_no", "chunk"), "id", hits), ["id", "chunk_no"])


def search_articles(
    queries: DataFrame, index: SearchIndex, articles: DataFrame, heavy: list[str] = (),
    authors: str | None = None, k: int = HITS,
) -> DataFrame:
    """As-of article search: the chunk stands in for the body, heavy columns go, five authors stay."""
    hits = attach_parent(attach_chunk(search_hybrid(queries, index, k), index.chunks), articles)
    if authors:
        hits = hits.withColumn(authors, first_items(F.col(authors), 5))
    return hits.drop(*heavy)


def search_trials(
    queries: DataFrame, index: SearchIndex, trials: DataFrame, heavy: list[str] = (), k: int = HITS
) -> DataFrame:
    """As-of trial search: heavy columns go, the outcome is spelled out."""
    hits = attach_parent(attach_chunk(search_hybrid(queries, index, k), index.chunks), trials)
    return hits.withColumn("outcome", recode_outcome(F.col("outcome"))).drop(*heavy)


def render_hits(hits: DataFrame, columns: list[str]) -> DataFrame:
    """One text per query: its hits as JSON in rank order with a divider line between them."""
    record = F.struct("rank", encode_json(F.struct(*columns)).alias("json"))
    ranked = F.array_sort(F.collect_list(record))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda r: r["json"]), DIVIDER).alias("rendered")
    )


def query_hash(text: Column, as_of: Column, settings: str = "") -> Column:
    return F.sha2(F.concat_ws("|", text, F.coalesce(as_of.cast("string"), F.lit("")), F.lit(settings)), 256)


def search_cached(
    queries: DataFrame, store: str, index_name: str, search, batch: str | None = None, settings: str = ""
) -> DataFrame:
    """Same query, date and settings, same answer: each distinct (text, as_of) is searched once and kept.

    ``search`` takes (query_id, text, as_of) rows. ``settings`` names what else its answers depend on, such
    as the number of hits and the weight; it is part of the stored key. Results are stored under the index
    name.
    """
    hashed = queries.withColumn("query_hash", query_hash(F.col("text"), F.col("as_of"), settings))

    def compute(todo: DataFrame) -> DataFrame:
        found = search(todo.withColumnRenamed("query_hash", "query_id"))
        hit = F.struct("rank", "id", "chunk_no", "score")
        lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
        named = lists.withColumnRenamed("query_id", "query_hash")
        # A query without hits is an answer too, so it is stored as one.
        return todo.select("query_hash").join(named, "query_hash", "left").withColumn("ok", F.lit(True))

    keys = hashed.select("query_hash", "text", "as_of").distinct()
    answers = materialize_missing(keys, store, index_name, compute, ["query_hash"], batch).rows
    found = answers.select("query_hash", F.explode("hits").alias("h")).select("query_hash", "h.*")
    return hashed.select("query_id", "query_hash").join(found, "query_hash").drop("query_hash")
