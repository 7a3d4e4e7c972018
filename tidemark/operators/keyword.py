"""Keyword index and BM25 scoring over chunk tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import tokenize
from tidemark.operators.blocks import (
    PART_ROWS, SCORE_CELLS, SCORE_DECIMALS, before_all, local_top_k, map_parts, one_table,
)
from tidemark.operators.topk import top_k_per_key
from tidemark.session import materialize

# The usual BM25 settings.
BM25_K1 = 1.2
BM25_B = 0.75

# Query terms that are sent to the tasks at a time.
MAX_BLOCK_TERMS = 1_000_000

CHUNK_KEY = ["id", "chunk_no"]


class KeywordIndex(NamedTuple):
    """``chunks``: id, chunk_no, doc_date, doc_len, tokens. ``postings``: the first four, term and tf."""

    chunks: DataFrame
    postings: DataFrame


def with_tokens(chunks: DataFrame) -> DataFrame:
    return chunks if "tokens" in chunks.columns else chunks.withColumn("tokens", tokenize(F.col("chunk")))


def token_table(chunks: DataFrame) -> DataFrame:
    """What keyword search reads: id, chunk_no, doc_date, doc_len, tokens."""
    return with_tokens(chunks).select(*CHUNK_KEY, "doc_date", F.size("tokens").alias("doc_len"), "tokens")


def _posting_rows(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Postings of rows in the order of their keys, and the row at which each one's key begins."""
    key = part.select([c for c in part.column_names if c != "tokens"])
    tokens = part["tokens"].combine_chunks()
    words = tokens.flatten().dictionary_encode()
    named = key.to_pandas().groupby(key.column_names, dropna=False, sort=False).ngroup().to_numpy()
    first = np.unique(named, return_index=True)[1]
    rows = np.repeat(first[named], pc.list_value_length(tokens).fill_null(0).to_numpy())
    cells, tf = np.unique(rows * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
    row, term = np.divmod(cells, max(1, len(words.dictionary)))
    found = key.take(pa.array(row)).append_column("term", words.dictionary.take(pa.array(term)))
    return found.append_column("tf", pa.array(tf, pa.int64())), row


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batch function over rows sorted by chunk: counts a few rows at a time, and keeps back the last chunk's counts, as the next
    rows may be of that chunk too."""
    held: pa.Table | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            found, row = _posting_rows(pa.Table.from_batches([batch.slice(start, PART_ROWS)]))
            if not len(row):
                continue
            key = found.column_names[:-2]
            if held is not None and held.slice(0, 1).select(key).equals(found.slice(0, 1).select(key)):
                n = int(np.searchsorted(row, row[0], "right"))
                both = pa.concat_tables([held, found.slice(0, n)]).group_by([*key, "term"]).aggregate([("tf", "sum")])
                found = pa.concat_tables([both.rename_columns(found.column_names), found.slice(n)])
                row = np.concatenate([np.full(len(both), row[0]), row[n:]])
            elif held is not None:
                yield from held.combine_chunks().to_batches()
            last = int(np.searchsorted(row, row[-1]))
            yield from found.slice(0, last).combine_chunks().to_batches()
            held = found.slice(last)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def build_postings(tokens: DataFrame) -> DataFrame:
    """Postings (id, chunk_no, doc_date, doc_len, term, tf) of a token table.

    Token arrays move once, by chunk, and are sorted there; terms are counted a few chunks at a time, so the many
    (chunk, term) rows neither shuffle nor stay in memory, and a term found everywhere is spread over all tasks.
    """
    key = [*CHUNK_KEY, "doc_date", "doc_len"]
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", term string, tf long"
    return tokens.select(*key, "tokens").repartition(*CHUNK_KEY).sortWithinPartitions(*key).mapInArrow(_count_terms, schema)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of every query (query_id, text, as_of)."""
    return queries.select(
        "query_id", "as_of", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")
    )


def _term_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """Query terms cut to blocks of at most about MAX_BLOCK_TERMS rows, by query."""
    terms = query_terms(queries)
    n = terms.limit(MAX_BLOCK_TERMS + 1).count()
    if n <= MAX_BLOCK_TERMS:
        yield terms
        return
    terms = materialize(terms, "query-terms")
    blocks = -(-terms.count() * 3 // (2 * MAX_BLOCK_TERMS))
    for b in range(blocks):
        yield terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k_per_key(found, ["query_id"], [F.desc("score"), F.asc("id"), F.asc("chunk_no")], k)


def search_keyword(queries: DataFrame, tokens: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best chunks of every query by BM25, dated strictly before the query's ``as_of``.

    A query without a bound sees everything. Counts and the mean length are those of the whole corpus.

    Token rows are scored where they lie and each task emits its own ``k`` best per query, so the
    shuffle carries queries x tasks x k rows. Query terms go out in blocks of bounded size, one pass
    over the tokens per block.
    """
    n, mean_len = tokens.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    rows = before_all(tokens, queries).select(*CHUNK_KEY, F.unix_date("doc_date").alias("day"), "doc_len", "tokens")
    fields = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *tokens.schema.fields]}
    schema = f"query_id {fields['query_id']}, id {fields['id']}, chunk_no {fields['chunk_no']}, score double"

    def parts() -> Iterator[DataFrame]:
        for terms in _term_blocks(queries):
            block = terms_with_frequency(terms, tokens).toPandas()
            if len(block):
                yield map_parts(rows, _bm25_top_k(block, n, mean_len, k), schema)

    return _best(one_table(queries.sparkSession, parts(), schema), k)


def terms_with_frequency(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, as_of_day, term, df) of the terms of one block of queries that occur in the corpus."""
    vocabulary = terms.select("term").distinct()
    seen = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).join(vocabulary, "term", "left_semi")
    frequency = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(frequency, "term").select("query_id", F.unix_date("as_of").alias("as_of_day"), "term", "df")


def _bm25_top_k(block: pd.DataFrame, n: int, mean_len: float, k: int):
    """Batch function: BM25 of one block of query terms against token rows."""
    score, query_ids, bounds = bm25_scorer(block, n, mean_len)
    return local_top_k(score, query_ids, bounds, k)


def bm25_scorer(block: pd.DataFrame, n: int, mean_len: float):
    """Function from token rows to a queries x rows matrix and a mask, the query ids and their bounds.

    ``block``: query_id, as_of_day, term and df of the terms that occur at all.
    """
    block = block.sort_values("term", kind="stable")
    vocabulary = pd.Index(block["term"].unique())
    term_no = vocabulary.get_indexer(block["term"])
    first = np.searchsorted(term_no, np.arange(len(vocabulary)))
    uses = np.bincount(term_no, minlength=len(vocabulary))
    query_no, query_ids = pd.factorize(block["query_id"])
    bounds = block.groupby(query_no)["as_of_day"].first().astype("float64").fillna(np.inf).to_numpy()
    df = block["df"].to_numpy(dtype=np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    n_queries = len(query_ids)

    def score(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sizes = part["tokens"].str.len().to_numpy()
        flat = np.concatenate(part["tokens"].tolist()) if sizes.sum() else np.array([], dtype=object)
        found = vocabulary.get_indexer(flat)
        cells = np.repeat(np.arange(len(part)), sizes) * len(vocabulary) + found
        cells, tf = np.unique(cells[found >= 0], return_counts=True)
        row, term = np.divmod(cells, len(vocabulary))
        norm = BM25_K1 * (1 - BM25_B + BM25_B * part["doc_len"].to_numpy() / mean_len)
        weight = tf * (BM25_K1 + 1) / (tf + norm[row])
        # Every (row, term) entry meets each query that uses the term.
        times = uses[term]
        starts = np.cumsum(times) - times
        entry = np.repeat(first[term] - starts, times) + np.arange(times.sum())
        pair = query_no[entry] * len(part) + np.repeat(row, times)
        scores = np.bincount(pair, np.repeat(weight, times) * idf[entry], minlength=n_queries * len(part))
        scores = scores.reshape(n_queries, len(part))
        return scores, scores > 0

    return score, query_ids.tolist(), bounds


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, doc_len: Column, mean_len: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / mean_len))


def search_postings(queries: DataFrame, index: KeywordIndex, k: int = 10) -> DataFrame:
    """Same answer as ``search_keyword``, by joins over a postings table.

    The choice for few, selective terms: only postings of the queries' terms are kept. They shuffle
    once, by chunk, over as many tasks as leave about ``SCORE_CELLS`` (query, chunk) pairs for each; queries are joined and scores
    summed inside that layout, and each task keeps its own ``k`` best per query, so the pairs never move.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *index.postings.schema.fields]}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, chunk_no {kinds['chunk_no']}, score double"
    parts = (_score_block(terms, index) for terms in _term_blocks(queries))
    return _best(one_table(queries.sparkSession, parts, schema), k)


def _score_block(terms: DataFrame, index: KeywordIndex) -> DataFrame:
    vocabulary = F.broadcast(terms.select("term").distinct())
    matched = index.postings.join(vocabulary, "term", "left_semi")

    chunks, asked = index.chunks.count(), terms.select("query_id").distinct().count()
    tasks = max(int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks * asked // SCORE_CELLS))
    n_chunks = F.lit(chunks)
    mean_len = index.chunks.agg(F.avg("doc_len")).scalar()
    frequency = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(frequency, "term").select(
        "query_id", "as_of", "term", bm25_idf(n_chunks, F.col("df")).alias("idf")
    )

    before = F.col("as_of").isNull() | (F.col("doc_date") < F.col("as_of"))
    score = F.round(
        F.sum(F.col("idf") * bm25_weight(F.col("tf"), F.col("doc_len"), mean_len)), SCORE_DECIMALS
    )
    return (
        matched.repartition(tasks, *CHUNK_KEY)
        .join(F.broadcast(weighted), "term")
        .filter(before)
        .groupBy("query_id", *CHUNK_KEY)
        .agg(score.alias("score"))
    )
