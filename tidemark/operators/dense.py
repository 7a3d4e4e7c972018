"""Dense encoding and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.blocks import before_all, local_top_k, one_table
from tidemark.operators.topk import top_k_per_key
from tidemark.session import materialize, scratch_path

DEFAULT_DIM = 256
ENCODE_BATCH = 4096
QUERY_BLOCK_ROWS = 4096


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def encode(
    df: DataFrame, column: str, encoder: Callable[[list], np.ndarray], batch: int = ENCODE_BATCH, item: str = "float"
) -> DataFrame:
    """Add ``vec`` from any encoder that turns a list of texts to a matrix, one call per batch."""
    number = {"float": T.FloatType(), "double": T.DoubleType()}[item]
    schema = T.StructType([*df.schema.fields, T.StructField("vec", T.ArrayType(number))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch].copy()
                part["vec"] = list(np.asarray(encoder(part[column].tolist())))
                yield part

    return df.mapInPandas(run, schema)


def term_bucket(term: Column, dim: int) -> Column:
    """Hash bucket of a term: the first 32 bits of its MD5 modulo ``dim``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim).cast("int")


def token_buckets(tokens: Column, dim: int) -> Column:
    return F.transform(tokens, lambda t: term_bucket(t, dim))


def bucket_idf(buckets: DataFrame, column: str, dim: int) -> np.ndarray:
    """Smoothed inverse document frequency per bucket: ``ln((n + 1) / (df + 1))``, 0 for unseen ones.

    ``dim`` counts come back to the driver, whatever the size of the corpus.
    """
    seen = buckets.select(F.explode(F.array_append(F.array_distinct(column), F.lit(-1))).alias("b"))
    counts = {r["b"]: r["n"] for r in seen.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.pop(-1, 0)
    idf = np.zeros(dim)
    for bucket, df in counts.items():
        idf[bucket] = np.log((n + 1) / (df + 1))
    return idf


def unit_tfidf(rows: list, idf: np.ndarray) -> np.ndarray:
    """Lists of buckets to rows of counts times idf, scaled to length 1."""
    dim = len(idf)
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    cells = np.repeat(np.arange(len(rows)), sizes) * dim
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if sizes.sum() else cells
    counts = np.bincount(cells + flat, minlength=len(rows) * dim).reshape(len(rows), dim)
    return _unit_rows(counts * idf)


def hashed_tfidf(df: DataFrame, buckets: str, idf: np.ndarray) -> DataFrame:
    """The offline encoder: counts per hash bucket times idf, scaled to length 1, as ``vec``.

    Nothing is grouped or shuffled. A text without any weighted term has the zero vector, whose cosine is 0.
    """
    return encode(df, buckets, lambda rows: unit_tfidf(rows, idf), item="double").drop(buckets)


def _cosine_top_k(block: pd.DataFrame, k: int):
    """Batch function: cosine of one query block against vector rows."""
    queries = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in block["qvec"]]))

    def score(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        scores = queries @ _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]])).T
        return scores, np.ones_like(scores, dtype=bool)

    bounds = block["as_of_day"].astype("float64").fillna(np.inf).to_numpy()
    return local_top_k(score, block["query_id"].tolist(), bounds, k)


def search_dense(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top-k: ``queries`` (query_id, qvec, as_of) over ``vectors`` (id, chunk_no, doc_date, vec).

    Queries go out in blocks of bounded rows, one pass over the vectors per block. Every task emits
    only its own ``k`` best per query, so the shuffle carries queries x tasks x k rows at most.
    """
    small = queries.select(
        "query_id", F.col("qvec").cast("array<double>").alias("qvec"), F.unix_date("as_of").alias("as_of_day"),
    ).filter("qvec is not null")
    side = before_all(vectors, queries).filter("vec is not null").select(
        "id", "chunk_no", "vec", F.unix_date("doc_date").alias("day"))
    fields = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}
    schema = f"query_id {fields['query_id']}, id {fields['id']}, chunk_no {fields['chunk_no']}, score double"

    block = small.limit(QUERY_BLOCK_ROWS + 1).toPandas()
    if len(block) <= QUERY_BLOCK_ROWS:
        blocks = [block]
    else:
        small = materialize(small, "queries")
        n = -(-small.count() * 3 // (2 * QUERY_BLOCK_ROWS))
        place = F.pmod(F.xxhash64("query_id"), F.lit(n))
        blocks = (small.filter(place == b).toPandas() for b in range(n))

    parts = (side.mapInPandas(_cosine_top_k(block, k), schema) for block in blocks if len(block))
    found = one_table(queries.sparkSession, parts, schema)
    return top_k_per_key(found, ["query_id"], [F.desc("score"), F.asc("id"), F.asc("chunk_no")], k)


class CellIndex(NamedTuple):
    """``vectors`` with a ``cell`` each, stored by cell, and the unit cell centres."""

    vectors: DataFrame
    centres: np.ndarray


def build_cells(vectors: DataFrame, cells: int = 16, seed: int = 42, max_iter: int = 20) -> CellIndex:
    """Put every vector in its nearest k-means cell and store the table partitioned by cell.

    Only the centres reach the driver. A scan that names cells reads no others.
    """
    # Unit vectors under Euclidean distance order like cosine, and a zero vector is still accepted.
    raw = vectors.withColumn("_raw", array_to_vector(F.col("vec").cast("array<double>")))
    prepared = Normalizer(inputCol="_raw", outputCol="_unit").transform(raw)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="_unit", predictionCol="cell").fit(prepared)
    placed = model.transform(prepared).drop("_raw", "_unit")
    path = scratch_path(vectors.sparkSession, "cells")
    placed.write.partitionBy("cell").parquet(path)
    stored = vectors.sparkSession.read.schema(placed.schema).parquet(path)
    return CellIndex(stored, _unit_rows(np.stack(model.clusterCenters())))


def nearest_cells(queries: np.ndarray, centres: np.ndarray, nprobe: int) -> np.ndarray:
    """Numbers of the ``nprobe`` centres closest to each query by cosine, nearest first."""
    return np.argsort(-(_unit_rows(queries) @ centres.T), axis=1, kind="stable")[:, :nprobe]


def _probe_top_k(block: pd.DataFrame, cells: np.ndarray, k: int):
    """Batch function: cosine of each query with the vectors of its own cells, nothing else."""
    queries = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in block["qvec"]]))
    bounds = block["as_of_day"].astype("float64").fillna(np.inf).to_numpy()
    ids = block["query_id"].tolist()
    of_cell = {c: np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compared = np.zeros(len(ids), dtype=np.int64)
        best: list[pd.DataFrame] = []
        for pdf in batches:
            for cell, part in pdf.groupby("cell"):
                rows = of_cell.get(cell, ())
                if not len(rows):
                    continue
                compared[rows] += len(part)
                scores = queries[rows] @ _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]])).T
                own = local_top_k(
                    lambda p, s=scores: (s, np.ones_like(s, dtype=bool)), [ids[q] for q in rows], bounds[rows], k,
                    step=len(part))
                best += own(iter([part]))
        hits = pd.concat(best) if best else pd.DataFrame(columns=["query_id", "id", "chunk_no", "score"])
        hits = hits.sort_values(["score", "id", "chunk_no"], ascending=[False, True, True]).groupby("query_id").head(k)
        yield hits.assign(compared=0)
        counts = pd.DataFrame({"query_id": ids, "compared": compared})[compared > 0]
        yield counts.assign(id=None, chunk_no=None, score=None)[["query_id", "id", "chunk_no", "score", "compared"]]

    return run


def search_ann(queries: DataFrame, index: CellIndex, k: int = 10, nprobe: int = 4) -> DataFrame:
    """Approximate top-k over the vectors in each query's ``nprobe`` nearest cells, with the number of vectors
    that the query was ``compared`` with.

    Cells that no query of a block probes are pruned from the scan; in a task, a cell's rows meet only the
    queries that probe it. A hot cell is not a hot task: cells are a layout, not a shuffle key. Runs a job
    per block of queries when called.
    """
    vectors, spark = index.vectors, queries.sparkSession
    small = materialize(queries.select(
        "query_id", F.col("qvec").cast("array<double>").alias("qvec"), F.unix_date("as_of").alias("as_of_day"),
    ).filter("qvec is not null"), "queries")
    latest = small.select(F.max(F.coalesce("as_of_day", F.lit(2**31 - 1)))).first()[0]
    side = vectors.filter(F.col("vec").isNotNull()).withColumn("day", F.unix_date("doc_date"))
    if latest is not None and latest < 2**31 - 1:
        side = side.filter(F.col("doc_date") < F.date_from_unix_date(F.lit(latest)))
    fields = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}
    schema = (f"query_id {fields['query_id']}, id {fields['id']}, chunk_no {fields['chunk_no']}, score double, "
              "compared long")
    blocks = max(1, -(-small.count() // QUERY_BLOCK_ROWS))

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            block = small.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
            if len(block):
                cells = nearest_cells(np.stack(block["qvec"].tolist()), index.centres, nprobe)
                probed = side.filter(F.col("cell").isin([int(c) for c in np.unique(cells)]))
                yield probed.select("id", "chunk_no", "vec", "day", "cell").mapInPandas(_probe_top_k(block, cells, k), schema)

    found = one_table(spark, parts(), schema)
    counts = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    hits = found.filter("id is not null").drop("compared")
    best = top_k_per_key(hits, ["query_id"], [F.desc("score"), F.asc("id"), F.asc("chunk_no")], k)
    return best.join(counts, "query_id")
