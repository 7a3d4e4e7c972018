"""Score a block of queries against Arrow batches, keeping only each task's best hits per query."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import scratch_path

# Scores are ranked after rounding: sums of doubles depend on their order, and equal texts must tie.
SCORE_DECIMALS = 6
SCORE_CELLS = 4_000_000

# Rows with token lists that a Python worker holds as Python objects at a time.
PART_ROWS = 1024

# Up to so many values are written into a scan's filter.
PUSHED_VALUES = 1000


def map_parts(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As ``mapInPandas``, but a task turns only ``PART_ROWS`` rows at a time to pandas, however many a batch has: a list of
    strings takes many times its Arrow size there."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, PART_ROWS).to_pandas() for b in batches for at in range(0, b.num_rows, PART_ROWS))
        for found in run(parts):
            yield pa.RecordBatch.from_pandas(found, schema=out, preserve_index=False)

    return rows.mapInArrow(convert, schema)


class _Best:
    """The best ``k`` hits per query seen so far in one task, and the score a new hit has to reach."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.hits: dict[int, pd.DataFrame] = {}

    def add(self, query: int, score: np.ndarray, ids, chunk_nos) -> None:
        found = pd.DataFrame({"score": score, "id": ids, "chunk_no": chunk_nos})
        if query in self.hits:
            found = pd.concat([self.hits[query], found])
        found = found.sort_values(["score", "id", "chunk_no"], ascending=[False, True, True]).head(self.k)
        self.hits[query] = found
        if len(found) == self.k:
            self.floor[query] = found["score"].iloc[-1]


def local_top_k(
    score: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], query_ids: list, as_of_days: np.ndarray, k: int,
    step: int | None = None,
):
    """Batch function for ``mapInPandas`` over rows with ``id, chunk_no, day`` and what ``score`` reads.

    ``score`` returns a queries x rows matrix and a mask of the pairs that count. Rows dated on or after
    a query's bound are dropped here, before ranking; infinite bounds let rows without a date in.
    """
    step = step or max(1, SCORE_CELLS // max(1, len(query_ids)))
    open_ended = np.isinf(as_of_days)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(query_ids), k)
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start:start + step]
                scores, counted = score(part)
                scores = np.round(scores, SCORE_DECIMALS)
                days = part["day"].to_numpy(dtype=np.float64)[None, :]
                hopeful = counted & ((days < as_of_days[:, None]) | open_ended) & (scores >= best.floor[:, None])
                ids, chunk_nos = part["id"].to_numpy(), part["chunk_no"].to_numpy()
                for q in np.flatnonzero(hopeful.any(axis=1)):
                    pick = np.flatnonzero(hopeful[q])
                    if len(pick) > k:
                        cut = np.partition(scores[q, pick], len(pick) - k)[len(pick) - k]
                        pick = pick[scores[q, pick] >= cut]
                    best.add(q, scores[q, pick], ids[pick], chunk_nos[pick])
        for q, hits in best.hits.items():
            hits.insert(0, "query_id", query_ids[q])
            yield hits[["query_id", "id", "chunk_no", "score"]]

    return run


def latest_day(queries: DataFrame) -> int | None:
    """The greatest as-of day of the queries; None if one has no bound. Rows dated then or later are seen by none."""
    bound = queries.agg(F.max(F.unix_date("as_of")), F.count(F.when(F.col("as_of").isNull(), 1))).first()
    return None if bound[1] else bound[0]


def before_all(rows: DataFrame, queries: DataFrame, column: str = "doc_date") -> DataFrame:
    """``rows`` that at least one query may see, by a date filter that reaches the scan."""
    day = latest_day(queries)
    return rows if day is None else rows.where(F.col(column) < F.date_from_unix_date(F.lit(day)))


def only_among(rows: DataFrame, column: str, values: DataFrame, also: Callable[[DataFrame, list], DataFrame] | None = None) -> DataFrame:
    """``rows`` whose ``column`` is among those of ``values``: by a filter that the scan can use if they are few, which
    ``also`` may add to, else by a join."""
    few = [r[0] for r in values.select(column).distinct().limit(PUSHED_VALUES + 1).collect()]
    if len(few) > PUSHED_VALUES:
        return rows.join(values.select(column).distinct(), column, "left_semi")
    rows = rows.where(F.col(column).isin([v for v in few if v is not None]))
    return also(rows, few) if also else rows


def one_table(spark: SparkSession, parts: Iterable[DataFrame], schema: str) -> DataFrame:
    """The hits of all query blocks. A single block is passed on; several are run one after the other and added to
    one stored table, so the driver holds one block at a time and the plan does not grow with the queries."""
    parts = iter(parts)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return first
    path = scratch_path(spark, "hits")
    for part in (first, second):
        part.write.mode("append").parquet(path)
    del first, second
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
