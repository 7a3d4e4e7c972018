"""Incremental jobs: keyed ingest, chunk building and feature filling as micro-batches.

Every job drains what is there (``AvailableNow``) and stops. Each micro-batch overwrites a folder of
its own number, so a batch that is replayed after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import index_store
from tidemark.operators.chunking import DEFAULT_MAX_CHARS, chunk
from tidemark.operators.etl import distinct_rows, unseen
from tidemark.sources.keyed import KeyedStore, upsert_keyed
from tidemark.sources.store import materialize_missing


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _earlier_batches(spark: SparkSession, store: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(store).filter(F.col("batch_id") != batch_id)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert_batch(batch: DataFrame, batch_id: int, store: str, key: str) -> None:
    """Append the distinct rows whose key is not stored yet."""
    fresh = distinct_rows(batch)
    stored = _earlier_batches(batch.sparkSession, store, batch_id)
    if stored is not None:
        fresh = unseen(fresh, stored, [key])
    fresh.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def stream_upsert(source: DataFrame, store: str, key: str, checkpoint: str) -> None:
    """Skip ids already stored, append the rest."""
    query = (
        source.writeStream.foreachBatch(lambda df, n: upsert_batch(df, n, store, key))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_keyed(source: DataFrame, store: KeyedStore, checkpoint: str) -> None:
    """As ``stream_upsert``, into a store of key buckets: a micro-batch reads the buckets of its own keys only."""
    query = (
        source.writeStream.foreachBatch(lambda df, n: upsert_keyed(df, store, f"batch-{n}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_index(source: DataFrame, store: str, text: str, checkpoint: str, max_chars: int = DEFAULT_MAX_CHARS) -> None:
    """Chunk new records and append them; a restart goes on where the checkpoint stands."""
    query = (
        chunk(source, text, max_chars).writeStream.format("parquet").option("path", store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_segments(source: DataFrame, path: str, checkpoint: str, **settings) -> None:
    """Add every micro-batch of (id, doc_date, text) to the stored index at ``path`` as a segment of its own number.

    A batch that is replayed after a failure finds its segment in the log and adds nothing, or writes it anew.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        index_store.append(batch, path, segment=f"batch-{batch_id}", **settings)

    query = (
        source.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_features(
    source: DataFrame, store: str, plan_hash: str, compute: Callable[[DataFrame], DataFrame],
    on: list[str], checkpoint: str,
) -> None:
    """Compute features of records that have none under this plan yet."""

    def fill(batch: DataFrame, batch_id: int) -> None:
        materialize_missing(batch, store, plan_hash, compute, on, batch=f"stream-{batch_id}")

    query = (
        source.writeStream.foreachBatch(fill)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
