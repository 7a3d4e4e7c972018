"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash.

Documents are partitioned by the size of their shingle sets. In each partition a signature has a number of
bins that fits the partition's size, at least twice as many as shingles, and each bin keeps its least hash;
so an item's shingle is still in the signature of a document of any length with a chance of over 3/4,
and an item of 16 shingles is found by at least one of them almost surely (a miss below 1e-8). Items are
sketched once for each partition that can contain them. Smaller items are looked up by all shingles.
What the sketches propose is verified by exact containment of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import gram_hashes, in_batches, mix, pieces, word_hashes
from tidemark.llm.set_links import bit_field, in_field
from tidemark.session import materialize

SMALL_ITEM = 16
PARTITIONS = 40
ALL = PARTITIONS  # the partition number that stands for "every shingle, whatever the document's size"


def partition(size: int) -> int:
    """Number of the partition: sets of 2 ** (k - 1) + 1 to 2 ** k shingles."""
    return max(size - 1, 0).bit_length()


def sketch(values: np.ndarray, k: int) -> np.ndarray:
    """Least hash of each bin that is not empty; ``values`` is sorted, bins are ranges of equal width."""
    bins = values >> np.uint64(64 - (k + 1))
    return values[np.concatenate([[True], bins[1:] != bins[:-1]])]


def keys(values: np.ndarray, k: int) -> np.ndarray:
    return mix(values + mix(np.uint64([k + 1])))


def set_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.unique(gram_hashes(words, n)) if len(words) >= n else np.zeros(0, np.uint64)


def _item_rows(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            words, rows = word_hashes(batch.column("text"))
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                values = set_of(words[rows[i] : rows[i + 1]], n)
                if item is None or not len(values):
                    continue
                found = [("shingle", values)]
                if len(values) < SMALL_ITEM:
                    found.append(("key", keys(values, ALL)))
                else:
                    least = partition(-(-percent * len(values) // 100))
                    found += [("key", keys(sketch(values, k), k)) for k in range(least, PARTITIONS)]
                for kind, x in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(x)), pa.array([item] * len(x), pa.int64()),
                         pa.array([len(values)] * len(x), pa.int64()), pa.array(x.view(np.int64))],
                        ["kind", "item_id", "size", "id"])
    return run


def _doc_rows(n: int, key_bits, shingle_bits):
    """For documents whose sketch may have an item's key: those keys and the shingles that an item may have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_keys, in_shingles = key_bits.value, shingle_bits.value
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                words, rows = word_hashes(piece.column("text"))
                for i, row in enumerate(piece.column("row_key").to_pylist()):
                    values = set_of(words[rows[i] : rows[i + 1]], n)
                    if not len(values):
                        continue
                    k = partition(len(values))
                    found = np.concatenate([keys(values, ALL), keys(sketch(values, k), k)]).view(np.int64)
                    found = found[in_field(found, in_keys)]
                    if not len(found):
                        continue
                    shared = values.view(np.int64)
                    shared = shared[in_field(shared, in_shingles)]
                    both = np.concatenate([found, shared])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["key"] * len(found) + ["shingle"] * len(shared)),
                         pa.array(np.full(len(both), row)), pa.array(both)], ["kind", "row_key", "id"])
    return run


def find_items(docs: DataFrame, items: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(row_key, doc_id, item_id, n_shingles, n_found) for every document that contains an item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Words are runs of characters other than ASCII
    white space, A-Z lower-cased. A document contains an item if it has at least ``percent`` % of the item's
    distinct ``n_words`` shingles, anywhere. Texts of fewer words, null and empty ones contain nothing and
    are contained in nothing; null item ids are skipped. ``row_key`` hashes doc_id and text, and rows equal
    in both give one row per item. An item_id that repeats stands for the union of its texts' shingles.
    Other columns are ignored. Items of any number are joined, not broadcast: only two bit fields of
    fixed size are, which spare other rows from the join.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = materialize(items.mapInArrow(
        _item_rows(n_words, percent), "kind string, item_id long, size long, id long").distinct(), "items")
    item_keys = items.where("kind = 'key'").select("item_id", "id").distinct()
    item_shingles = items.where("kind = 'shingle'").select("item_id", "id").distinct()
    fields = [spark.sparkContext.broadcast(bit_field(x)) for x in (item_keys, item_shingles)]
    rows = materialize(docs.select("row_key", "text").mapInArrow(
        _doc_rows(n_words, *fields), "kind string, row_key long, id long").distinct(), "sketches")
    found = rows.where("kind = 'key'").join(item_keys, "id").select("row_key", "item_id").distinct()
    shared = rows.where("kind = 'shingle'").join(item_shingles, "id").groupBy("row_key", "item_id").agg(
        F.count("*").alias("n_found"))
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    hits = (shared.join(found, ["row_key", "item_id"], "left_semi").join(sizes, "item_id")
            .where(F.col("n_found") * 100 >= F.col("n_shingles") * percent))
    names = docs.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"))
    return hits.join(names, "row_key").select("row_key", "doc_id", "item_id", "n_shingles", "n_found")


def without_items(docs: DataFrame, items: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with all their columns, whatever their names, that contain no item; rows with null ids too."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    hits = find_items(docs, items, n_words, percent).select(F.col("row_key").alias(name)).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.withColumn(name, key).join(hits, name, "left_anti").drop(name)
