"""Exact removal of word windows that an earlier document has, behind a count-min sketch.

First pass: every task counts the windows of its texts in the cells of a sketch and sends what it has, block by
block, as gaps between the cells it touched; blocks are added up where they meet. A cell counts every window that
falls into it, so a window's least cell never shows less than its number of occurrences. Second pass: windows with
a cell below two occur once and are done. The others, among them all that do repeat, are grouped exactly: a chunk
of texts keeps the least document of each of its windows, sends that one to the window's bucket and settles the rest
itself, so a window found everywhere gives one entry per chunk. Buckets find each window's least document, and
the starts of all others go back to their texts.

The sketch grows with the input up to ``max_cells`` cells a row (``ROWS`` * ``max_cells`` / 8 bytes are broadcast). Above
that it lets more single windows through to the exact pass, which costs shuffle but never changes the result.
Windows are compared by 96 bits of hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import (
    GRAM_FACTORS, by_bucket, gram_hashes, in_batches, joined, mix, pieces, span_hashes, utf8, word_spans,
)
from tidemark.session import materialize

WINDOW = 13
ROWS = 2
MAX_CELLS = 1 << 28
LEAST_CELLS = 1 << 16
BLOCK_BITS = 16
WORD_BYTES = 6
CHUNK_WINDOWS = 1 << 21
BUCKET_WINDOWS = 1 << 21
LEAST_BUCKETS = 64
NO_ID = np.iinfo(np.int64).max
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and for every window of ``size`` words in one text: its first word, row and hash."""
    data, offsets = utf8(column)
    starts, ends, at = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, lower=False)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(words) < size:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    return words, inside, row[inside], gram_hashes(words, size)[inside]


def cells_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cell of every window in each row of the sketch, which has ``2 ** bits`` cells a row."""
    return [(mix(keys + np.uint64(0x9E3779B97F4A7C15 * r & 0xFFFF_FFFF_FFFF_FFFF)) >> np.uint64(64 - bits)).astype(np.uint32)
            for r in range(ROWS)]


def packed(cells: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Blocks of sorted distinct cells, and for each the gaps between its cells: one byte, after 255s for long gaps."""
    block = cells >> np.uint32(BLOCK_BITS)
    first = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
    gaps = np.diff(cells, prepend=np.uint32(0))
    gaps[first] = cells[first] & np.uint32((1 << BLOCK_BITS) - 1)
    ends = np.cumsum(gaps // 255 + 1, dtype=np.int64)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    cuts = np.concatenate([np.concatenate([[0], ends])[first], ends[-1:]]) if len(ends) else np.zeros(1)
    values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
    return block[first].astype(np.int64), values


def unpacked(gaps: bytes) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _sketches(size: int, bits: int):
    """The blocks of this task's sketches: cells met once, and more than once, by a chunk of windows."""
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for r, cells in enumerate(cells_of(np.concatenate(held), bits)):
            cells.sort()
            new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            many = np.diff(np.append(new, len(cells))) > 1
            for times, chosen in ((1, cells[new[~many]]), (2, cells[new[many]])):
                block, gaps = packed(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block + (r << (bits - BLOCK_BITS))), pa.array(np.full(len(block), times, np.int32)), gaps],
                    ["block", "times", "gaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                held.append(windows(piece.column("text"), size)[3])
                waiting += len(held[-1])
                if waiting >= 2 * CHUNK_WINDOWS:
                    yield from flush(held)
                    held, waiting = [], 0
        if waiting:
            yield from flush(held)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the cells that were met twice or more, as bits; blocks come one after the other."""
    last, counts = None, np.zeros(1 << BLOCK_BITS, np.uint8)

    def done() -> list[tuple]:
        return [(last, np.packbits(counts > 1, bitorder="little").tobytes())] if last is not None and counts.max() > 1 else []

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["block", "bits"])

    for batch in in_batches(batches):
        found = []
        for block, times, gaps in zip(*(batch.column(c).to_pylist() for c in ("block", "times", "gaps")), strict=True):
            if block != last:
                found += done()
                last = block
                counts[:] = 0
            cells = unpacked(gaps)
            counts[cells] = np.minimum(counts[cells] + times, 2)
        if found:
            yield give(found)
    if rest := done():
        yield give(rest)


def repeated_cells(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bits of the cells of the merged sketch that show two or more, row after row."""
    blocks = docs.select("text").mapInArrow(_sketches(size, bits), "block long, times int, gaps binary")
    blocks = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block long, bits binary")
    out = np.zeros((ROWS << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for batch in blocks.toArrow().to_batches():
        for block, value in zip(batch.column("block").to_pylist(), batch.column("bits"), strict=True):
            out[block] = np.frombuffer(value.as_buffer(), np.uint8)
    return out.ravel()


def estimated_repeated(keys: np.ndarray, field: np.ndarray, bits: int) -> np.ndarray:
    yes = np.ones(len(keys), bool)
    for r, cells in enumerate(cells_of(keys, bits)):
        at = cells.astype(np.int64) + (r << bits)
        yes &= (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return yes


def groups_of(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (key, check) together, and where each group begins in it."""
    order = np.argsort(keys, kind="stable")
    key, check = keys[order], checks[order]
    if ((key[1:] == key[:-1]) & (check[1:] != check[:-1])).any():
        order = np.lexsort((checks, keys))
        key, check = keys[order], checks[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    return order, np.flatnonzero(new)


def later(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an entry's window also has an entry with a smaller id."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order, begin = groups_of(keys, checks)
        least = np.minimum.reduceat(ids[order], begin)
        out[order] = ids[order] > np.repeat(least, np.diff(np.append(begin, len(keys))))
    return out


RUNS = ["bucket", "row_keys", "counts", "firsts", "pasts"]


def dealt_runs(row_keys: np.ndarray, positions: np.ndarray, buckets: int, sign: int) -> list[tuple]:
    """One entry per bucket of texts: the runs of consecutive starts in each text."""
    if not len(row_keys):
        return []
    bucket = (mix(row_keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((positions, row_keys, bucket))
    row_keys, positions, bucket = row_keys[order], positions[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (row_keys[1:] != row_keys[:-1]) | (positions[1:] > positions[:-1] + 1)
    begin = np.flatnonzero(new)
    past = (positions[np.append(begin[1:], len(order)) - 1] + 1).astype(np.int32)
    row_keys, first, bucket = row_keys[begin], positions[begin].astype(np.int32), bucket[begin]
    out = []
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        own = np.flatnonzero(np.concatenate([[True], row_keys[a + 1 : b] != row_keys[a : b - 1]]))
        counts = np.diff(np.append(own, b - a)).astype(np.int32)
        out.append((sign * int(bucket[a] + 1), row_keys[a:b][own].tobytes(), counts.tobytes(), first[a:b].tobytes(),
                    past[a:b].tobytes()))
    return out


ENTRIES = "bucket long, row_keys binary, counts binary, firsts binary, pasts binary, keys binary, checks binary, ids binary, rows binary"


def _entries(size: int, bits: int, buckets: int, field):
    """Of each chunk: the windows that may repeat and their least documents, by the window's bucket; and the starts
    in other documents of the chunk, which are settled (negative buckets)."""
    factors = GRAM_FACTORS[size : 2 * size]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        keys, checks, ids, row_keys, positions = (np.concatenate([x[i] for x in held]) for i in range(5))
        settled = later(keys, checks, ids)
        out = [(*x, None, None, None, None) for x in dealt_runs(row_keys[settled], positions[settled], buckets, -1)]
        keys, checks, ids, row_keys, positions = (x[~settled] for x in (keys, checks, ids, row_keys, positions))
        bucket = (keys >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
            at = order[a:b]
            texts, one, own = np.unique(row_keys[at], return_index=True, return_inverse=True)
            out.append((int(bucket[a] + 1), texts.tobytes(), None, positions[at].astype(np.int32).tobytes(), None,
                        keys[at].tobytes(), checks[at].tobytes(), ids[at][one].tobytes(), own.astype(np.int32).tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 8]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [*RUNS, "keys", "checks", "ids", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, known = [], 0, field.value
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                words, first, row, keys = windows(piece.column("text"), size)
                if not len(keys):
                    continue
                chosen = estimated_repeated(keys, known, bits)
                first, row, keys = first[chosen], row[chosen], keys[chosen]
                checks = np.zeros(len(first), np.uint64)
                for i in range(size):
                    checks += words[first + i] * factors[i]
                _, _, at = word_spans(*utf8(piece.column("text")))
                held.append((keys, (mix(checks) >> np.uint64(32)).astype(np.uint32), piece.column("rank").to_numpy()[row],
                             piece.column("row_key").to_numpy()[row], first - at[row]))
                waiting += len(keys)
                if waiting >= CHUNK_WINDOWS:
                    yield flush(held)
                    held, waiting = [], 0
        if waiting:
            yield flush(held)
    return run


def _settle(buckets: int):
    names = [*RUNS, "keys", "checks", "ids", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches, names):
            if rows[0][0] < 0:
                out = [(-rows[0][0], *rows[0][1:5])]
            else:
                sizes = [len(x[1]) // 8 for x in rows]
                starts = np.cumsum([0, *sizes[:-1]])
                text = np.concatenate([np.frombuffer(x[8], np.int32) + s for x, s in zip(rows, starts, strict=True)])
                ids, row_keys = joined(rows, 7, np.int64)[text], joined(rows, 1, np.int64)[text]
                gone = later(joined(rows, 5, np.uint64), joined(rows, 6, np.uint32), ids)
                out = dealt_runs(row_keys[gone], joined(rows, 3, np.int32)[gone], buckets, 1)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), *[pa.binary()] * 4])], RUNS)
    return run


def _spans(size: int):
    """For each text of a bucket: the ranges of words that its windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches, RUNS):
            row_keys = np.repeat(joined(rows, 1, np.int64), joined(rows, 2, np.int32))
            first, end = joined(rows, 3, np.int32), joined(rows, 4, np.int32) + (size - 1)
            order = np.lexsort((first, row_keys))
            row_keys, first, end = row_keys[order], first[order], end[order]
            text = np.cumsum(np.concatenate([[0], row_keys[1:] != row_keys[:-1]])).astype(np.int64) << 32
            reach = np.maximum.accumulate(text + end)
            new = np.concatenate([[True], (text + first)[1:] > reach[:-1]])
            at = np.flatnonzero(new)
            past = reach[np.append(at[1:], len(order)) - 1] & 0xFFFF_FFFF
            row_keys, first = row_keys[at], first[at]
            own = np.flatnonzero(np.concatenate([[True], row_keys[1:] != row_keys[:-1]]))
            offsets = pa.array(np.append(own, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_keys[own]), pa.ListArray.from_arrays(offsets, pa.array(first)),
                 pa.ListArray.from_arrays(offsets, pa.array(past.astype(np.int32)))], ["row_key", "firsts", "pasts"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches):
        out = []
        for text, firsts, pasts in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "pasts")), strict=True):
            words = WORD.findall(text)
            kept, at = [], 0
            for a, b in zip(firsts or (), pasts or (), strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), " ".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(2)),
             pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def sketch_bits(n_bytes: int, max_cells: int) -> int:
    """log2 of the cells of a row: at least four times the words that so many bytes may hold, within bounds."""
    wanted = max(LEAST_CELLS, min(max_cells, 4 * n_bytes // WORD_BYTES))
    return min(max(wanted - 1, 1).bit_length(), max(max_cells, LEAST_CELLS).bit_length() - 1)


def remove_windows(docs: DataFrame, size: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, unchanged. A word is removed if it is in a window
    of ``size`` words whose sequence also starts in a row with a smaller doc_id; windows are judged on the
    texts as given. ``kept`` holds the other words, joined by one space. Repeats inside one document are no
    reason to remove. Rows that share a doc_id do not remove each other's words. A null id counts as greater than all
    others. A null, empty or blank text has no words and an empty ``kept``; shorter texts than ``size`` words stay
    whole, very long ones are read whole. Other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= size <= len(GRAM_FACTORS) // 2:
        raise ValueError(f"windows have 1 to {len(GRAM_FACTORS) // 2} words")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"row_key": F.xxhash64("doc_id", "text"), "rank": F.coalesce("doc_id", F.lit(int(NO_ID)))})
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = sketch_bits(n_bytes, max_cells)
    buckets = int(max(LEAST_BUCKETS, n_bytes // WORD_BYTES // BUCKET_WINDOWS))
    field = spark.sparkContext.broadcast(repeated_cells(docs, size, bits))
    entries = docs.select("row_key", "rank", "text").mapInArrow(_entries(size, bits, buckets, field), ENTRIES)
    runs = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _settle(buckets), "bucket long, row_keys binary, counts binary, firsts binary, pasts binary")
    spans = materialize(runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _spans(size), "row_key long, firsts array<int>, pasts array<int>"), "spans")
    return docs.join(spans, "row_key", "left").select("doc_id", "text", "firsts", "pasts").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept string")
