"""Vectorised helpers that run inside tasks, on the bytes of whole Arrow string columns.

Hashes are 64-bit: a word is a polynomial over its bytes, mixed afterwards, so equal words agree in every
task and Python hash seeds play no part.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240607)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUES_LOWER = BYTE_VALUES.copy()
BYTE_VALUES_LOWER[65:91] = BYTE_VALUES[97:123]
GRAM_FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)[:n]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 20))
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array and the ``rows + 1`` offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(large), b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` with about ``max_bytes`` of text each (one row at least), so that the
    temporary arrays of a task stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and the ``rows + 1`` offsets into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~WHITE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[bounds - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of each byte span; with ``lower``, A-Z count as a-z."""
    return hashes_between(byte_sums(data, lower), starts, ends)


def byte_sums(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Running sums from which the hash of any span can be taken."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_VALUES_LOWER if lower else BYTE_VALUES)[data] * _powers(BASE, len(data)), out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = sums[ends] - sums[starts]
    out *= _powers(BASE_INVERSE, len(sums))[starts]
    out += (ends - starts).astype(np.uint64)
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries of ``words``; a shorter sequence gives one hash of its own."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out += words[i : len(words) - size + 1 + i] * GRAM_FACTORS[i]
    return mix(out)


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column and the ``rows + 1`` offsets into them."""
    data, offsets = utf8(column)
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends, lower), rows


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingles of each text, as uint64."""
    words, rows = word_hashes(column)
    return [np.unique(gram_hashes(words[a:b], n)) for a, b in zip(rows[:-1], rows[1:], strict=True)]


def ragged(lists: list[np.ndarray], kind: pa.DataType | None = None) -> pa.ListArray:
    """Arrow list column of numpy arrays."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind or pa.int64()))


def pack_texts(column: pa.Array) -> pa.Array:
    """Each text compressed, after its length in eight bytes, for exchanges that move texts; null stays null."""
    data, offsets = utf8(column)
    codec = pa.Codec("zstd", compression_level=1)
    held = [None if null else int(b - a).to_bytes(8, "little") + codec.compress(data[a:b], asbytes=True)
            for a, b, null in zip(offsets[:-1], offsets[1:], column.is_null().to_pylist(), strict=True)]
    return pa.array(held, pa.binary())


def unpack_texts(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    held = [x if x is None else codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in column.to_pylist()]
    return pa.array(held, pa.binary()).view(pa.string())


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal rank, one rank after the other, compressed: ranks that are all zero take no space."""
    return pa.Codec("zstd", compression_level=1).compress(
        np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T), asbytes=True)


def unpack_numbers(data: bytes, count: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    ranks = pa.Codec("zstd").decompress(data, count * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(ranks, np.uint8).reshape(width, count).T).view(kind).ravel()


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending uint64 numbers, as the steps between them."""
    return pack_numbers(np.diff(values, prepend=np.uint64(0)))


def unpack_ascending(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, count, np.uint64), dtype=np.uint64)


@functools.cache
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows; gives memory of finished ones back, as workers share their executor's, and after the
    last one all that is free: a worker that waits for its next task would keep it."""
    for batch in batches:
        if batch.num_rows:
            yield batch
        del batch
        pa.default_memory_pool().release_unused()
    _trim()(0)


def by_bucket(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Lists of the rows of one bucket, which come one after the other; rows of negative buckets come alone."""
    last, held = None, []
    for batch in in_batches(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] < 0:
                yield [row]
                continue
            if row[0] != last and held:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


def joined(rows: list[tuple], i: int, kind) -> np.ndarray:
    """The arrays that column ``i`` of the rows holds as bytes, as one."""
    return np.frombuffer(b"".join(x[i] for x in rows), kind)
