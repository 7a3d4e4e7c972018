"""Exact removal of repeated byte strings, by blocks of suffixes and a difference cover.

Two equal strings of L bytes start at positions i and j that may differ by any shift. A difference cover D
modulo v holds, for every shift, two residues that differ by it: some d < v puts both i + d and j + d on
cover positions. So only suffixes at cover positions (|D| in v of all) are compared at first: they are dealt
to buckets by their leading L - v + 1 bytes, and one bucket is sorted at a time, which gives each cover suffix
the class (rank) of that prefix. Suffixes whose class has one member cannot be part of a repeat. For the
others the undecided bytes, v - 1 before and up to L from the cover position, go to their class, where the
strings that start up to v - 1 bytes before are compared at equal distance from the cover suffix. Classes
of any size are bounded in memory: strings of very large ones are dealt to buckets by their own L bytes.

Strings are compared by 64-bit hashes. Equal texts are one text, known by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import BASE, BASE_INVERSE, BYTE_VALUES, _powers, in_batches, mix, pieces, utf8
from tidemark.llm.set_links import bit_field, in_field
from tidemark.session import materialize

ORDER = 17  # v = 17 * 17 + 17 + 1 = 307 with 18 residues
LARGE_CLASS = 4096
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 256
CHUNK_ROWS = 2000
NEAR = 8


def difference_cover(order: int) -> tuple[int, np.ndarray]:
    """(v, residues) with v = order ** 2 + order + 1 and order + 1 residues, for a prime ``order``.

    In the field of order ** 3 elements, the powers of a suitable element that lie in a plane have exponents
    whose differences give every residue once (Singer's construction).
    """
    v = order * order + order + 1
    for a in range(order):
        for b in range(order):
            for c in range(1, order):
                x, plane = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        plane.append(i)
                    top = x[2]  # times the element, whose cube is a * square + b * itself + c
                    x = (top * c % order, (x[0] + top * b) % order, (x[1] + top * a) % order)
                if len(plane) == order + 1 and len({(p - q) % v for p in plane for q in plane}) == v:
                    return v, np.array(plane)
    raise ValueError("order must be prime")


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _powers(BASE, len(data)), out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return mix((sums[starts + length] - sums[starts]) * _powers(BASE_INVERSE, len(sums))[starts] + np.uint64(length))


def cover_positions(offsets: np.ndarray, length: int, v: int, residues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and position in its text of every cover suffix of at least ``length`` bytes."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    periods = -(-sizes // v)
    row = np.repeat(np.arange(len(sizes)), periods * len(residues))
    number = np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods * len(residues)) * len(residues)
    position = number // len(residues) * v + residues[number % len(residues)]
    ok = position < sizes[row]
    return row[ok], position[ok]


def _deal(keys: np.ndarray, texts: np.ndarray, positions: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket with its keys, texts and positions as bytes. A key that is repeated here already is
    sent once; its other places are sent as settled, to a bucket with a negative number."""
    order = np.lexsort((positions, texts, keys))
    keys, texts, positions = keys[order], texts[order], positions[order]
    distinct = np.ones(len(keys), bool)
    distinct[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]) | (positions[1:] != positions[:-1])
    keys, texts, positions = keys[distinct], texts[distinct], positions[distinct]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    again = ~first
    again[:-1] |= ~first[1:]
    bucket = (keys >> np.uint64(32)).astype(np.int64) % buckets
    out = []
    for kind, chosen in ((1, np.flatnonzero(first)), (-1, np.flatnonzero(again))):
        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
        own = bucket[chosen]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(own)], strict=False):
            at = chosen[a:b]
            out.append((kind * int(own[a] + 1), keys[at].tobytes(), texts[at].tobytes(),
                        positions[at].astype(np.int32).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.binary(), pa.binary()])],
        ["bucket", "keys", "texts", "positions"])


DEALT = "bucket long, keys binary, texts binary, positions binary"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text_key, position) of suffixes whose key has several, one bucket at a time."""
    def arrays(rows: list[tuple]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(x[i] for x in rows), t) for i, t in ((0, np.uint64), (1, np.int64), (2, np.int32))]

    def give(keys, texts, positions):
        return pa.RecordBatch.from_arrays(
            [keys.view(np.int64), texts, positions], ["key", "text_key", "position"])

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        keys, texts, positions = arrays(rows)
        order = np.lexsort((positions, texts, keys))
        keys, texts, positions = keys[order], texts[order], positions[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]) | (positions[1:] != positions[:-1])
        keys, texts, positions = keys[new], texts[new], positions[new]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        again[:-1] |= again[1:].copy()
        return give(keys[again], texts[again], positions[again])

    last, held = None, []
    for batch in in_batches(batches):
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "texts", "positions")),
                                strict=True):
            if bucket < 0:
                yield give(*arrays([row]))
                continue
            if bucket != last and held:
                yield sort(held)
                held = []
            last = bucket
            held.append(row)
    if held:
        yield sort(held)


def repeated(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _repeated, "key long, text_key long, position int")


def _cover(length: int, v: int, residues: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "text", 1 << 22):
                data, offsets = utf8(piece.column("text"))
                row, position = cover_positions(offsets, length, v, residues)
                if len(row):
                    keys = string_hashes(prefix_sums(data), offsets[row] + position, length)
                    yield _deal(keys, piece.column("text_key").to_numpy()[row], position, buckets)
    return run


def _contexts(length: int, v: int, large: bool, buckets: int):
    """For the marked positions of each text: the bytes around those of small classes, or all strings of
    ``length`` bytes that start up to v - 1 before those of large classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "text", 1 << 20):
                data, offsets = utf8(piece.column("text"))
                marks = piece.column("marks")
                flat, at = marks.flatten(), marks.offsets.to_numpy()
                position = flat.field("position").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(piece.num_rows), np.diff(at))
                chosen = flat.field("large").to_numpy(zero_copy_only=False) == large
                row, position = row[chosen], position[chosen]
                texts = piece.column("text_key").to_numpy()[row]
                if not len(row):
                    continue
                if large:
                    sizes = np.diff(offsets)[row]
                    from_ = np.maximum(position - v + 1, 0)
                    to = np.maximum(np.minimum(position, sizes - length) + 1, from_)
                    count = to - from_
                    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - from_, count)
                    rows = np.repeat(row, count)
                    keys = string_hashes(prefix_sums(data), offsets[rows] + starts, length)
                    yield _deal(keys, np.repeat(texts, count), starts, buckets)
                    continue
                keys = flat.field("key").to_numpy()[chosen]
                left = np.minimum(position, v - 1)
                begin = offsets[row] + position - left
                end = np.minimum(offsets[row] + position + length, offsets[row + 1])
                for a in range(0, len(row), CHUNK_ROWS):
                    b = slice(a, a + CHUNK_ROWS)
                    raw = [data[x:y].tobytes() for x, y in zip(begin[b], end[b], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [keys[b], texts[b], position[b].astype(np.int32), left[b].astype(np.int32), pa.array(raw, pa.binary())],
                        ["key", "text_key", "position", "left", "bytes"])
    return run


def _compare(length: int, v: int):
    """Ranges of starts of repeated strings, from contexts sorted by class; whole classes at a time."""
    width = v - 1 + length
    factors = _powers(BASE, width).copy()

    def starts_in(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, text = table["key"].to_numpy(), table["text_key"].to_numpy()
        position, left = table["position"].to_numpy(), table["left"].to_numpy()
        order = np.lexsort((position, text, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1]) | (
            position[order][1:] != position[order][:-1])
        order = order[new]
        column = table["bytes"].combine_chunks().take(pa.array(order))
        key, text, position, left = key[order], text[order], position[order].astype(np.int64), left[order]
        data, offsets = utf8(column)
        size = np.diff(offsets)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(begin, len(key)))
        found = []
        cuts = begin[np.concatenate([[True], np.diff(begin // CHUNK_ROWS) > 0])]
        for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
            rows = np.arange(a, b)
            matrix = np.zeros((len(rows), width), np.uint64)
            shift = v - 1 - left[rows]
            inner = np.arange(offsets[a], offsets[b]) - np.repeat(offsets[a:b], size[a:b])
            matrix[np.repeat(np.arange(len(rows)), size[a:b]), inner + np.repeat(shift, size[a:b])] = \
                BYTE_VALUES[data[offsets[a] : offsets[b]]]
            sums = np.zeros((len(rows), width + 1), np.uint64)
            np.cumsum(matrix * factors, axis=1, out=sums[:, 1:])
            windows = sums[:, length:] - sums[:, : v]  # one column for each start, v - 1 before the mark up to it
            start = np.arange(v)
            valid = (start >= shift[:, None]) & (start + length <= (shift + size[a:b])[:, None])
            windows = np.where(valid, windows, mix(np.arange(windows.size, dtype=np.uint64) + np.uint64(1)).reshape(windows.shape))
            own = key[a:b]
            again = np.zeros(windows.shape, bool)
            group = many[(begin >= a) & (begin < b)]
            for step in range(1, min(NEAR, int(group.max()))):
                same = (windows[step:] == windows[:-step]) & (own[step:] == own[:-step])[:, None]
                again[step:] |= same
                again[:-step] |= same
            wide = np.repeat(group > NEAR, group)
            if wide.any():
                at = np.flatnonzero(wide)
                scrambled = windows[at] ^ mix(own[at].view(np.uint64))[:, None]
                place = np.argsort(scrambled, axis=0)
                ordered = np.take_along_axis(scrambled, place, axis=0)
                equal = ordered[1:] == ordered[:-1]
                both = np.zeros(scrambled.shape, bool)
                both[1:] |= equal
                both[:-1] |= equal
                back = np.zeros(scrambled.shape, bool)
                np.put_along_axis(back, place, both, axis=0)
                again[at] |= back
            again &= valid
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r0, c0 = np.nonzero(edge == 1)
            r1, c1 = np.nonzero(edge == -1)
            base = position[rows] - (v - 1)
            found.append((text[rows][r0], base[r0] + c0, base[r1] + c1))
        return pa.RecordBatch.from_arrays([np.concatenate([x[i] for x in found]) for i in range(3)],
                                          ["text_key", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in in_batches(batches):
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[-1].column("key")[-1].as_py() != key[0]):
                done = [*held, batch.slice(0, cut)] if cut else held
                yield starts_in(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield starts_in(pa.Table.from_batches(held))
    return run


def merge(first: np.ndarray, past: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs: byte ranges [first, past - 1 + length), overlapping and touching ones as one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], past[order] - 1 + length
    reach = np.maximum.accumulate(end)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                out = []
                for text, runs, whole in zip(*(piece.column(c).to_pylist() for c in ("text", "runs", "whole")), strict=True):
                    data = text.encode()
                    if whole:
                        spans = [(0, len(data))]
                    elif runs:
                        spans = list(zip(*(x.tolist() for x in merge(
                            np.array([r["first"] for r in runs]), np.array([r["past"] for r in runs]), length)), strict=True))
                    else:
                        spans = []
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(data[at:a])
                        at = b
                    out.append((len(data), sum(b - a for a, b in spans), len(spans), b"".join([*kept, data[at:]])))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)),
                     pa.array([x[3] for x in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def _only(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(in_field(piece.column("text_key").to_numpy(), wanted))],
                    [*piece.schema.names, "maybe"])
    return run


def remove_repeats(docs: DataFrame, length: int = 400, order: int = ORDER, large: int = LARGE_CLASS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs`` (doc_id, text).

    A byte of a text in UTF-8 is removed if it is in a string of ``length`` bytes that also starts anywhere
    else in the table, in the same text too; all on the texts as given. ``kept`` holds the remaining bytes,
    ``n_spans`` counts the maximal removed runs. A null text counts as empty; texts shorter than ``length``
    stay whole. Rows that repeat repeat each other's strings, whatever their ids; null ids are passed on;
    other columns are ignored; an empty table gives no rows. ``length`` must exceed order ** 2 + order.
    """
    spark = docs.sparkSession
    v, residues = difference_cover(order)
    prefix = length - v + 1
    if prefix < 1:
        raise ValueError("length is too small for the cover")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    texts = materialize(docs.groupBy("text_key").agg(
        F.count("*").alias("times"), F.max(F.octet_length("text")).cast("long").alias("size")), "texts")
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    long = docs.where(F.octet_length("text") >= length).select("text_key", "text")

    found = materialize(repeated(long.mapInArrow(_cover(prefix, v, residues, buckets), DEALT)), "classes")
    sizes = found.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > large)
    found = found.join(sizes, "key", "left").withColumn("large", F.col("members").isNotNull())
    marks = materialize(found.groupBy("text_key").agg(
        F.collect_set(F.struct("position", "key", "large")).alias("marks")), "marks")

    def matching(ids: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(bit_field(ids.select(F.col("text_key").alias("id"))))
        return docs.select("doc_id", "text_key", "text").mapInArrow(
            _only(bits), "doc_id long, text_key long, text string, maybe boolean")

    marked = materialize(matching(marks).where("maybe").join(marks, "text_key").select("text_key", "text", "marks"), "marked")
    contexts = marked.mapInArrow(
        _contexts(length, v, False, buckets), "key long, text_key long, position int, left int, bytes binary")
    small = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare(length, v), "text_key long, first long, past long")
    strings = repeated(marked.mapInArrow(_contexts(length, v, True, buckets), DEALT)).select(
        "text_key", F.col("position").cast("long").alias("first"), (F.col("position") + 1).cast("long").alias("past"))
    runs = small.unionByName(strings).distinct().groupBy("text_key").agg(
        F.collect_list(F.struct("first", "past")).alias("runs"))
    whole = texts.where((F.col("times") > 1) & (F.col("size") >= length)).select("text_key", F.lit(True).alias("whole"))
    removed = materialize(runs.join(whole, "text_key", "full"), "removed")
    tried = matching(removed)
    hit = tried.where("maybe").join(removed, "text_key", "left")
    cut = hit.select("doc_id", "text", "runs", "whole").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    return cut.unionByName(tried.where("not maybe").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.col("text").cast("binary").alias("kept")))
