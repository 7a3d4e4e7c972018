"""Exact links among candidate sets, found block by block."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, mix
from tidemark.llm.components import connected_components, roots
from tidemark.session import materialize

SHORT_LIST = 16
LONG_LIST = 200_000
CHUNK_ROWS = 1 << 16
BLOCK_SETS = 1024
ANCHORS = 16
PENDING_PAIRS = 1 << 20
BITS_PER_ID = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (key, n, doc_id) of several batches at a time."""
    held, rows = [], 0
    for batch in in_batches(batches):
        held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "doc_id")]))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield np.concatenate(held, axis=1)
            held, rows = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def scan_lists(percent: int, boundary: int = 0, enough: int = 1):
    """Pairs in each list, which is sorted by size, with the number of keys that they were found by.

    Up to ``SHORT_LIST`` rows a list gives all its pairs. A longer one is cut where neighbouring sizes are too
    far apart, and all of a part are paired with its first, which connects all that could link; these pairs
    count as found by ``enough`` keys, as do those of sets of up to ``boundary`` elements. Pairs that a task has found
    by ``enough`` keys are given as a forest, enough to connect them; others that they connect are left out.
    """
    def pairs_of(rows: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.repeat(np.diff(np.append(begin, rows.shape[1])), np.diff(np.append(begin, rows.shape[1])))
        found = []

        def add(left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> None:
            found.append(np.stack([np.minimum(rows[2, left], rows[2, right]),
                                   np.maximum(rows[2, left], rows[2, right]), keys, rows[0, left]]))

        for step in range(1, SHORT_LIST):
            left, right = np.arange(rows.shape[1] - step), np.arange(step, rows.shape[1])
            ok = (rows[0, left] == rows[0, right]) & (100 * rows[1, left] >= percent * rows[1, right])
            ok &= (rows[2, left] != rows[2, right]) & (size[left] <= SHORT_LIST)
            if ok.any():
                add(left[ok], right[ok], np.where(rows[1, right[ok]] <= boundary, enough, 1))
        starts = np.ones(rows.shape[1], bool)
        starts[1:] = (rows[0, 1:] != rows[0, :-1]) | (100 * rows[1, :-1] < percent * rows[1, 1:])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        right = np.flatnonzero((size > SHORT_LIST) & (rows[2, first] != rows[2]))
        add(first[right], right, np.full(len(right), enough))
        pairs = np.concatenate(found, axis=1)
        pairs = pairs[:, np.lexsort((-pairs[2], pairs[1], pairs[0], pairs[3]))]
        once = np.ones(pairs.shape[1], bool)  # ids may have several rows in a list
        once[1:] = (np.diff(pairs[[0, 1, 3]], axis=1) != 0).any(axis=0)
        return pairs[:3, once]

    def emit(pairs: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(pairs, axis=1)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[:2], axis=1) != 0).any(axis=0)]))
        a, b, keys = pairs[0, begin], pairs[1, begin], np.add.reduceat(pairs[2], begin)
        sure = keys >= enough
        if sure.any():
            ids, root = roots(a[sure], b[sure])
            left, right = np.minimum(np.searchsorted(ids, [a, b]), len(ids) - 1)
            joined = (ids[left] == a) & (ids[right] == b) & (root[left] == root[right])
            edge = ids != root
            a, b, keys = (np.concatenate([x, y[~joined]]) for x, y in (
                (root[edge], a), (ids[edge], b), (np.full(int(edge.sum()), enough), keys)))
        return pa.RecordBatch.from_arrays([a, b, keys], ["a", "b", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, waiting = np.zeros((3, 0), np.int64), [], 0
        for rows in _chunks(batches):
            held = np.concatenate([held, rows], axis=1)
            whole = int(np.searchsorted(held[0], held[0, -1]))  # the last list may go on
            if whole:
                out.append(pairs_of(held[:, :whole]))
                held = held[:, whole:]
            elif held.shape[1] > 2 * LONG_LIST:  # one list of any length, in pieces that overlap
                out.append(pairs_of(held))
                held = held[:, -SHORT_LIST - 1:]
            else:
                continue
            waiting += out[-1].shape[1]
            if waiting > PENDING_PAIRS:
                yield emit(out)
                out, waiting = [], 0
        if held.shape[1]:
            out.append(pairs_of(held))
        if out and sum(x.shape[1] for x in out):
            yield emit(out)
    return run


def _mark(size: int):
    """One row for each word of a bit field that the ids of this task touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [np.zeros(0, np.int64)]
        for batch in in_batches(batches):
            at = mix(batch.column("id").to_numpy().view(np.uint64)) % np.uint64(size)
            words.append(np.unique(at.astype(np.int64)))
        at = np.unique(np.concatenate(words))
        begin = np.flatnonzero(np.diff(at >> 5, prepend=-1))
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[begin] >> 5), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), begin))], ["word", "bits"])
    return run


def bit_field(ids: DataFrame) -> np.ndarray:
    """A bit field with the bits of all values of the column ``id`` set; for skipping other rows.

    Its size follows the number of ids, from ``LEAST_BITS`` to ``MOST_BITS`` bits (128 MB); fuller ones skip fewer rows.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * max(ids.count(), 1) - 1).bit_length()))
    bits = np.zeros(size >> 5, np.uint32)
    found = ids.select("id").mapInArrow(_mark(size), "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return bits


def in_field(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (mix(ids.view(np.uint64)) % np.uint64(len(bits) << 5)).astype(np.int64)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Number of common elements of each set in ``rows`` with each of all sets.

    Elements that the same sets have count as one with a weight, so copies cost little.
    """
    count = len(sets)
    out = np.zeros((len(rows), count), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    many = np.diff(np.append(begin, len(flat)))
    begin, many = begin[many > 1], many[many > 1]
    if not len(begin):
        return out
    names = mix(np.arange(count, dtype=np.uint64) + np.uint64(977))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(names[owner], dtype=np.uint64)])
    _, one, weight = np.unique(sums[begin + many] - sums[begin], return_index=True, return_counts=True)
    begin, many = begin[one], many[one]
    place = np.full(count, -1)
    place[rows] = np.arange(len(rows))
    for size in np.unique(many[many <= 8]):
        at = np.flatnonzero(many == size)
        members = owner[begin[at, None] + np.arange(size)]
        for i, j in itertools.permutations(range(size), 2):
            left = place[members[:, i]]
            ok = left >= 0
            np.add.at(out, (left[ok], members[ok, j]), weight[at[ok]].astype(np.float32))
    wide = np.flatnonzero(many > 8)
    for at in np.array_split(wide, max(1, len(wide) // 2048 + 1)):
        if len(at):
            column = np.repeat(np.arange(len(at)), many[at])
            inside = np.arange(len(column)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            members = owner[np.repeat(begin[at], many[at]) + inside]
            have = np.zeros((count, len(at)), np.float32)
            have[members, column] = 1
            out += (have[rows] * weight[at].astype(np.float32)) @ have.T
    return out


def linked(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets: one of ``rows`` and any other."""
    common = overlaps(sets, rows).astype(np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    yes = 100 * common >= percent * (sizes[rows][:, None] + sizes[None, :] - common)
    yes[np.arange(len(rows)), rows] = False
    left, right = np.nonzero(yes)
    return rows[left], right


def _compare(percent: int, to_sets: Callable[[pa.Array], list[np.ndarray]]):
    """Links inside each block, as many as it takes to connect what is linked; a block's rows with ``own`` =
    false, if there are any, are compared with all, the others are not compared with each other."""
    def forest(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        ids, own, sets = (list(x) for x in zip(*held, strict=True))
        if len(held) == 2:
            common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            near = ids[0] != ids[1] and 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common)
            return [(min(ids), max(ids))] if near else []
        rows = np.arange(len(sets)) if all(own) else np.flatnonzero(~np.array(own))
        left, right = linked(sets, rows, percent)
        ids = np.array(ids, np.int64)
        left, right = ids[left], ids[right]
        if not len(left):
            return []
        ends, root = roots(left, right)
        return [(r, e) for e, r in zip(ends.tolist(), root.tolist(), strict=True) if e != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in in_batches(batches):
            keys = zip(batch.column("component").to_pylist(), batch.column("block").to_pylist(), strict=True)
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(),
                       to_sets(batch.column("set")), strict=True)
            found = []
            for key, row in zip(keys, rows, strict=True):
                if key != block:
                    found += forest(held)
                    block, held = key, []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
        if found := forest(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
    return run


def stored_sets(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]


def exact_links(sets: DataFrame, percent: int, to_sets: Callable = stored_sets) -> DataFrame:
    """Exact links, or enough of them to connect what is connected, among candidate sets.

    ``sets``: doc_id, set (hashes, or what ``to_sets`` turns into them), component (of candidates) and many
    (sets of that component). Components above
    ``BLOCK_SETS`` are cut into blocks. Blocks are compared inside, together with a few sets that every
    block gets, which joins blocks that are much alike. After that the sets outside the largest class that
    was found are compared with every block, in chunks; so no pair with different classes is left out, a
    task holds two blocks at most, and large groups of near copies are not expanded into pairs.
    """
    schema = "a long, b long"
    blocks = F.greatest(F.lit(1), F.ceil(F.col("many") / BLOCK_SETS)).cast("int")
    placed = sets.withColumn("blocks", blocks).withColumn(
        "home", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))

    def compare(rows: DataFrame) -> DataFrame:
        rows = rows.select("component", "block", "doc_id", "own", "set")
        return rows.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(
            _compare(percent, to_sets), schema)

    anchor = (F.col("blocks") > 1) & (
        F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.col("many") / ANCHORS).cast("long")) == 0)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = placed.withColumn("block", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1))
                                                 .otherwise(F.array("home")))).withColumn("own", F.lit(True))
    links = materialize(compare(first), "links")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return links
    labels = connected_components(links).withColumnRenamed("component", "label").withColumnRenamed("id", "doc_id")
    large = large.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    main = large.groupBy("component", "label").count().groupBy("component").agg(
        F.max_by("label", F.struct("count", "label")).alias("main"))
    large = large.join(F.broadcast(main) if main.count() < 100_000 else main, "component")
    rest = large.where("label <> main")
    chunks = rest.select("component", F.col("home").alias("chunk")).distinct()
    rest = rest.withColumn("chunk", F.col("home")).withColumn("block", everywhere).withColumn("own", F.lit(False))
    homes = large.join(chunks, "component").withColumn("block", F.col("home")).withColumn("own", F.lit(True))
    columns = ["component", (F.col("block") * F.col("blocks") + F.col("chunk")).alias("block"), "doc_id", "own", "set"]
    return links.unionByName(compare(rest.select(columns).unionByName(homes.select(columns))))
