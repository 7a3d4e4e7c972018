import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """Every window of every row against all rows, by plain dictionaries."""
    ids = [float("inf") if d is None else d for d, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - size + 1):
            g = tuple(w[i:i + size])
            first[g] = min(first.get(g, d), d)
    out = []
    for (doc_id, _), d, w in zip(rows, ids, words):
        gone = {i + k for i in range(len(w) - size + 1) if first[tuple(w[i:i + size])] < d for k in range(size)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, size=13, parts=3, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in sd.remove_windows(docs, size, **more).collect()), key=repr)


PASSAGE = "a passage that many documents share word for word and that has enough words to count here"


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = np.array(["wo", "rd", "é", "x", "Wo"])
    rows = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in rng.permutation(120)]
    rows += [(200 + i, f"own{i} {PASSAGE} tail{i} {PASSAGE}") for i in range(30)]
    rows += [(300 + i, PASSAGE) for i in range(30)]
    for size in (3, 13):
        assert run(spark, rows, size) == brute(rows, size)


def test_a_full_sketch_changes_nothing(spark):
    rows = [(i, " ".join(f"w{(i * 977 + k * k) % 8209}" for k in range(5000))) for i in range(30)]
    assert sd.sketch_bits(10**9, 1) == 16  # 65,536 cells a row for 150,000 windows
    assert run(spark, rows, 4, max_cells=1) == run(spark, rows, 4) == brute(rows, 4)


def test_chunks_and_layout_do_not_matter(spark, monkeypatch):
    rows = [(i, f"{PASSAGE} {i % 5} " + " ".join(f"t{(i + k) % 9}" for k in range(30))) for i in range(60)]
    whole = run(spark, rows, 5)
    assert run(spark, rows, 5, parts=20) == whole == brute(rows, 5)


def test_small_chunks():
    def one(chunk):
        sd.CHUNK_WINDOWS, before = chunk, sd.CHUNK_WINDOWS
        try:
            texts = [f"{PASSAGE} {i}" for i in range(20)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(range(20), pa.int64()), pa.array(range(20), pa.int64()), pa.array(texts)], ["row_key", "rank", "text"])

            class Field:
                value = np.full(sd.ROWS << 13, 255, np.uint8)

            return [b.num_rows for b in sd._entries(13, 16, 4, Field)(iter([batch.slice(a, 5) for a in range(0, 20, 5)]))]
        finally:
            sd.CHUNK_WINDOWS = before
    assert len(one(1)) > 1 and len(one(1 << 20)) == 1


def test_defined_cases(spark):
    long = " ".join(f"word{i}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "too short"), (5, "too short"), (7, long), (8, f"new {long}"),
            (None, PASSAGE), (None, f"x {PASSAGE}"), (9, PASSAGE), (9, PASSAGE), (9, f"{PASSAGE} more")]
    assert run(spark, rows) == brute(rows, 13)
    found = {r[0]: r for r in run(spark, rows)}
    assert found[1][1:] == found[3][1:] == (0, 0, "") and found[5][2] == 0
    assert found[8] == (8, 100_001, 100_000, "new")


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    names = ["doc_id", "text", "row_key", "rank", "firsts", "bucket"]
    docs = spark.createDataFrame([(1, PASSAGE, "a", "b", "c", "d"), (2, PASSAGE, "a", "b", "c", "d")], names)
    assert {r.doc_id: r.n_removed for r in sd.remove_windows(docs).collect()} == {1: 0, 2: 17}
    with pytest.raises(ValueError):
        sd.remove_windows(docs, 0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**18 - 1), min_size=1, max_size=200, unique=True))
def test_gaps_round_trip(cells):
    cells = np.array(sorted(cells), np.uint32)
    block, gaps = sd.packed(cells)
    back = [(int(b) << sd.BLOCK_BITS) + sd.unpacked(g) for b, g in zip(block, gaps.to_pylist())]
    assert np.concatenate(back).tolist() == cells.tolist()
