import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tidemark.llm import arrays, byte_bpe
from tidemark.llm.registry import QUERIES, load

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
HARD = [
    "", " ", "\n\n  x", "it's we'll 'S", "naïve café 東京 🙂🙂", "a" * 3000, " \x00\x1f\x85 z", "<unk><s>▁ ▁▁",
    "<|endoftext|>", "\t\t1234567890  .,;!?", "é‍👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_same_ids_as_the_public_library(plain):
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    for text, ids in zip(HARD, bpe.encode(HARD), strict=True):
        assert ids == plain.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_every_entry_encodes_to_itself():
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    for entry, rank in list(byte_bpe.read_ranks(PATH).items())[::7]:
        mapped = entry.decode("latin-1").translate(bpe.table)
        assert bpe.decode(bpe.model.encode(mapped)) == entry
        assert bpe.entries[rank] == entry


def test_rows(spark):
    rows = [(1, None, "x"), (None, "ab", "y"), (2, "", None), (2, "", None), (3, "a b " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    tokens = byte_bpe.encode(docs, PATH, PATTERN)
    back = sorted(((r.doc_id or -1), bytes(r.decoded), len(r.token_ids)) for r in
                  byte_bpe.decode(tokens, PATH, PATTERN).collect())
    assert [b[:2] for b in back] == [(-1, b"ab"), (1, b""), (2, b""), (2, b""), (3, b"a b " * 50_000)]
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_query(spark, sf_dir, plain):
    load()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in QUERIES["op4_byte_bpe"](spark, sf_dir).collect():
        ids = plain.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_columns_without_a_list_for_each_text(plain):
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    ids = bpe.encoded(pa.array([*HARD, None])[2:])
    assert ids.to_pylist() == [plain.encode_ordinary(t) for t in [*HARD[2:], ""]]
    lists = pa.array([[1], None, ids[1].as_py(), [], [2, 3]], pa.list_(pa.int32()))
    for part in (lists, lists[1:], lists[3:4], lists[:0]):
        assert bpe.decoded(part).to_pylist() == [bpe.decode(x or []) for x in part.to_pylist()]


def test_a_finished_task_gives_its_free_memory_back(monkeypatch):
    assert arrays._trim()(0) in (0, 1)
    called = []
    monkeypatch.setattr(arrays, "_trim", lambda: called.append)
    batches = [pa.RecordBatch.from_pydict({"x": x}) for x in ([1, 2], [], [3])]
    given = arrays.in_batches(iter(batches))
    assert next(given).num_rows == 2 and not called
    assert [b.num_rows for b in given] == [1] and called == [0]


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    bpe = byte_bpe.ByteBpe(PATH, PATTERN)
    texts = ["one twoo thrree", "", "twoo \u00e9\u00df 12345678", "one"]
    want = bpe.encode(texts)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 1)
    assert [bpe.encode([t])[0] for t in texts] == want
