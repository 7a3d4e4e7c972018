"""Byte-level BPE by a sentencepiece model that is serialised straight from a vocabulary of ranks.

Every byte is written as one printable character, so a vocabulary entry is a string of such characters.
As sentencepiece merges the neighbouring pair whose union has the highest score, pieces scored by their
negative rank are merged in the order of the ranks. The model has no prefix, no white-space escapes and an
identity normaliser, so nothing but the merges changes its input.
"""

from __future__ import annotations

import base64
import functools
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, pieces

CACHE_ENTRIES = 1 << 16


def byte_characters() -> list[str]:
    """A character for each byte: itself where it is printable and no space, else the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece model whose piece ids are the ranks; the unknown piece comes after them.

    Field numbers and enum values below are those of the public sentencepiece model format.
    """
    characters = byte_characters()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    out = []
    for rank, entry in enumerate(ordered):
        piece = "".join(characters[b] for b in entry).encode()
        out.append(_bytes_field(1, _bytes_field(1, piece) + b"\x15" + struct.pack("<f", -float(rank))))
    unknown = len(ordered)
    out.append(_bytes_field(1, _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2)))
    trainer = _int_field(3, 2) + _int_field(4, unknown + 1) + _int_field(40, unknown)
    trainer += b"".join(_int_field(n, -1) for n in (41, 42, 43))  # no begin, end and padding pieces
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.ranks = ranks
        self.entries = sorted(ranks, key=ranks.__getitem__)
        self.entry_column = pa.array(self.entries, pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.table = {i: c for i, c in enumerate(byte_characters())}
        self.cache: dict[str, bytes] = {}

    def learn(self, pretokens: set[str]) -> None:
        """Encode pre-tokens that are not in the cache, to 32-bit ids; one that is an entry itself is that entry."""
        new = [p for p in pretokens if p not in self.cache]
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in new]
        for pretoken, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1) if new else (), strict=True):
            whole = self.ranks.get(pretoken.encode())
            self.cache[pretoken] = array("i", ids if whole is None else [whole]).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers, one after the other."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        split = [self.pattern.findall(text) for text in texts]
        self.learn(set(chain.from_iterable(split)))
        return [b"".join(map(self.cache.__getitem__, pretokens)) for pretokens in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def encoded(self, column: pa.Array) -> pa.ListArray:
        """Ids of a string column; null counts as empty."""
        packed = self.packed(pc.fill_null(column, "").to_pylist())
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(x) >> 2 for x in packed], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids; a null list gives none."""
        ends = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=ends[1:])
        entries = self.entry_column.take(lists.flatten())
        _, at, data = entries.buffers()
        at = np.frombuffer(at, np.int64)[entries.offset :][ends] if len(entries) else ends
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lists), [None, pa.py_buffer(at.tobytes()), data or pa.py_buffer(b"")]).cast(pa.binary())


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """Once per worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, token_ids) of every row of ``docs`` (doc_id, text); a null or empty text has no tokens.

    Rows that repeat and null ids are kept as they are; other columns are dropped. ``path`` is a file of
    ranks that every executor can open, ``pattern`` finds the pre-tokens, which are encoded separately.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in in_batches(batches):
            for piece in pieces(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), bpe.encoded(piece.column("text"))], ["doc_id", "token_ids"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` (doc_id, token_ids) with the decoded bytes in ``decoded``; null lists give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in in_batches(batches):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("token_ids")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, bpe.decoded(lists)], ["doc_id", "token_ids", "decoded"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decodes) of every row of ``docs``: ``decodes`` tells whether the decoded
    bytes are those of the text (null: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in in_batches(batches):
            for piece in pieces(batch, "text", 1 << 19):
                ids = bpe.encoded(piece.column("text"))
                same = pc.equal(bpe.decoded(ids), pc.fill_null(piece.column("text"), "").cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids, same],
                    ["doc_id", "n_tokens", "token_ids", "decodes"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decodes boolean")
