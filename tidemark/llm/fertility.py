"""Quality rules with tokeniser fertility.

Public vocabularies measure every text: characters per token, share of tokens that stand for less than a
character (byte fallback) and entropy of the tokens. What is usual differs between languages and with
length, so bands of acceptance are taken from all distinct texts of a language (or script) and length class, or
of wider groups where those are few; a text outside a band of any vocabulary is rejected. A text is measured as its words, each with one space before it,
so a word is tokenised once per batch.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, pieces, span_hashes, utf8, word_spans
from tidemark.llm.byte_bpe import read_ranks
from tidemark.session import materialize

CACHE_WORDS = 150_000
FENCE = 3.0
LEAST_TEXTS = 20
LEAST_SPREAD = {"chars_per_token": 0.25, "fallback_share": 0.02, "entropy": 0.02}
MEASURES = list(LEAST_SPREAD)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCRIPTS = ["latin", "cyrillic", "greek", "arabic", "hebrew", "indic", "kana", "han", "hangul", "other"]


@dataclass(frozen=True)
class Vocabulary:
    """A public vocabulary: a file of ranks with its pre-token pattern, or a sentencepiece model."""

    name: str
    path: str
    pattern: str | None = None


class Words:
    """Token ids of words by one vocabulary; remembers words up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.pattern:
            ranks = read_ranks(vocabulary.path)
            coder = tiktoken.Encoding(
                vocabulary.name, pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [coder.encode_ordinary(" " + w) for w in words]
            part = [not _whole(x) for x in sorted(ranks, key=ranks.__getitem__)]
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary.path)
            self.encode = lambda words: model.encode(words, out_type=int, num_threads=1)
            part = [model.is_byte(i) or model.is_unknown(i) for i in range(model.vocab_size())]
        self.part = np.array(part)
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and the number of each word's."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, (array("i", x).tobytes() for x in (self.encode(new) if new else ())), strict=True))
        packed = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(packed), np.int32), np.fromiter(map(len, packed), np.int64, len(packed)) >> 2


def _whole(entry: bytes) -> bool:
    try:
        entry.decode()
        return True
    except UnicodeDecodeError:
        return False


@functools.lru_cache(maxsize=4)
def words_of(vocabulary: Vocabulary) -> Words:
    return Words(vocabulary)


def entropy(owner: np.ndarray, tokens: np.ndarray, rows: int) -> np.ndarray:
    """Entropy in bits of each row's tokens over the highest that so many tokens can have; 1 for a single token."""
    pairs, times = np.unique(owner.astype(np.int64) << 32 | tokens, return_counts=True)
    row = pairs >> 32
    total = np.bincount(row, weights=times, minlength=rows)
    share = times / total[row]
    bits = np.bincount(row, weights=-share * np.log2(share), minlength=rows)
    return np.where(total > 1, bits / np.log2(np.maximum(total, 2)), 1.0)


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                bounds: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the plain rules for each row."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(owner, weights=lead[ends] - lead[starts], minlength=rows)

    cuts = np.flatnonzero(data == 10)
    line_rows = np.concatenate([np.arange(rows), np.searchsorted(offsets, cuts, side="right") - 1])
    line_starts = np.concatenate([offsets[:-1], cuts + 1])
    order = np.lexsort((line_starts, line_rows))
    line_starts, line_rows = line_starts[order], line_rows[order]
    line_ends = np.append(line_starts[1:] - 1, offsets[-1])
    last = np.append(line_rows[1:] != line_rows[:-1], True)
    line_ends[last] = offsets[line_rows[last] + 1]
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = span_hashes(data, line_starts[has_word], line_ends[has_word], lower=False)
    line_rows = line_rows[has_word]
    order = np.lexsort((lines, line_rows))
    equal = (lines[order][1:] == lines[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])
    dup_lines = np.bincount(line_rows[order][1:][equal], minlength=rows)

    window = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + \
        hashes[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(hashes) > 2 else np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:-2] == owner[2:]) if len(hashes) > 2 else np.zeros(0, np.int64)
    order = np.lexsort((window[at], owner[at]))
    w, o = window[at][order], owner[at][order]
    equal = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(w), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    inside = np.zeros(len(hashes), bool)
    for i in range(3):
        inside[at[order[twice]] + i] = True
    return {
        "n_words": np.diff(bounds), "word_chars": word_chars, "n_symbols": total(SYMBOLS[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner, weights=inside, minlength=rows),
    }


def main_script(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Script of most letters of each row, told by the lead bytes of UTF-8."""
    table = np.full(256, len(SCRIPTS) - 1, np.int8)
    table[list(range(65, 91)) + list(range(97, 123)) + list(range(0xC3, 0xCA))] = 0
    table[0xD0:0xD5], table[0xCD:0xD0], table[0xD8:0xDD], table[0xD6:0xD8] = 1, 2, 3, 4
    table[0xE0], table[0xE3], table[0xE4:0xEA], table[0xEA:0xEE] = 5, 6, 7, 8
    letter = (data >= 0xC3) | ((data >= 65) & (data < 91)) | ((data >= 97) & (data < 123))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[letter]
    counts = np.bincount(owner * len(SCRIPTS) + table[data[letter]], minlength=(len(offsets) - 1) * len(SCRIPTS))
    return [SCRIPTS[i] for i in counts.reshape(-1, len(SCRIPTS)).argmax(axis=1)]


def _measure(vocabularies: tuple[Vocabulary, ...]):
    names = [f"{v.name}_{m}" for v in vocabularies for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                data, offsets = utf8(piece.column("text"))
                rows = len(offsets) - 1
                starts, ends, bounds = word_spans(data, offsets)
                hashes = span_hashes(data, starts, ends, lower=False)
                owner = np.repeat(np.arange(rows), np.diff(bounds))
                out = base_counts(data, offsets, starts, ends, bounds, hashes)
                _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
                raw = data.tobytes()
                words = [raw[starts[i] : ends[i]].decode() for i in at]
                n_words = np.maximum(out["n_words"], 1)
                for v in vocabularies:
                    coder = words_of(v)
                    flat, size = coder.ids(words)
                    begin = np.cumsum(size) - size
                    per_word = size[which]
                    token_at = np.repeat(begin[which] - (np.cumsum(per_word) - per_word), per_word) + np.arange(
                        per_word.sum())
                    tokens, token_rows = flat[token_at], np.repeat(owner, per_word)
                    many = np.maximum(np.bincount(token_rows, minlength=rows), 1)
                    out[f"{v.name}_chars_per_token"] = (out["word_chars"] + n_words - 1) / many
                    out[f"{v.name}_fallback_share"] = np.bincount(
                        token_rows, weights=coder.part[tokens], minlength=rows) / many
                    out[f"{v.name}_entropy"] = entropy(token_rows, tokens, rows)
                counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pc.fill_null(piece.column("lang"), ""),
                     pa.array(main_script(data, offsets)), piece.column("text_key")]
                    + [pa.array(out[c].astype(np.int64)) for c in counts] + [pa.array(out[c]) for c in names],
                    ["doc_id", "lang", "script", "text_key", *counts, *names])

    schema = ("doc_id long, lang string, script string, text_key long, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, " + ", ".join(f"{c} double" for c in names))
    return run, schema


def judge(docs: DataFrame, vocabularies: tuple[Vocabulary, ...], min_words: int = 50, max_repeat: int = 50,
          fence: float = FENCE) -> DataFrame:
    """Counts, measures and verdict of every row of ``docs`` (doc_id, text and, if it is there, lang).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` % of them in repeated
    three-word windows. Bands are taken from all distinct texts that pass these rules, per language (or script,
    where lang is null or missing) and length class (half powers of two of the word count); where these are
    fewer than ``LEAST_TEXTS``, per language and four length classes, else per language, else per script. They go
    from the quartiles outwards by ``fence`` times their distance, or ``LEAST_SPREAD`` if that is more. ``kept`` is false if the
    base rules fail or a measure is outside its band. A null text counts as empty: no words, not kept. Rows
    that repeat and null ids are kept as they are; other columns are dropped; an empty table gives no rows.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    rows = materialize(docs.mapInArrow(*_measure(vocabularies)), "measures")
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    rows = rows.withColumn("group", F.when(F.col("lang") != "", F.col("lang")).otherwise(F.col("script")))
    rows = rows.withColumn("length_class", F.floor(2 * F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    names = {f"{v.name}_{m}": spread for v in vocabularies for m, spread in LEAST_SPREAD.items()}
    rows = rows.withColumn("length_span", F.floor(F.col("length_class") / 4).cast("int"))
    levels = [["group", "length_class"], ["group", "length_span"], ["group"], ["script"]]
    keys = ["group", "script", "length_class", "length_span", "text_key"]
    distinct = materialize(rows.where(~F.col("base_failed")).groupBy(keys).agg(*[F.min(c).alias(c) for c in names]),
                           "distinct")
    for i, level in enumerate(levels):
        texts = distinct.dropDuplicates(["script", "text_key"]) if level == ["script"] else distinct
        bands = texts.groupBy(level).agg(F.count("*").alias("texts"), *[
            F.percentile_approx(c, [0.25, 0.75], 2000).alias(f"band{i}_{c}") for c in names])
        if level != levels[-1]:
            bands = bands.where(F.col("texts") >= LEAST_TEXTS)
        rows = rows.join(bands.drop("texts"), level, "left")
    for c in names:
        rows = rows.withColumn(f"band_{c}", F.coalesce(*[f"band{i}_{c}" for i in range(len(levels))])).drop(
            *[f"band{i}_{c}" for i in range(len(levels))])
    inside = F.lit(True)
    for c, spread in names.items():
        low, high = F.col(f"band_{c}")[0], F.col(f"band_{c}")[1]
        room = F.greatest(fence * (high - low), F.lit(spread))
        inside = inside & F.col(c).between(low - room, high + room)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(
        "text_key", "length_span", *[f"band_{c}" for c in names])

