"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in features of itself and of the lines before and after
it; neighbouring labels have a score of their own. Forward-backward gives each line's probability of being
good; their mean, weighted by line length, calibrated on labelled documents, is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import in_batches, pieces, ragged, span_hashes, utf8, word_spans

FEATURES = [
    "log_chars", "log_words", "upper", "symbols", "digits", "exclamation", "pipes", "repeated_words", "same_as_previous",
    "mean_word_chars", "ends_sentence", "seen_before", "blank", "document_repeats", "document_same",
]
N = len(FEATURES)
FIT_DOCUMENTS = 4000
FIT_LINES = 400
ROUNDS = 2
STEPS = 150


def _marks(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOLS, DIGITS, EXCLAIM, PIPE = (_marks(x) for x in (b"#*$%&|<>", b"0123456789", b"!", b"|"))
UPPER, LETTER = _marks(bytes(range(65, 91))), _marks(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
CONTINUES = _marks(bytes(range(0x80, 0xC0)))
SENTENCE_END = _marks(b".!?:;\"'")


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every ``\\n``-separated line of a text column, the lines' lengths in characters and the
    ``rows + 1`` offsets into the lines. A null or empty text has one blank line."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    text_of_cut = np.searchsorted(offsets, cuts, side="right") - 1
    starts = np.concatenate([offsets[:-1], cuts + 1])
    owner = np.concatenate([np.arange(rows), text_of_cut])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:] - 1, offsets[owner[:-1] + 1])
    ends[-1:] = offsets[-1]
    bounds = np.searchsorted(owner, np.arange(rows + 1))

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float64)

    accents = np.zeros(len(data), bool)
    if len(data) > 1:
        accents[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    chars = (ends - starts) - total(CONTINUES[data])
    letters = np.maximum(total(LETTER[data]), 1)
    some = np.maximum(chars, 1)

    word_starts, word_ends, _ = word_spans(data, offsets)
    line_of_word = np.searchsorted(starts, word_starts, side="right") - 1
    hashes = span_hashes(data, word_starts, word_ends)
    words = np.bincount(line_of_word, minlength=len(starts)).astype(np.float64)
    distinct = np.unique((line_of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    same = np.bincount(line_of_word, weights=same, minlength=len(starts))
    some_words = np.maximum(words, 1)

    whole = span_hashes(data, starts, ends)
    by_text = np.lexsort((np.arange(len(starts)), whole, owner))
    repeat = np.zeros(len(starts), bool)
    repeat[by_text[1:]] = (whole[by_text[1:]] == whole[by_text[:-1]]) & (owner[by_text[1:]] == owner[by_text[:-1]])
    last = np.zeros(len(starts), bool)
    last[ends > starts] = SENTENCE_END[data[ends[ends > starts] - 1]]

    def share_of_text(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        every = np.concatenate([[0], np.cumsum(words)])
        return ((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(every[bounds[1:]] - every[bounds[:-1]], 1))[owner]

    out = np.stack([
        np.log1p(chars), np.log1p(words), (total(UPPER[data]) + total(accents)) / letters, total(SYMBOLS[data]) / some,
        total(DIGITS[data]) / some, total(EXCLAIM[data]) / some, total(PIPE[data]) / some_words,
        1 - distinct / some_words, same / some_words, chars / some_words, last, repeat & (words > 0), words == 0,
        share_of_text(words - distinct), share_of_text(same),
    ], axis=1)
    return out, chars, bounds


def with_neighbours(lines: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of each line, the one before, the one after (0 at the ends of a text) and a constant."""
    before, after = np.zeros_like(lines), np.zeros_like(lines)
    before[1:], after[:-1] = lines[:-1], lines[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate([lines, before, after, np.ones((len(lines), 1))], axis=1)


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray  # score of (label before, label)
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, lines: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((lines - self.mean) / self.scale, -6, 6), bounds)

    def document_scores(self, good: np.ndarray, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        mean = np.clip(length_weighted(good, chars, bounds), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.shift)))


def length_weighted(good: np.ndarray, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * (chars + 1), bounds[:-1]) / np.add.reduceat(chars + 1.0, bounds[:-1])


def forward_backward(unary: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected number of each (label before, label).

    ``unary`` is the score of "good" (that of "bad" is 0). All texts advance together, one line at a time.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    scores = np.stack([np.zeros_like(unary), unary], axis=1)
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    for t in range(longest):
        at = starts[: active[t]] + t
        ahead[at] = scores[at]
        if t:
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        onward = scores[at + 1] + back[at + 1]
        back[at] = np.logaddexp(onward[:, :1] + moves[:, 0], onward[:, 1:] + moves[:, 1])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    later = np.ones(len(unary), bool)
    later[bounds[:-1]] = False
    now = np.flatnonzero(later)
    pairs = np.exp(ahead[now - 1][:, :, None] + moves + (scores + back)[now][:, None, :] - total[now][:, None, None])
    return np.exp(both[:, 1] - total), pairs.sum(axis=0)


def fit_arrays(lines: np.ndarray, chars: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Crf:
    """Fit on documents' lines and documents' labels (1 good, 0 bad).

    At first all lines have their document's label. After each round, the lines of bad documents that the
    model finds good become good, apart from the worst one of each. Gradient steps are Adam's.
    """
    model = Crf(lines.mean(axis=0), np.maximum(lines.std(axis=0), 1e-3), np.zeros(3 * N + 1), np.zeros((2, 2)))
    inputs = model.inputs(lines, bounds)
    owner = np.repeat(np.arange(len(labels)), np.diff(bounds))
    target = labels[owner].astype(np.float64)
    later = np.ones(len(lines), bool)
    later[bounds[:-1]] = False
    now = np.flatnonzero(later)
    for _ in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[now - 1].astype(int), target[now].astype(int)), 1)
        first = second = np.zeros(3 * N + 5)
        values = np.concatenate([model.weights, model.moves.ravel()])
        for step in range(1, STEPS + 1):
            good, pairs = forward_backward(inputs @ values[:-4], bounds, values[-4:].reshape(2, 2))
            slope = np.concatenate([inputs.T @ (good - target), (pairs - seen).ravel()]) / len(lines) + 1e-4 * values
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            values = values - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights, model.moves = values[:-4], values[-4:].reshape(2, 2)
        good, _ = forward_backward(inputs @ model.weights, bounds, model.moves)
        worst = np.minimum.reduceat(good, bounds[:-1])[owner]
        target = np.where(labels[owner] == 1, 1.0, ((good > 0.5) & (good > worst)).astype(np.float64))
    mean = np.clip(length_weighted(good, chars, bounds), 1e-6, 1 - 1e-6)
    x = np.stack([np.log(mean / (1 - mean)), np.ones(len(mean))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        pull = x.T @ (p - labels) + 1e-2 * (line - [1, 0])
        line = line - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), pull)
    model.slope, model.shift = float(line[0]), float(line[1])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches):
        for piece in pieces(batch, "text"):
            lines, chars, bounds = line_features(piece.column("text"))
            each = [(lines[a:b].ravel(), chars[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("label"), ragged([x for x, _ in each], pa.float64()),
                 ragged([x for _, x in each], pa.float64())], ["label", "lines", "chars"])


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_lines: int = FIT_LINES) -> Crf:
    """Fit on at most ``fit_documents`` rows of ``docs`` (doc_id, text) with a label in ``labels`` (doc_id, label).

    The bound is met by taking the least hashes of doc_id; documents of more than ``fit_lines`` lines are not
    used to fit. Null ids and labels are left out, a doc_id with several labels has the least. Without any
    labelled document of both kinds the score is 0.5 plus nothing learnt: all weights are 0.
    """
    chosen = (labels.where("doc_id is not null and label is not null").groupBy("doc_id")
              .agg(F.min("label").cast("long").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.length("text") - F.length(F.translate("text", "\n", "")) < fit_lines)
    rows = rows.select("label", "text").mapInArrow(
        _features, "label long, lines array<double>, chars array<double>").toArrow()
    given = rows["label"].to_numpy()
    if len(np.unique(given)) < 2:
        return Crf(np.zeros(N), np.ones(N), np.zeros(3 * N + 1), np.zeros((2, 2)))
    chars = rows["chars"].combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(chars.value_lengths().to_numpy())])
    lines = rows["lines"].combine_chunks().flatten().to_numpy().reshape(-1, N)
    return fit_arrays(lines, chars.flatten().to_numpy(), bounds, given)


def score_rows(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with all its columns, and ``score`` and ``good_lines`` as in ``score``; own columns of these
    names are replaced. Rows stay where they are."""
    docs = docs.drop("score", "good_lines").withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                lines, chars, bounds = line_features(piece.column("text"))
                good, _ = forward_backward(model.inputs(lines, bounds) @ model.weights, bounds, model.moves)
                each = [good[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(model.document_scores(good, chars, bounds)), ragged(each, pa.float64())],
                    [*piece.schema.names, "score", "good_lines"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("good_lines", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, score, good_lines) of every row of ``docs`` (doc_id, text).

    ``score`` is 0 to 1, higher for better texts; ``good_lines`` holds the probability of each line. A null or
    empty text is scored as one blank line. Ids are passed on as they are; other columns are not read.
    """
    rows = score_rows(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return rows.select("doc_id", "score", "good_lines")


def remainder(column: str, of: int):
    """crc32 of a column as text modulo ``of``: the fold that a row is in."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of
