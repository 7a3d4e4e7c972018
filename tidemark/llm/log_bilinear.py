"""Language-model scores by a class-factored log-bilinear model, beside an additive unigram score.

The probability of a token is that of its class after the two classes before it, times that of the word within
its class after the class before it. Both factors are log-bilinear: vectors of the context, turned by a matrix per
position, add up to a vector whose product with each outcome's own vector, plus a bias, is its score. The most frequent
words and the end of a text are classes of their own; other frequent words are grouped by the word that they mostly
follow, so words of one language or use share a class. Every word that training has ``LEAST_COUNT`` times or more has a
vector, up to ``FREQUENT`` words, which bounds what is broadcast; all further words are one class, within which a word
has its share of the additive estimate. So the probabilities of all words, unseen ones as one, add up to 1.

Parameters are fitted by noise-contrastive estimation to counts over the whole corpus: those of classes to trigrams of
classes, in tasks whose results are averaged after each round; those of words to pairs of (class before, word), each
class in a task of its own. Normalisers of all contexts are computed once, by batched matrix products. Which words are
modelled follows from exact counts, so scores do not depend on how the rows are partitioned.

Counts of frequent words are broadcast; counts of all others meet their texts in a join by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, pieces, word_hashes
from tidemark.session import materialize

CLASSES = 512
FREQUENT = 1 << 18
COUNTED_TEXTS = 10_000
MOST_HELD = 1 << 20
LEAST_COUNT = 2
CLASS_WORDS = 32
WIDTH = 16
WORD_WIDTH = 8
ROUNDS = 4
BATCH = 4096
NOISE = 64
NOISE_PER_TOKEN = 8
MOST_WEIGHT = 32
RATE = 0.5
TASKS = 8
HELD = 400_000
LEAST_STEPS = 120
WORD_STEPS = 20
ADD = 0.1


@dataclass
class Model:
    vectors: np.ndarray  # of classes as context
    turn: np.ndarray  # a matrix for each position, nearest first
    own: np.ndarray  # of the classes, or words of one class, that are predicted
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, width: int = WIDTH, contexts: int | None = None) -> Model:
        """For outcomes of the given shares after ``contexts`` classes, by default as many as outcomes."""
        rng = np.random.default_rng(7)
        size = len(share)
        return cls(rng.normal(0, 0.1, (contexts or size, width)), np.stack([np.eye(width), np.eye(width) * 0.5]),
                   rng.normal(0, 0.1, (size, width)), np.log(share))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.vectors, self.turn, self.own, self.bias)])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.vectors, self.turn, self.own, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        return Model(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (nearest class, class) with the bias, by (class before that, class), and the log
        normaliser of each context (nearest, before)."""
        near = self.vectors @ self.turn[0] @ self.own.T + self.bias
        far = self.vectors @ self.turn[1] @ self.own.T
        top, low = near.max(axis=1), far.max(axis=1)
        sums = np.exp(near - top[:, None]) @ np.exp(far - low[:, None]).T
        return near, far, np.log(sums) + top[:, None] + low[None, :]


def passes_for(steps: int, trigrams: int) -> int:
    """How often trigrams are passed over for at least so many steps; at least once."""
    return -(-steps * BATCH // max(trigrams, BATCH))


def train(model: Model, batches: Iterator[tuple[np.ndarray, np.ndarray]], share: np.ndarray, seed: int,
          passes: int) -> Model:
    """Noise-contrastive estimation with AdaGrad, in single precision, over blocks of (trigrams, counts). A count is
    dealt over examples of at most ``MOST_WEIGHT``."""
    rng = np.random.default_rng(seed)
    noise_log = np.log(NOISE_PER_TOKEN * share).astype(np.float32)
    edges = np.cumsum(share)
    model = Model(*(x.astype(np.float32) for x in (model.vectors, model.turn, model.own, model.bias)))
    square = [np.full(x.shape, 1e-2, np.float32) for x in (model.vectors, model.turn, model.own, model.bias)]

    def step(parts: list[tuple[int, np.ndarray | None, np.ndarray]]) -> None:
        for k, rows, slope in parts:
            value = (model.vectors, model.turn, model.own, model.bias)[k]
            if rows is not None:
                full = np.zeros_like(value)
                if value.ndim == 1:
                    full = np.bincount(rows, weights=slope, minlength=len(value))
                else:
                    order = np.argsort(rows, kind="stable")
                    sums = np.add.reduceat(slope[order], cut := np.flatnonzero(
                        np.concatenate([[True], np.diff(rows[order]) != 0])), axis=0)
                    full[rows[order][cut]] = sums
                slope = full
            square[k] += slope**2
            value -= RATE * slope / np.sqrt(square[k])

    for grams, counts in batches:
        times = -(-counts // MOST_WEIGHT)
        order = np.repeat(np.arange(len(counts)), times)
        order = np.concatenate([rng.permutation(order) for _ in range(passes)])
        weights = counts / times
        for begin in range(0, len(order), BATCH):
            at = order[begin : begin + BATCH]
            far, near, word = grams[at, 0], grams[at, 1], grams[at, 2]
            weight = (weights[at] / weights[at].sum()).astype(np.float32)[:, None]
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE) * edges[-1]), len(share) - 1)
            context = model.vectors[near] @ model.turn[0] + model.vectors[far] @ model.turn[1]
            real = (context * model.own[word]).sum(axis=1) + model.bias[word] - noise_log[word]
            false = context @ model.own[noise].T + model.bias[noise] - noise_log[noise]
            pull = -weight[:, 0] / (1 + np.exp(np.clip(real, -30, 30)))
            push = weight * (NOISE_PER_TOKEN / NOISE) / (1 + np.exp(-np.clip(false, -30, 30)))
            to_context = pull[:, None] * model.own[word] + push @ model.own[noise]
            step([
                (2, np.concatenate([word, noise]), np.concatenate([pull[:, None] * context, push.T @ context])),
                (3, np.concatenate([word, noise]), np.concatenate([pull, push.sum(axis=0)])),
                (1, None, np.stack([model.vectors[near].T @ to_context, model.vectors[far].T @ to_context])),
                (0, np.concatenate([near, far]),
                 np.concatenate([to_context @ model.turn[0].T, to_context @ model.turn[1].T])),
            ])
    return model


@dataclass
class Frequent:
    """Sorted hashes of frequent words and the class of each. Classes of several words begin at ``group_from``; the
    last two of the ``size`` classes are the end of a text and all other words."""

    hashes: np.ndarray
    classes: np.ndarray
    size: int
    group_from: int

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)

    def class_of(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.classes[at], self.size - 1) if len(self.classes) else np.full(
            len(at), self.size - 1)

    def trigrams(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class before, nearest, class) for every token, ends included, text after text; a text starts after
        two ends. Also the texts' offsets into them, and the words' places in them."""
        rows, end = len(bounds) - 1, self.size - 2
        offsets = bounds + np.arange(rows + 1)
        places = np.arange(len(at)) + np.repeat(np.arange(rows), np.diff(bounds))
        classes = np.full(offsets[-1], end, np.int64)
        classes[places] = self.class_of(at)
        near, far = np.full(len(classes), end, np.int64), np.full(len(classes), end, np.int64)
        near[1:], far[2:] = classes[:-1], classes[:-2]
        second = offsets[:-1] + 1
        far[second[second < len(far)]] = end  # a text's second token; of its first, both are ends by then
        near[offsets[:-1]] = far[offsets[:-1]] = end
        return np.stack([far, near, classes], axis=1), offsets, places

    def pair_ids(self, at: np.ndarray, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(class, word, class before) as one number for every word that shares its class."""
        some = np.flatnonzero(at >= 0)
        some = some[self.classes[at[some]] >= self.group_from]
        gram = grams[places[some]]
        return (gram[:, 2] * len(self.hashes) + at[some]) * self.size + gram[:, 1]


@dataclass
class Words:
    """Log-bilinear factors of words within the classes of several words: vectors of (class, class before), vectors and
    biases of all frequent words, and the log normaliser of each (class, class before)."""

    contexts: np.ndarray
    own: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    def logs(self, group: np.ndarray, near: np.ndarray, at: np.ndarray) -> np.ndarray:
        products = np.einsum("ij,ij->i", self.contexts[group, near], self.own[at], dtype=np.float64)
        return products + self.bias[at] - self.norm[group, near]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of several (ids, counts) and their summed counts."""
    ids, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return ids, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(ids)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words with their counts, summed over ``COUNTED_TEXTS`` texts or about ``MOST_HELD`` words."""
    held, texts = [], 0
    for batch in in_batches(batches):
        for piece in pieces(batch, "text"):
            held.append(np.unique(word_hashes(piece.column("text"))[0], return_counts=True))
        held, texts = [_added(held)], texts + batch.num_rows
        if texts >= COUNTED_TEXTS or len(held[0][0]) >= MOST_HELD:
            yield pa.RecordBatch.from_arrays([held[0][0].view(np.int64), held[0][1]], ["word", "times"])
            held, texts = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([held[0][0].view(np.int64), held[0][1]], ["word", "times"])


def _counts(frequent, trigrams: bool):
    """Counts of pairs (kind 0), of trigrams (1) and of texts (2), summed over ``COUNTED_TEXTS`` texts or about
    ``MOST_HELD`` trigrams. Without ``trigrams``, only pairs that do not follow the class of other words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        held, texts = {0: [], 1: [], 2: []}, 0

        def flush():
            parts = [(kind, *_added(held[kind])) for kind in held if held[kind]]
            return pa.RecordBatch.from_arrays(
                [np.concatenate([np.full(len(ids), kind, np.int32) for kind, ids, _ in parts]),
                 np.concatenate([ids for _, ids, _ in parts]), np.concatenate([n for _, _, n in parts])],
                ["kind", "id", "times"])

        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                words, bounds = word_hashes(piece.column("text"))
                at = known.find(words)
                grams, _, places = known.trigrams(at, bounds)
                pairs = known.pair_ids(at, grams, places)
                if trigrams:
                    held[1].append(np.unique((grams[:, 0] * known.size + grams[:, 1]) * known.size + grams[:, 2],
                                             return_counts=True))
                    held[2].append((np.zeros(1, np.int64), np.array([piece.num_rows])))
                else:
                    pairs = pairs[pairs % known.size != known.size - 1]
                held[0].append(np.unique(pairs, return_counts=True))
            held, texts = {kind: [_added(x)] if x else [] for kind, x in held.items()}, texts + batch.num_rows
            if texts >= COUNTED_TEXTS or sum(len(x[0][0]) for x in held.values() if x) >= MOST_HELD:
                yield flush()
                held, texts = {0: [], 1: [], 2: []}, 0
        if held[0]:
            yield flush()
    return run


def _rare(frequent):
    """(word, row_key, times) of every other word of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                words, bounds = word_hashes(piece.column("text"))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
                other = known.find(words) < 0
                words, owner = words[other], owner[other]
                order = np.lexsort((words, owner))
                words, owner = words[order], owner[order]
                first = np.flatnonzero(np.concatenate([
                    [True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])) if len(words) else np.zeros(0, int)
                times = np.diff(np.append(first, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[first].view(np.int64)), piece.column("row_key").take(pa.array(owner[first])),
                     pa.array(times.astype(np.int32))], ["word", "row_key", "times"])
    return run


def _scores(frequent, counts, tables, within):
    """Sums of each text over tokens whose count is known here, and the model's log10 of classes and their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (times, ends), (near, far, norm), inner = frequent.value, counts.value, tables.value, within.value
        logs = np.log10(times + ADD)
        for batch in in_batches(batches):
            for piece in pieces(batch, "text"):
                words, bounds = word_hashes(piece.column("text"))
                rows = piece.num_rows
                at = known.find(words)
                owner = np.repeat(np.arange(rows), np.diff(bounds))
                here = at >= 0
                log = np.zeros(len(at))
                log[here] = logs[at[here]]
                grams, offsets, places = known.trigrams(at, bounds)
                lm = near[grams[:, 1], grams[:, 2]] + far[grams[:, 0], grams[:, 2]] - norm[grams[:, 1], grams[:, 0]]
                some = np.flatnonzero(here)
                some = some[known.classes[at[some]] >= known.group_from]
                gram = grams[places[some]]
                lm[places[some]] += inner.logs(gram[:, 2] - known.group_from, gram[:, 1], at[some])

                def total(x, owner=owner, rows=rows):
                    return np.bincount(owner, weights=x, minlength=rows).astype(np.float64)

                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("row_key"), piece.column("learn"),
                     pa.array((np.diff(bounds) + 1).astype(np.int64)),
                     pa.array(total(here).astype(np.int64) + (ends > 0)),
                     pa.array(total(log) + np.log10(ends + ADD)), pa.array(total(~here).astype(np.int64)),
                     pa.array(np.add.reduceat(lm, offsets[:-1]) / np.log(10))],
                    ["doc_id", "row_key", "learn", "n_tokens", "known", "log_sum", "n_other", "lm"])
    return run


def _fit_class(cls: int, ids: np.ndarray, times: np.ndarray, words: int, size: int) -> dict:
    """Factors of the words of one class from the counts of its (word, class before) pairs."""
    order = np.argsort(ids)
    ids, times = ids[order], times[order]
    at, local = np.unique(ids // size % words, return_inverse=True)
    share = np.bincount(local, weights=times)
    share /= share.sum()
    end = size - 2  # the place of the class before the nearest, which this factor does not look at
    grams = np.stack([np.full(len(ids), end), ids % size, local], axis=1)
    passes = passes_for(WORD_STEPS, int((-(-times // MOST_WEIGHT)).sum()))
    model = train(Model.start(share, WORD_WIDTH, size), iter([(grams, times)]), share, cls, passes)
    contexts = (model.vectors @ model.turn[0] + model.vectors[end] @ model.turn[1]).astype(np.float32)
    own, bias = model.own.astype(np.float32), model.bias.astype(np.float32)
    scores = contexts.astype(np.float64) @ own.T.astype(np.float64) + bias
    top = scores.max(axis=1)
    norm = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
    return {"cls": [cls], "at": [at], "contexts": [contexts.ravel()], "own": [own.ravel()], "bias": [bias], "norm": [norm]}


def fit_words(pairs: DataFrame, known: Frequent) -> Words:
    """Factors of all classes of several words, each class fitted in a task of its own, which holds at most as many
    pairs as the class has words, times the number of classes."""
    words, size = len(known.hashes), known.size
    groups = max(size - 2 - known.group_from, 0)
    found = Words(np.zeros((groups, size, WORD_WIDTH), np.float32), np.zeros((words, WORD_WIDTH), np.float32),
                  np.zeros(words, np.float32), np.zeros((groups, size)))
    if not groups:
        return found
    names = {"cls": pa.int64(), "at": pa.list_(pa.int64()), "contexts": pa.list_(pa.float32()),
             "own": pa.list_(pa.float32()), "bias": pa.list_(pa.float32()), "norm": pa.list_(pa.float64())}

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fitted = _fit_class(key[0].as_py(), rows["id"].to_numpy(), rows["times"].to_numpy(), words, size)
        return pa.table({name: pa.array(fitted[name], kind) for name, kind in names.items()})

    dealt = pairs.withColumn("cls", F.expr(f"id div {words * size}")).groupBy("cls").applyInArrow(
        run, "cls long, at array<long>, contexts array<float>, own array<float>, bias array<float>, norm array<double>")
    for batch in materialize(dealt, "words").toArrow().to_batches():
        for i in range(batch.num_rows):
            cls = batch.column("cls")[i].as_py() - known.group_from
            at, contexts, own, bias, norm = (batch.column(name)[i].values.to_numpy() for name in list(names)[1:])
            found.contexts[cls], found.norm[cls] = contexts.reshape(size, -1), norm
            found.own[at], found.bias[at] = own.reshape(len(at), -1), bias
    return found


def fit(grams: DataFrame, share: np.ndarray, size: int, rounds: int = ROUNDS) -> Model:
    """Parameters from trigram counts (id, times): each task starts from the last round's mean and passes over
    its share of the counts, in blocks; the mean is weighted by tokens. There are at most ``size`` ** 3
    trigrams, so the number of tasks is fixed. How often a task passes over its share follows from the number of all
    trigrams, for at least ``LEAST_STEPS`` steps of each of ``TASKS`` tasks, so the work of a round is the same over more tasks."""
    model = Model.start(share)
    spark = grams.sparkSession
    examples = grams.agg(F.coalesce(F.sum(F.ceil(F.col("times") / MOST_WEIGHT)), F.lit(0))).first()[0]
    passes = passes_for(LEAST_STEPS * TASKS, int(examples))
    grams = grams.repartition(TASKS, "id").sortWithinPartitions("id")  # the same rows in the same order at any layout
    for number in range(rounds):
        now = spark.sparkContext.broadcast((model.flat(), number))

        def run(batches: Iterator[pa.RecordBatch], now=now, model=model) -> Iterator[pa.RecordBatch]:
            flat, number = now.value
            total = 0

            def read():
                nonlocal total
                held, rows = [], 0
                for batch in in_batches(batches):
                    held.append((batch.column("id").to_numpy(), batch.column("times").to_numpy()))
                    rows += batch.num_rows
                    total += int(held[-1][1].sum())
                    if rows >= HELD:
                        yield block(held)
                        held, rows = [], 0
                if held:
                    yield block(held)

            def block(held):
                ids, times = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                return np.stack([ids // size**2, ids // size % size, ids % size], axis=1), times

            own = train(model.like(flat), read(), share, number, passes)
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([total], pa.int64()), pa.array([own.flat().astype(np.float64)], pa.list_(pa.float64()))], ["weight", "values"])

        # Tasks' parameters are added up by position, so what the driver gets has the model's size.
        sums = (grams.mapInArrow(run, "weight long, values array<double>").select("weight", F.posexplode("values"))
                .groupBy("pos").agg((F.sum(F.col("col") * F.col("weight")) / F.sum("weight")).alias("mean"))
                .orderBy("pos").toArrow())
        if sums.num_rows:
            model = model.like(sums["mean"].to_numpy())
    return model


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of the greatest counts and these counts, in order of the hash, and the least count among them: as many as fit
    ``most`` without parting words of equal counts."""
    levels = counts.where(F.col("times") >= LEAST_COUNT).groupBy("times").agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(-levels["times"].to_numpy())
    times = levels["times"].to_numpy()[order]
    fit_in = np.flatnonzero(np.cumsum(levels["n"].to_numpy()[order]) <= most)
    if not len(fit_in):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.iinfo(np.int64).max
    least = int(times[fit_in[-1]])
    found = counts.where(F.col("times") >= least).toArrow()
    words = found["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found["times"].to_numpy()[order], least


def _classed(learnt: DataFrame, hashes: np.ndarray, times: np.ndarray, classes: int) -> Frequent:
    """Classes of the frequent words. Half of the classes are single words; the rest are sorted by the single word (or
    end) that they mostly follow and cut into runs of equal size."""
    ranked = np.lexsort((hashes, -times))
    singles, rest = ranked[: (classes - 2) // 2], ranked[(classes - 2) // 2 :]
    size = len(singles) + 2
    place = np.full(len(hashes), size - 1)
    place[singles] = np.arange(len(singles))
    if not len(rest):
        return Frequent(hashes, place, size, len(singles))
    first = learnt.sparkSession.sparkContext.broadcast(Frequent(hashes, place, size, size - 1))
    pairs = learnt.mapInArrow(_counts(first, False), "kind int, id long, times long").groupBy("id").agg(
        F.sum("times").alias("times"))
    follows = pairs.groupBy(F.expr(f"id div {size} % {len(hashes)}").alias("at")).agg(
        F.max(F.struct("times", (-(F.col("id") % size)).alias("minus"))).alias("most"))
    follows = follows.select("at", (-F.col("most.minus")).alias("after")).toArrow()
    after = np.full(len(hashes), size)
    after[follows["at"].to_numpy()] = follows["after"].to_numpy()
    rest = rest[np.argsort(after[rest], kind="stable")]
    groups = max(min(classes - 2 - len(singles), -(-len(rest) // CLASS_WORDS)), 1)
    place[rest] = len(singles) + np.arange(len(rest)) * groups // len(rest)
    return Frequent(hashes, place, len(singles) + groups + 2, len(singles))


def score(docs: DataFrame, learn, classes: int = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); ``learn`` is a condition on doc_id for rows to learn from.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; each text has one end token
    after them. Returns doc_id, learn, n_tokens, n_known (tokens that training has), train_tokens, base_score
    (log10 of the additive estimate, ``ADD`` per type), score (log10 by the model) and n_other (tokens that are not
    modelled as words). A null or empty text is its end token; long texts are read whole. A null id is not learnt from.
    Rows that repeat are learnt from and returned each; other columns are ignored; an empty table gives no rows; without
    rows to learn from, all words are unseen. Words of equal counts are modelled all or none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("learn", F.coalesce(learn, F.lit(False))).withColumn("row_key", F.xxhash64("doc_id", "text"))
    learnt = docs.where("learn").select("text")

    words = materialize(learnt.mapInArrow(_word_counts, "word long, times long").groupBy("word").agg(
        F.sum("times").alias("times")), "words")
    types, tokens = words.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    hashes, times, least = _most_frequent(words, frequent)
    classed = _classed(learnt, hashes, times, classes)
    size = classed.size
    known = spark.sparkContext.broadcast(classed)

    counted = materialize(learnt.mapInArrow(_counts(known, True), "kind int, id long, times long"), "counts")
    ends = counted.where("kind = 2").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    grams = materialize(counted.where("kind = 1").groupBy("id").agg(F.sum("times").alias("times")), "trigrams")
    share = np.full(size, 1.0)
    per_class = grams.groupBy((F.col("id") % size).cast("long").alias("id")).agg(F.sum("times").alias("times")).toArrow()
    share[per_class["id"].to_numpy()] += per_class["times"].to_numpy()
    model = fit(grams, share / share.sum(), size)
    tables = spark.sparkContext.broadcast(model.tables())
    pairs = counted.where("kind = 0").groupBy("id").agg(F.sum("times").alias("times"))
    within = spark.sparkContext.broadcast(fit_words(pairs, classed))

    rare = docs.select("row_key", "text").mapInArrow(_rare(known), "word long, row_key long, times int")
    unlisted = words.where(F.col("times") < least).select("word", F.col("times").alias("count"))
    rare = rare.join(unlisted, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rare = rare.groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10(F.col("count") + ADD)).alias("rare_log"),
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("rare_known"))

    counts = spark.sparkContext.broadcast((times, int(ends)))
    scored = docs.mapInArrow(
        _scores(known, counts, tables, within),
        "doc_id long, row_key long, learn boolean, n_tokens long, known long, log_sum double, n_other long, lm double")
    repeats = docs.groupBy("row_key").agg(F.count("*").alias("rows")).where("rows > 1")
    rare = rare.join(repeats, "row_key", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    scored = scored.join(rare, "row_key", "left")
    rare_log = F.coalesce(F.col("rare_log") / F.col("rows"), F.lit(0.0))
    rare_known = F.coalesce(F.col("rare_known") / F.col("rows"), F.lit(0)).cast("long")
    base = float(np.log10(tokens + ends + ADD * (types + (ends > 0) + 1)))
    other = float(np.log10(tokens - int(times.sum()) + ADD * (types - len(hashes) + 1)))
    return scored.select(
        "doc_id", "learn", "n_tokens", (F.col("known") + rare_known).alias("n_known"),
        F.lit(tokens + ends).cast("long").alias("train_tokens"),
        (F.col("log_sum") + rare_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("lm") + rare_log - F.col("n_other") * other).alias("score"), "n_other")
