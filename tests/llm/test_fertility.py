"""Fertility rules: counts against plain Python, measures against whole-text tokenising, bands."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from tidemark.llm.fertility import Vocabulary, Words, judge

PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARIES = (
    Vocabulary("bytes", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    Vocabulary("pieces", PIECES),
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, repeated, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            repeated |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_counts_and_measures(spark):
    rng = random.Random(3)
    words = ["alpha", "béta", "#x", "<a|b>", "東京", "🙂", "ok", "it's", "a\x85b", "\x1f"]
    texts = [None, "", " \n\t", "one", "a b a b a b\na b\n\na b"] + [
        "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 80)))
        for _ in range(40)]
    docs = spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, n_words long")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = judge(docs, VOCABULARIES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        words_ = WORD.findall(text or "")
        ids = [x for w in words_ for x in model.encode(w)]
        if words_:
            assert math.isclose(r.pieces_chars_per_token, (r.word_chars + len(words_) - 1) / len(ids))
            assert math.isclose(r.pieces_fallback_share, sum(map(model.is_byte, ids)) / len(ids))
            share = [n / len(ids) for n in Counter(ids).values()]
            most = math.log2(len(ids)) if len(ids) > 1 else 1
            want = -sum(s * math.log2(s) for s in share) / most if len(ids) > 1 else 1
            assert math.isclose(r.pieces_entropy, want, abs_tol=1e-9)


def test_bands_reject_what_is_unlike_its_language(spark):
    rng = random.Random(4)
    words = [w.decode("latin-1") for w in (b"house", b"river", b"green", b"under", b"people", b"morning", b"between",
                                           b"water", b"small", b"letter", b"question", b"country", b"mountain")]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(100)), "en") for i in range(60)]
    junk = [(1000 + i, " ".join("%08x" % rng.getrandbits(32) + "ßæþ" for _ in range(100)), "en") for i in range(3)]
    rows = {r.doc_id: r for r in judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string"),
                                       VOCABULARIES).collect()}
    assert not any(rows[i].kept for i, _, _ in junk)
    assert all(rows[i].kept == (not rows[i].base_failed) for i, _, _ in clean)


def test_empty_table_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], "doc_id long, text string")
    assert judge(docs, VOCABULARIES).count() == 3
    assert judge(docs.limit(0), VOCABULARIES).count() == 0


def test_copies_and_lone_texts_do_not_set_the_bands(spark):
    rng = random.Random(6)
    short, long = ["a", "of", "to", "in", "it"], ["international", "government", "information", "development"]
    texts = [" ".join(rng.choice(long if rng.random() < i / 40 else short) + rng.choice(["", "", ",", "."])
                      for _ in range(100)) for i in range(40)]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, texts[20], "en") for i in range(200)]
    docs.append((5000, " ".join("%08x" % rng.getrandbits(32) + "ßæþ" for _ in range(900)), "en"))
    docs.append((5001, docs[-1][1], "xx"))
    rows = {r.doc_id: r for r in judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                                       VOCABULARIES).collect()}
    assert len(rows) == len(docs) and all(r.kept == (not r.base_failed) for i, r in rows.items() if i < 5000)
    assert not any(rows[i].kept or rows[i].base_failed for i in (5000, 5001))


def test_ids_of_many_words_come_as_one_array():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = Words(VOCABULARIES[1])
    for some in (["naïve", "a", "東京🙂"], ["a", "new"], []):
        flat, size = words.ids(some)
        assert size.tolist() == [len(model.encode(w)) for w in some]
        assert flat.tolist() == [i for w in some for i in model.encode(w)]
