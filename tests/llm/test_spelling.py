import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import spelling

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows, min_chars=6, min_count=5, every=None):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if every and doc_id is not None and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    forms, found = {}, {}
    for w in n:
        others = sorted((-n[o], o) for o in n if near(w, o))
        best = others[0] if others and -others[0][0] >= 5 * n[w] else (None, None)
        forms[w] = best[1]
        found[w] = (len(others), -best[0] if best[0] else None)
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], *found[w]))
    return sorted(out)


def run(spark, rows, parts=3, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(tuple(r) for r in spelling.variants(docs, **more).collect())


def words_of(seed, many, letters="abcé"):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(many)]


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = words_of(5, 150)
    rows = [(int(i), " ".join(rng.choice(words, 40, p=None))) for i in range(120)]
    for min_chars in (3, 1):
        assert run(spark, rows, min_chars=min_chars, min_count=3) == brute(rows, min_chars, 3)


def test_damaged_occurrences(spark):
    text = "Correct spelling receives Correct spelling; Überall überall"
    rows = [(i, text) for i in range(600)]
    found = run(spark, rows, every=7, min_count=2)
    assert found == brute(rows, 6, 2, 7)
    assert any(r[1] for r in found) and any(r[2] != r[0] for r in found)


def test_chains_lead_to_the_last_form(spark):
    counts = {"aaaaaa": 125, "aaaaab": 25, "aaaabb": 5, "aaabbb": 1, "zzzzzz": 3}
    rows = [(1, " ".join(" ".join([w] * c) for w, c in counts.items()))]
    found = {r[0]: r for r in run(spark, rows, min_count=1)}
    assert found["aaabbb"][1:3] == ("aaaabb", "aaaaaa")
    assert found["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 3, 0, None)


def test_ties_go_to_the_smallest(spark):
    rows = [(1, " ".join(["abcdef"] * 2 + ["abcdeé"] * 20 + ["abcdez"] * 20 + ["abcde"] * 19))]
    found = {r[0]: r for r in run(spark, rows, min_count=1, min_chars=5)}
    assert found["abcdef"][1] == "abcdez" and found["abcdef"][4:] == (3, 20)
    assert found["abcdez"][1] is None


def test_long_words_meet_without_the_trie(spark):
    base = "abcdefghij" * 4  # as many letters as the trie goes deep
    much = "klmno" * 400
    words = [base, base[:-1], base + "x", base[:20] + "y" + base[21:], base[:5] + base[6:], "w" + base, base + "xy",
             much, much[:1000] + "é" + much[1001:], much[1:], much + "o"]
    rows = [(1, " ".join(" ".join([w] * (i + 1)) for i, w in enumerate(words)))]
    assert run(spark, rows, min_count=1) == brute(rows, 6, 1)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "missing " * 5), (None, "missing " * 6), (3, "123 ×÷× short"), (3, "word" * 50_000),
            (4, "Missing MISSING missings " * 5)]
    assert run(spark, rows, every=2) == brute(rows, every=2)
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "letter " * 9, "a", "b")], ["doc_id", "text", "word", "n"])
    assert [tuple(r) for r in spelling.variants(docs).collect()] == [("letter", None, "letter", 9, 0, None)]


def test_layout_does_not_matter(spark):
    rows = [(i, " ".join(words_of(i, 30, "ab"))) for i in range(40)]
    assert run(spark, rows, 1, min_count=2, min_chars=4) == run(spark, rows, 17, min_count=2, min_chars=4)
