"""Items in documents against exact containment."""

import random
import re

from tidemark.llm.decontaminate import find_items, without_items

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    found = set()
    for i, t in docs:
        own = shingles(t)
        for q, x in items:
            want = shingles(x)
            if q is not None and want and 100 * len(want & own) >= 80 * len(want):
                found.add((-1 if i is None else i, q, len(want), len(want & own)))
    return found


def test_like_exact_containment(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    items = [(i, text(rng.choice([3, 5, 6, 9, 15, 30, 60, 200]))) for i in range(40)]
    docs = []
    for i in range(120):
        own = text(rng.choice([0, 4, 10, 50, 300, 5000]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        docs.append((i, " ".join(own)))
    docs += [(500, None), (501, ""), (None, " ".join(items[4][1]).upper()), (502, docs[3][1])]
    items = [(i, " ".join(x)) for i, x in items] + [(900, None), (None, "a b c d e f"), (901, "")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row_key int")
    queries = spark.createDataFrame([(*q, 1) for q in items], "item_id long, text string, size int")
    rows = find_items(table, queries).collect()
    got = {(-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in rows}
    assert got == brute(docs, items) and len(got) == len(rows) > 30
    clean = without_items(table, queries)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i is not None and all(
        x[0] != i for x in got))
    assert find_items(table.limit(0), queries).count() == find_items(table, queries.limit(0)).count() == 0
